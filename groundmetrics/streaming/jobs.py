"""Structured Streaming counterparts of the polling and resume loops.

Batch results stay authoritative: a watermark drops data that arrives later than it allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundmetrics.functions import geometry as geo
from groundmetrics.functions import text as tx
from groundmetrics.operators.scale import small_side
from groundmetrics.operators.sets import KEY, prf
from groundmetrics.operators.timeline import eye, eye_cues, segmented_samples

PREDICTION = "scene STRING, row_index BIGINT, run STRING, ts TIMESTAMP, parsed_json STRING, parse_ok BOOLEAN, tp BIGINT, fp BIGINT, fn BIGINT"


def prediction_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON-lines predictions as they land in a folder."""
    return spark.readStream.schema(PREDICTION).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest_predictions(stream: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", keys: Sequence[str] = ("run", *KEY)) -> StreamingQuery:
    """Exactly one stored row per key within the watermark, as Parquet."""
    unique = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
    return (unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .partitionBy("run").trigger(availableNow=True).start())


def progress(stream: DataFrame, expected: DataFrame) -> DataFrame:
    """Outputs done against expected per run, with the last-seen time (update or complete mode)."""
    done = stream.groupBy("run").agg(F.count("*").alias("done"), F.count_if("parse_ok").alias("parsed"), F.max("ts").alias("last_seen"))
    return done.join(F.broadcast(expected), "run", "left").withColumn("share", F.col("done") / F.col("expected"))


def gaze_segments(samples: DataFrame, duration: str, delay: str) -> DataFrame:
    """Tumbling segments on the clock, on a live feed: samples and valid gaze per (interaction, window)."""
    return (samples.withWatermark("ts", delay).groupBy(*KEY, F.window("ts", duration))
            .agg(F.count("*").alias("n_samples"), F.count_if("gaze_valid").alias("n_gaze"))
            .select(*KEY, F.col("window.start").alias("start_time"), F.col("window.end").alias("end_time"), "n_samples", "n_gaze"))


def live_segments(events: DataFrame, samples: DataFrame, anchors: DataFrame, keys: Sequence[str], event_keys: Sequence[str], duration: int,
                  width: int, delay: str, top: int = 3, slack: float = 0.75) -> DataFrame:
    """``timeline_segments`` on a live feed of samples with ``segment_cues``; ``events`` and ``anchors`` are tables.

    The state is keyed by (event, segment), so a long event spreads over many keys and a state row holds one segment's cues. The
    watermark runs on segment ends: a segment is emitted once, by the batch after the one that saw a segment ending more than ``delay``
    later; its samples that arrive after that batch are dropped, and segments still open at the end of the feed stay in the state. Rows emitted equal the
    batch ones on the same samples. ``anchors`` must be an inventory that passes ``small_side``: a scene is one row.
    """
    seg = [*event_keys, "segment"]
    s = segmented_samples(events, samples, keys, duration, width).withColumn("end_ts", F.timestamp_micros("end_us")).withWatermark("end_ts", delay)
    extra = [c for c in ("scene",) if c not in event_keys]
    cue = F.struct("t_us", "file_seq", "gaze", "gaze_origin", "gaze_vector")
    held = s.groupBy(*seg, *extra, "start_us", "end_us", "end_ts").agg(
        F.count("gaze").alias("n_gaze"), F.count("hand_hit").alias("n_hand"), F.collect_list(F.when(F.col("gaze").isNotNull(), cue)).alias("_cues"))
    scenes = anchors.groupBy("scene").agg(F.collect_list(F.struct("anchor_id", "x", "y", "z")).alias("_anchors"))
    d = held.filter("n_gaze >= 2").withColumn("_cues", F.array_sort("_cues")).join(small_side(scenes), "scene")

    def stats(a: Column) -> Column:
        far = F.transform("_cues", lambda c: F.struct(geo.distance(c["gaze"], a).alias("d"), c["t_us"].alias("t_us")))
        return tx.let(far, lambda f: tx.let(F.array_min(f), lambda m: F.struct(
            m["d"].alias("min_d"), (-F.size(F.filter(f, lambda v: v["d"] <= m["d"] + slack)).cast("bigint")).alias("_far"),
            a["anchor_id"].alias("anchor_id"), a["x"].alias("_x"), a["y"].alias("_y"), a["z"].alias("_z"), m["t_us"].alias("nearest_us"))))

    d = d.withColumn("_near", F.slice(F.array_sort(F.transform("_anchors", stats)), 1, top)).withColumn("_best", F.get("_near", 0))
    at = F.get(F.filter("_cues", lambda c: c["t_us"] == F.col("_best.nearest_us")), 0)
    middle = F.get("_cues", F.floor(F.col("n_gaze") / 2).cast("int"))
    nearest = F.transform("_near", lambda n, i: F.struct(
        (i + 1).alias("anchor_rank"), n["anchor_id"].alias("anchor_id"), n["min_d"].alias("min_d"), n["nearest_us"].alias("nearest_us"),
        (-n["_far"]).alias("close_frames")))
    out = d.withColumn("_eye", eye(at)).withColumn("_middle", eye(middle))
    return out.select(*seg, "start_us", "end_us", F.col("_best.nearest_us").alias("t_us"), "n_gaze", "n_hand", F.col("_best.min_d").alias("best_d"),
                      nearest.alias("nearest"), eye_cues(F.col("_eye"), F.col("_middle")).alias("eye_cues"),
                      (F.col("n_gaze") / (1.0 + F.col("_best.min_d"))).alias("score"))


def running_metrics(stream: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Running TP / FP / FN sums and micro scores per variant (complete mode)."""
    sums = stream.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f1 = prf("tp", "fp", "fn", 0.0)
    return sums.withColumn("micro_precision", p).withColumn("micro_recall", r).withColumn("micro_f1", f1)
