"""Sharding, resumable scoring, positional and rule-based assignment, record rendering and masking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmetrics.functions import text as tx
from groundmetrics.operators.scale import bucket_rank, small_side
from groundmetrics.operators.sets import KEY

VARIANTS = ("full", "no_visual", "no_gaze", "no_hand", "no_hand_strict", "no_gaze_hand", "no_instruction")


def assign_shards(keys: DataFrame, done: DataFrame, k: int, round_robin: bool = False, width: int = 1_000_000) -> DataFrame:
    """Shard number of every key that has no output yet: contiguous chunks of ``ceil(n / k)``, or round-robin."""
    todo = keys.select(*KEY).join(done.select(*KEY), KEY, "left_anti")
    ranked = bucket_rank(todo, [], "row_index", "_rank", width, ["scene"])
    index = F.col("_rank") - 1
    if round_robin:
        return ranked.withColumn("shard", F.pmod(index, F.lit(k))).drop("_rank")
    n = todo.agg(F.count("*").alias("_n"))
    chunk = F.greatest(F.ceil(F.col("_n") / k), F.lit(1))
    return ranked.crossJoin(F.broadcast(n)).withColumn("shard", F.floor(index / chunk)).drop("_rank", "_n")


def head_keys(keys: DataFrame, n: int) -> DataFrame:
    """First ``n`` keys in order; fewer available keys are an error."""
    out = keys.select(*KEY).orderBy(*KEY).limit(n)
    have = out.count()
    if have < n:
        raise ValueError(f"asked for {n} keys, only {have} available")
    return out


def score_batch(todo: DataFrame, done: DataFrame, predictor: Callable[[pd.DataFrame], list], keys: Sequence[str] = KEY) -> DataFrame:
    """Run a caller-supplied predictor over rows without an output; a failing row becomes an error row.

    The predictor gets Arrow batches. If it raises on a batch, the rows of that batch are retried one by one.
    """
    keys = list(keys)
    open_rows = todo.join(done.select(*keys), keys, "left_anti")
    types = dict(open_rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            try:
                out["raw_output"], out["error_message"] = list(predictor(batch)), ""
            except Exception:
                results = []
                for i in range(len(batch)):
                    try:
                        results.append((predictor(batch.iloc[i:i + 1])[0], ""))
                    except Exception as exc:
                        results.append(("", f"{type(exc).__name__}: {exc}"))
                out["raw_output"] = [r[0] for r in results]
                out["error_message"] = [r[1] for r in results]
            yield out

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", raw_output string, error_message string"
    return open_rows.mapInPandas(run, schema)


def append_scores(scored: DataFrame, path: str) -> None:
    """Append one run's outputs; the next run's anti-join against this table is the resume point."""
    scored.write.mode("append").partitionBy("scene").parquet(path)


def positional_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str, width: int = 1_000_000) -> DataFrame:
    """Join the n-th row of each scene on both sides (orders are unique numbers per scene)."""
    a = bucket_rank(left, ["scene"], left_order, "position", width)
    b = bucket_rank(right, ["scene"], right_order, "position", width)
    return a.join(b, ["scene", "position"])


def position_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Scenes whose two sides differ in length."""
    n = [d.groupBy("scene").agg(F.count("*").alias(c)) for d, c in ((left, "n_left"), (right, "n_right"))]
    return n[0].join(n[1], "scene", "full").filter(~F.col("n_left").eqNullSafe(F.col("n_right")))


def parse_rules(df: DataFrame, rule: str = "rule") -> DataFrame:
    """``start-end:scene:order`` rules to one row per manifest id; malformed rules keep a NULL id."""
    pattern = r"^(\d+)-(\d+):(\d+):(\d+)$"
    part = [F.regexp_extract(tx.strip(rule), pattern, i).try_cast("bigint") for i in range(1, 5)]
    p = df.withColumns({"_start": part[0], "_end": part[1], "instruction_scene": part[2], "_order": part[3]})
    ids = F.when(F.col("_end") >= F.col("_start"), F.sequence("_start", "_end"))
    rows = p.select(*df.columns, "instruction_scene", "_order", F.posexplode_outer(ids).alias("_offset", "manifest_id"))
    return rows.withColumn("instruction_order", F.col("_order") + F.col("_offset")).drop("_order", "_offset")


def range_assign(rules: DataFrame, manifest: DataFrame, instructions: DataFrame) -> DataFrame:
    """Expanded rules with their manifest and instruction rows and a status per assignment."""
    rows = parse_rules(rules)
    n = rows.groupBy("manifest_id").agg(F.count("*").alias("_n"))
    j = rows.join(manifest, "manifest_id", "left").join(instructions, ["instruction_scene", "instruction_order"], "left").join(n, "manifest_id", "left")
    status = (F.when(F.col("manifest_id").isNull(), "invalid_rule").when(F.col("event_id").isNull(), "missing_manifest")
              .when(F.col("instruction_text").isNull(), "missing_instruction").when(F.col("_n") > 1, "duplicate_assignment").otherwise("ok"))
    target = F.coalesce(F.nullif(tx.norm_text("target_description"), F.lit("")), F.col("instruction_text"))
    return j.withColumn("status", status).withColumn("target_description", target).drop("_n")


def offset_lookup(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Clock offset of each video: the first usable manifest value wins, with its origin."""
    usable = manifest.select("video_path", "manifest_seq", tx.finite_double("offset").alias("_o")).filter("_o IS NOT NULL AND video_path <> ''")
    first = usable.groupBy("video_path").agg(F.min_by("_o", "manifest_seq").alias("_o"))
    j = events.join(first, "video_path", "left")
    source = (F.when(F.col("video_path").isNull() | (F.col("video_path") == ""), "none:no_video")
              .when(F.col("_o").isNotNull(), "manifest").otherwise("default_zero:no_manifest_match"))
    return j.withColumn("offset_seconds", F.coalesce("_o", F.lit(0.0))).withColumn("offset_source", source).drop("_o")


def point_text(p: Column, digits: int = 6) -> Column:
    form = ", ".join(f"{a}=%.{digits}f" for a in "xyz")
    return F.coalesce(F.when(p.isNotNull(), F.format_string(form, p["x"], p["y"], p["z"])), F.lit("None"))


def bracket_text(p: Column, digits: int = 6) -> Column:
    form = "[" + ", ".join([f"%.{digits}f"] * 3) + "]"
    return F.coalesce(F.when(p.isNotNull(), F.format_string(form, p["x"], p["y"], p["z"])), F.lit("None"))


def frame_block(f: Column) -> Column:
    """Telemetry lines of one evidence frame."""
    pid = f["panel_id"]
    lines = [
        F.concat(F.lit("- "), pid, F.lit(":")),
        F.concat(F.lit("  image: "), f["image"]),
        F.concat(F.lit("  relative_sample_time_seconds: "), f["seconds"].cast("string")),
        F.concat(F.lit("  selection_score: "), f["score"].cast("string")),
        F.concat(F.lit("  selection_reason: "), f["reason"]),
        F.lit("  camera_context_world:"),
        F.concat(F.lit("    camera_position_world: "), point_text(f["camera"])),
        F.lit("  ray_cues_not_ground_truth:"),
        F.concat(F.lit("    gaze_valid: "), F.initcap(f["gaze_valid"].cast("string"))),
        F.concat(F.lit("    gaze_hit_world_ray_endpoint: "), point_text(f["gaze"])),
        F.concat(F.lit("    hand_valid: "), F.initcap(f["hand_valid"].cast("string"))),
        F.concat(F.lit("    hand_hit_world_ray_endpoint: "), point_text(f["hand"])),
        F.lit("  primary_copyable_gaze_point_hypotheses:"),
        F.concat(F.lit("    "), pid, F.lit("_GAZE: "), bracket_text(f["gaze"])),
        F.lit("  secondary_copyable_hand_point_hypotheses:"),
        F.concat(F.lit("    "), pid, F.lit("_HAND: "), bracket_text(f["hand"])),
        F.lit("  scale_cues_world_units:"),
        F.concat(F.lit("    camera_to_gaze_hit_distance: "), F.coalesce(f["gaze_distance"].cast("string"), F.lit("None"))),
        F.concat(F.lit("    camera_to_hand_hit_distance: "), F.coalesce(f["hand_distance"].cast("string"), F.lit("None"))),
    ]
    return F.concat_ws("\n", *lines)


def bounds_block(b: Column) -> Column:
    lines = [F.lit("world_coordinate_format: [x_world, y_world, z_world]")]
    for a in "xyz":
        lines.append(F.format_string(f"{a}_robust_5_95_world_units: [%.3f, %.3f]", b[f"{a}_q05"], b[f"{a}_q95"]))
    centre = [(b[f"{a}_q05"] + b[f"{a}_q95"]) / 2.0 for a in "xyz"]
    lines.append(F.format_string("scene_robust_center_world: [%.3f, %.3f, %.3f]", *centre))
    lines.append(F.format_string("robust_scene_diagonal_world_units: %.3f", b["robust_diagonal"]))
    return F.concat_ws("\n", *lines)


def event_block(event_id: Column, instruction: Column, utterance: Column) -> Column:
    said = F.when(tx.norm_text(utterance) != "", F.concat(F.lit("\nutterance_text: "), tx.norm_text(utterance))).otherwise("")
    return F.concat(F.lit("event_id: "), event_id, F.lit("\ninstruction_text: "), tx.norm_text(instruction), said)


def render_context(df: DataFrame, template: str) -> DataFrame:
    """Fill the event, scene-bounds and evidence slots of a record template."""
    blocks = {
        "[EVENT_BLOCK]": event_block(F.col("event_id"), F.col("instruction_text"), F.col("utterance_text")),
        "[SCENE_BOUNDS_BLOCK]": bounds_block(F.col("bounds")),
        "[EVIDENCE_BLOCK]": F.concat_ws("\n", F.transform("frames", frame_block)),
    }
    text = F.lit(template)
    for slot, block in blocks.items():
        text = F.replace(text, F.lit(slot), block)
    return df.withColumn("context_text", text)


# Labels of a record's fields by what they tell, and which kinds each variant withholds.
FIELDS = {
    "instruction": ("instruction_text", "utterance_text"),
    "image": ("image",),
    "gaze": ("gaze_valid", "gaze_origin_world", "gaze_direction_world_unit_vector_do_not_copy", "gaze_hit_world_ray_endpoint",
             "primary_copyable_gaze_point_hypotheses", r"P\d+_GAZE", "camera_to_gaze_hit_distance"),
    "hand": ("hand_valid", "hand_origin_world", "hand_direction_world_unit_vector_do_not_copy", "hand_hit_world_ray_endpoint",
             "secondary_copyable_hand_point_hypotheses", r"P\d+_HAND", "camera_to_hand_hit_distance"),
    "cues": ("selection_score", "selection_reason", "gaze_to_hand_hit_distance"),
    "rest": ("Event", "event_id", "Scene bounds", "Evidence", r"P\d+", "relative_sample_time_seconds", "camera_context_world",
             "camera_position_world", "ray_cues_not_ground_truth", "scale_cues_world_units"),
}
WITHHELD = {
    "no_visual": ("image",),
    "no_gaze": ("gaze", "cues"),
    "no_hand": ("hand", "cues"),
    "no_hand_strict": ("hand", "cues"),
    "no_gaze_hand": ("gaze", "hand", "cues"),
    "no_instruction": ("instruction",),
}
MASKED_IMAGE = "[visual_evidence_withheld]"


def _label(kinds: Sequence[str]) -> str:
    return "(?:- )?(?:" + "|".join(name for kind in kinds for name in FIELDS[kind]) + "):"


def record_fields(text: Column) -> Column:
    """A record cut before each labelled field; the parts joined give the record again.

    Labels count at line starts, or after any blank in a record kept on one line, so that words of an
    instruction are not taken for fields where lines tell them apart.
    """
    any_label = _label(list(FIELDS))
    lines = F.split(text, rf"(?=\n[ \t]*{any_label})")
    blanks = F.split(text, rf"(?=(?<!\s)\s+{any_label})")
    return F.when(F.contains(text, F.lit("\n")), lines).otherwise(blanks)


def mask_text(fields: Column, variant: str) -> Column:
    """The record without the fields that the variant withholds; an image field keeps its label."""
    kinds = WITHHELD.get(variant, ())
    if "image" in kinds:
        label = rf"^\s*{_label(['image'])}"
        fields = F.transform(fields, lambda f: F.when(f.rlike(label), F.concat(F.regexp_substr(f, F.lit(label)), F.lit(f" {MASKED_IMAGE}"))).otherwise(f))
    elif kinds:
        fields = F.filter(fields, lambda f: ~f.rlike(rf"^\s*{_label(kinds)}"))
    return F.array_join(fields, "")


def mask_context(df: DataFrame, variants: Sequence[str] = VARIANTS, text: str = "context_text") -> DataFrame:
    """One masked copy of each record per variant: fields are cut out, everything else stays as it was."""
    unknown = set(variants) - set(VARIANTS)
    if unknown:
        raise ValueError(f"unknown variants: {sorted(unknown)}")
    copies = F.array(*[F.struct(F.lit(v).alias("variant"), mask_text(F.col("_fields"), v).alias("_masked")) for v in variants])
    rest = [c for c in df.columns if c != text]
    return df.withColumn("_fields", record_fields(F.col(text))).select(*rest, F.inline(copies)).withColumnRenamed("_masked", text)
