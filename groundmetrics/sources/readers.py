"""Readers: delimited tables, inventories, telemetry JSON with repair, predictions, summaries, key lists, assets."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundmetrics.functions import text as tx
from groundmetrics.operators.scale import bucket_rank, small_side
from groundmetrics.operators.sets import natural_sort_key, normalize_inventory
from groundmetrics.session import checkpointed

POINT = "STRUCT<x:DOUBLE,y:DOUBLE,z:DOUBLE>"
JOINTS = f"STRUCT<joints:ARRAY<STRUCT<id:INT,position:{POINT}>>>"
SAMPLE = (
    f"timestamp:STRING,cameraPosition:{POINT},cameraRotation:STRUCT<x:DOUBLE,y:DOUBLE,z:DOUBLE,w:DOUBLE>,cameraFOV:DOUBLE,"
    f"eyeGaze:STRUCT<isEyeOpen:BOOLEAN,gazePoint:{POINT},gazeOrigin:{POINT},gazeVector:{POINT},cameraHitPoint:{POINT}>,"
    f"handData:STRUCT<isLeftHandTracked:BOOLEAN,isRightHandTracked:BOOLEAN,leftHand:{JOINTS},rightHand:{JOINTS},rightIndexFingerRayHitPoint:{POINT}>"
)


SEPARATORS = (",", "\t", ";")


def separator_of(path: Column, head: Column) -> Column:
    """Tab for ``.tsv``; otherwise the most frequent of comma, tab and semicolon in the header line (the earlier of these on a tie)."""
    counted = F.array(*[F.struct(F.regexp_count(head, F.lit(sep)).alias("n"), F.lit(-i).alias("i"), F.lit(sep).alias("sep")) for i, sep in enumerate(SEPARATORS)])
    return F.when(F.lower(path).endswith(".tsv"), F.lit("\t")).otherwise(F.array_max(counted)["sep"])


def _quoting(sep: str) -> tuple[Column, Column]:
    """Whether a line leaves a quoted field open when it begins outside, and when it begins inside of one.

    A quote opens a field only as its first character; inside, two quotes are one character.
    """
    body = r'[^"]*+(?:""[^"]*+)*+'
    last_open = rf'(?:(?:"{body}"[^{sep}]*+|(?!")[^{sep}]*+){sep})*+"{body}\z'
    value = F.col("value")
    return value.rlike(rf"^{last_open}"), value.rlike(rf"^{body}\z") | value.rlike(rf'^{body}"[^{sep}]*+{sep}{last_open}')


def _after(const: Column, swaps: Column, entry: Column) -> Column:
    """State after some lines: the last line that fixes it, or the state at entry, turned by every line that swaps it since."""
    return F.when(const.isNull(), entry + swaps).otherwise(const["v"] + swaps - const["at"]) % 2


def join_quoted_lines(lines: DataFrame) -> DataFrame:
    """Records of ``file_path, block, id, value, sep`` lines: lines inside a quoted field are joined to the line that opens it.

    Lines are ordered inside file blocks, and one row per block carries the state and the record number on, so a large file takes many
    tasks. Only records of several lines are gathered. A quote that the file never closes opens nothing: its lines stay apart.
    """
    out, inside = (F.coalesce(*[F.when(F.col("sep") == sep, q[i]) for sep, q in ((s, _quoting(s)) for s in SEPARATORS)]).cast("int") for i in (0, 1))
    marked = lines.withColumn("_out", out).withColumn("_in", inside)
    # without a line that opens a quote from outside a file never gets inside of one
    opening = checkpointed(marked.filter("_out = 1").select("file_path").distinct())
    if opening.isEmpty():
        return lines.select("file_path", "block", "id", "value")
    opening = small_side(opening)
    plain = lines.join(opening, "file_path", "left_anti").select("file_path", "block", "id", "value")

    by = Window.partitionBy("file_path", "block").orderBy("id")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    swap, fixed = ((F.col("_out") == 1) & (F.col("_in") == 0)).cast("bigint"), F.col("_out") == F.col("_in")
    m = marked.join(opening, "file_path", "left_semi").withColumn("_swaps", F.sum(swap).over(upto))
    m = m.withColumn("_fix", F.when(fixed, F.struct(F.col("_out").cast("bigint").alias("v"), F.col("_swaps").alias("at"))))
    m = m.withColumn("_was", F.last("_fix", ignorenulls=True).over(before)).withColumn("_swapped", F.coalesce(F.lag("_swaps").over(by), F.lit(0)))
    m = checkpointed(m)

    chain = Window.partitionBy("file_path").orderBy("block")
    ends = m.groupBy("file_path", "block").agg(F.max("_swaps").alias("_n"), F.max_by("_fix", F.when(F.col("_fix").isNotNull(), F.col("id"))).alias("_f"))
    ends = ends.withColumn("_upto", F.sum("_n").over(chain))
    turned = F.when(F.col("_f").isNotNull(), F.struct(F.col("_f.v").alias("v"), (F.col("_upto") - F.col("_n") + F.col("_f.at")).alias("at")))
    ends = ends.withColumn("_c", F.last(turned, ignorenulls=True).over(chain))
    ends = ends.withColumn("_end", _after(F.col("_c"), F.col("_upto"), F.lit(0)))
    ends = ends.withColumn("_entry", F.coalesce(F.lag("_end").over(chain), F.lit(0)))

    state = m.join(ends.select("file_path", "block", "_entry"), ["file_path", "block"])
    state = state.withColumn("_at", _after(F.col("_was"), F.col("_swapped"), F.col("_entry")))
    state = state.withColumn("_opens", ((F.col("_at") == 0) & (F.col("_out") == 1)).cast("bigint")).withColumn("_no", F.sum("_opens").over(upto))
    totals = state.groupBy("file_path", "block").agg(F.sum("_opens").alias("_n")).join(ends.select("file_path", "block", "_end"), ["file_path", "block"])
    totals = totals.withColumn("_off", F.sum("_n").over(chain) - F.col("_n"))
    whole = Window.partitionBy("file_path")
    totals = totals.withColumn("_all", F.sum("_n").over(whole)).withColumn("_open_end", F.max_by("_end", "block").over(whole) == 1)
    state = state.join(totals.drop("_n", "_end"), ["file_path", "block"]).withColumn("_no", F.col("_no") + F.col("_off"))
    part = (F.col("_opens") == 1) | (F.col("_at") == 1)
    part = part & ~(F.col("_open_end") & (F.col("_no") == F.col("_all")))
    state = checkpointed(state.select("file_path", "block", "id", "value", "_no", part.alias("_part")))
    alone = state.filter("NOT _part").select("file_path", "block", "id", "value")
    joined = state.filter("_part").groupBy("file_path", "_no").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("_l"))
    first = F.get("_l", 0)
    joined = joined.select("file_path", first["block"].alias("block"), first["id"].alias("id"), F.array_join(F.transform("_l", lambda x: x["value"]), "\n").alias("value"))
    return plain.unionByName(alone).unionByName(joined)


def read_delimited(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, aliases: Mapping[str, Sequence[str]] | None = None,
                   sep: str | None = None, source: bool = False) -> DataFrame:
    """All-text table of files with headers of their own: separators and column orders may differ, columns go by name.

    ``aliases`` names the accepted header spellings, ``types`` the target types (bad values become NULL). Absent columns, short rows and
    empty fields are NULL, fields beyond the header are left out, blank lines are skipped; of equal names in one header the last counts.
    Quoted fields may hold line breaks (rows, not headers); files are split among tasks all the same. ``source`` adds ``file_path, block,
    id``, which order the rows of a file. Files without a line give no row. The distinct header lines, which make the schema, go to the driver.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("id"), "value")
    heads = lines.filter((F.col("block") == 0) & (tx.strip("value") != "")).groupBy("file_path").agg(F.min_by("value", "id").alias("head"), F.min("id").alias("head_id"))
    heads = checkpointed(heads.withColumn("head", F.regexp_replace("head", "^\ufeff", "")))
    heads = heads.withColumn("sep", F.lit(sep) if sep else separator_of(F.col("file_path"), F.col("head")))
    layouts = [(r.head, r.sep, [c.strip() for c in next(csv.reader([r.head], delimiter=r.sep))]) for r in heads.select("head", "sep").distinct().sort("sep", "head").collect()]
    columns = list(dict.fromkeys(c for *_, names in layouts for c in names))
    if not columns:
        raise ValueError(f"no header line in {path}")
    places = [(h, s, [max((i for i, n in enumerate(names) if n == c), default=-1) for c in columns]) for h, s, names in layouts]
    places = spark.createDataFrame(places, "head string, sep string, _at array<int>")
    heads = small_side(heads.join(F.broadcast(places), ["head", "sep"]).select("file_path", "head_id", "sep", "_at"))
    rows = lines.join(heads.select("file_path", "head_id", "sep"), "file_path").filter("id <> head_id").drop("head_id")
    records = join_quoted_lines(rows).filter(tx.strip("value") != "").join(heads.select("file_path", "sep", "_at"), "file_path")

    width = max(len(names) for *_, names in layouts)
    shape = ", ".join(f"_{i} string" for i in range(width))
    used = sorted({s for _, s, _ in layouts})
    cells = F.coalesce(*[F.when(F.col("sep") == s, F.from_csv("value", F.lit(shape), {"sep": s, "escape": '"', "mode": "PERMISSIVE"})) for s in used])
    records = records.withColumn("_cells", cells).withColumn("_cells", F.array(*[F.col(f"_cells._{i}") for i in range(width)]))
    at = lambda i: F.col("_at")[i]
    df = records.select("file_path", "block", "id", *[F.when(at(i) >= 0, F.get("_cells", at(i))).alias(f"_v{i}") for i in range(len(columns))])
    have: dict[str, list[Column]] = {}
    for i, c in enumerate(columns):
        have.setdefault(c.lower(), []).append(F.col(f"_v{i}"))
    out = {c: F.col(f"_v{i}") for i, c in enumerate(columns)}
    for name, spellings in (aliases or {}).items():
        found = [F.nullif(tx.strip(v), F.lit("")) for s in spellings for v in have.get(s.lower(), [])]
        if found:
            out[name] = F.coalesce(*found)
    for name, kind in (types or {}).items():
        out[name] = tx.strip(out[name]).try_cast(kind)
    return df.select(*[F.col(c).alias(f"_{c}" if c in out else c) for c in ("file_path", "block", "id") if source], *[c.alias(n) for n, c in out.items()])


def read_anchors(spark: SparkSession, root: str) -> DataFrame:
    """Inventory files ``<scene>_anchor_table.{tsv,csv}`` in one scan, headers in any spelling; the scene comes from the file name.

    Rows keep their order in the file, which decides ties and alias overwrites. A scene of several files takes them by name.
    """
    df = read_delimited(spark, root, source=True)
    scene = F.regexp_extract(F.col("file_path"), r"([^/]+?)_anchor_table\.[a-z]+$", 1)
    files = df.select("file_path").distinct().select("file_path", F.row_number().over(Window.partitionBy(scene).orderBy("file_path")).alias("_file"))
    # a block holds fewer lines than bytes, so block start plus rank grows along the file
    ordered = bucket_rank(df, ["file_path", "block"], "id", "_row", 1 << 20).join(small_side(files), "file_path")
    seq = F.shiftleft(F.col("_file").cast("bigint"), 44) + F.col("block") + F.col("_row")
    return normalize_inventory(ordered.select("*", scene.alias("scene"), seq.alias("anchor_seq")))


def repair_array_text(c):
    """Array-like logs: missing commas between objects, missing closing bracket, or one object per line."""
    t = tx.strip(c)
    joined = F.regexp_replace(t, r"\}(\r?\n)\{", "},$1{")
    short = (F.regexp_count(joined, F.lit(r"\[")) == F.regexp_count(joined, F.lit(r"\]")) + 1) & joined.endswith("}")
    closed = F.when(short, F.concat(joined, F.lit("\n]"))).otherwise(joined)
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.regexp_replace(tx.strip(x), ",+$", "")), lambda x: x != "")
    return F.when(t.startswith("["), closed).otherwise(F.concat(F.lit("["), F.concat_ws(",", lines), F.lit("]")))


def read_telemetry(spark: SparkSession, path: str, scene_pattern: str = r"/([^/]+)/[^/]+$") -> tuple[DataFrame, DataFrame]:
    """Samples of whole-file JSON logs, and the files that could not be read even after repair.

    A log is one interaction's recording, read as one text because the repair needs its end.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    files = files.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    text = F.when(F.try_parse_json("value").isNotNull() & tx.strip("value").startswith("["), F.col("value")).otherwise(repair_array_text("value"))
    files = files.withColumn("_text", text).withColumn("_ok", F.try_parse_json("_text").isNotNull())
    bad = files.filter("NOT _ok").select("file_path")
    rows = files.filter("_ok").select("file_path", F.regexp_extract("file_path", scene_pattern, 1).alias("scene"),
                                      F.posexplode(F.from_json("_text", f"ARRAY<STRUCT<{SAMPLE}>>")).alias("file_seq", "_s"))
    samples = rows.filter("_s IS NOT NULL").select("file_path", "scene", F.col("file_seq").cast("bigint"), "_s.*")
    return samples.withColumn("t_us", F.unix_micros(tx.parse_iso("timestamp"))), bad


def read_predictions_json(spark: SparkSession, path: str) -> DataFrame:
    """Per-interaction JSON files; the row index comes from the payload or from ``row_<n>.json``."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("payload"))
    own = F.get_json_object("payload", "$.row_index")
    index = F.coalesce(F.when(own.rlike(r"^\s*\d+\s*$"), tx.strip(own).try_cast("bigint")), F.regexp_extract("file_name", r"row_(\d+)\.json$", 1).try_cast("bigint"))
    return df.select(F.get_json_object("payload", "$.scene").alias("scene"), index.alias("row_index"), "file_name", "payload")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summary JSON files with the scene taken from the file name."""
    df = spark.read.option("multiLine", True).json(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return df.select("*", F.regexp_replace(F.regexp_replace(name, r"_?match_eval.*$", ""), r"_?summary$", "").alias("scene"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Per directory, the first ``metadata_*.json`` (by name) that parses and has a timestamp."""
    df = spark.read.text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    df = df.select(F.regexp_extract(file, r"^(.*)/[^/]+$", 1).alias("directory"), F.regexp_extract(file, r"([^/]+)$", 1).alias("file_name"),
                   tx.parse_iso(F.get_json_object("value", "$.timestamp")).alias("meta_ts"))
    used = df.filter(F.col("meta_ts").isNotNull() & F.col("file_name").rlike(r"^metadata_.*\.json$"))
    return used.groupBy("directory").agg(F.min_by("meta_ts", "file_name").alias("meta_ts"), F.min("file_name").alias("file_name"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Directory, file name and natural order key of every file below ``path`` (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    d = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("directory"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path")
    return d.withColumn("order_key", natural_sort_key("directory"))


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of file contents, used to drop repeated frames."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"))


def read_keys(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``scene:row_index`` lines (last colon splits; comments and blanks ignored) and the malformed lines."""
    lines = spark.read.text(path).select(tx.strip("value").alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    pattern = r"^(.*):(\d+)$"
    keys = lines.select("line", F.regexp_extract("line", pattern, 1).alias("scene"), F.regexp_extract("line", pattern, 2).try_cast("bigint").alias("row_index"))
    good = keys.filter("scene <> '' AND row_index IS NOT NULL")
    return good.select("scene", "row_index"), keys.filter("scene = '' OR row_index IS NULL").select("line")
