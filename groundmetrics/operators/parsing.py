"""Prediction parsing and validation as table jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmetrics.functions import payload as pl
from groundmetrics.functions import text as tx
from groundmetrics.operators.scale import small_side

# Accepted vocabularies of the response schemas and the modality aliases.
REFERENT_TYPES = ("entity", "spatial", "none")
PRIMARY_SOURCES = ("gazePoint", "cameraHitPoint", "rightIndexFingerRayHitPoint", "fused", "visual_only", "none")
PRIOR_USAGE = ("exact_prior", "near_prior", "offset_from_prior", "no_prior")
SELECTION_SOURCES = ("gazePoint", "visual_only", "language", "none")
MODALITIES = ("visual", "gaze", "hand", "structured_geometry", "timeline")
MODALITY_ALIASES = {
    "vision": "visual", "image": "visual", "video": "visual", "visual_evidence": "visual",
    "eye": "gaze", "eye_cue": "gaze", "eye_cues": "gaze", "gaze_text": "gaze", "gaze_prior": "gaze",
    "hands": "hand", "gesture": "hand",
    "geometry": "structured_geometry", "spatial": "structured_geometry", "spatial_context": "structured_geometry", "camera": "structured_geometry",
    "sparse_timeline": "timeline", "eye_timeline": "timeline",
}
NO_ABLATION = ("", "none", "full", "baseline")


def strict_points(c: Column | str) -> Column:
    """``parse_ok, invalid_reason, points`` of an answer; one bad ``points_3d`` entry rejects it, with the reason of the first one."""
    raw = F.col(c) if isinstance(c, str) else c
    empty = F.array().cast("array<struct<referent:string,point:struct<x:double,y:double,z:double>,confidence:double>>")

    def entry(item: Column) -> Column:
        """Fields of one entry, each JSON text read once."""
        return tx.let(F.from_json(item, "referent string, point string, confidence string"), lambda e: F.struct(
            F.startswith(F.ltrim(item), F.lit("{")).alias("is_object"), e["referent"].alias("referent"), e["confidence"].alias("given"),
            pl.json_number(e["confidence"]).alias("confidence"), F.transform(pl.json_items(e["point"]), pl.json_number).alias("xyz"),
        ))

    def problem(e: Column, i: Column) -> Column:
        why = (F.when(~e["is_object"], "not_object").when(e["xyz"].isNull(), "missing_point").when(F.size(e["xyz"]) != 3, "wrong_dimension")
               .when(F.exists(e["xyz"], lambda v: v.isNull()), "nonfinite_or_not_number")
               .when(e["given"].isNotNull() & e["confidence"].isNull(), "invalid_confidence"))
        return tx.let(why, lambda w: F.when(w.isNotNull(), F.concat(F.lit("point_entry_"), i.cast("string"), F.lit("_"), w)))

    def keep(e: Column) -> Column:
        point = F.struct(*[F.get(e["xyz"], i).alias(a) for i, a in enumerate("xyz")])
        return F.struct(F.left(F.coalesce(e["referent"], F.lit("")), F.lit(120)).alias("referent"), point.alias("point"),
                        tx.clamp(e["confidence"], 0.0, 1.0).alias("confidence"))

    def told(found: Column) -> Column:
        bad = F.get(F.filter(F.transform(found["e"], problem), lambda r: r.isNotNull()), 0)
        reason = (F.when(tx.norm_text(raw) == "", "empty_output").when(~found["valid"], "invalid_json")
                  .when(found["e"].isNull(), "missing_or_nonarray_points_3d").otherwise(F.coalesce(bad, F.lit(""))))
        return tx.let(reason, lambda r: F.struct((r == "").alias("parse_ok"), r.alias("invalid_reason"),
                                                 F.coalesce(F.when(r == "", F.transform(found["e"], keep)), empty).alias("points")))

    def read(j: Column) -> Column:
        items = F.transform(pl.json_items(pl.field(j, "points_3d")), entry)
        return F.struct((j.isNotNull() & F.try_parse_json(j).isNotNull()).alias("valid"), items.alias("e"))

    return tx.let(tx.let(pl.extract_json(raw), read), told)


def _with_fields(df: DataFrame, made: Column, names: Sequence[str]) -> DataFrame:
    d = df.withColumn("_made", made)
    for n in names:
        d = d.withColumn(n, F.col("_made")[n])
    return d.drop("_made")


def parse_points(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``strict_points`` as columns."""
    return _with_fields(df, strict_points(raw), ("invalid_reason", "parse_ok", "points"))


def reread_points(c: Column | str) -> Column:
    """Lenient re-read in evaluation: bad entries are skipped."""
    text = F.col(c) if isinstance(c, str) else c
    items = F.coalesce(pl.json_items(pl.field(text, "points_3d")), pl.json_items(text), F.array().cast("array<string>"))
    xyz = F.transform(items, lambda i: F.transform(pl.json_items(pl.field(i, "point")), pl.json_number))
    good = F.filter(xyz, lambda p: p.isNotNull() & (F.size(p) == 3) & ~F.exists(p, lambda v: v.isNull()))
    return F.transform(good, lambda p: F.struct(*[F.get(p, i).alias(a) for i, a in enumerate("xyz")]))


def parse_point(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Single ``point_3d`` given as a map or a list of three finite numbers."""
    d = df.withColumn("_j", pl.object_candidates(raw)).withColumn("_p", pl.field(F.col("_j"), "point_3d"))
    as_map = F.array(*[pl.field(F.col("_p"), a) for a in "xyz"])
    values = F.when(F.startswith("_p", F.lit("{")), as_map).otherwise(pl.json_items(F.col("_p")))
    d = d.withColumn("_v", values).withColumn("_n", F.transform("_v", pl.json_number))
    reason = (F.when(F.col("_j").isNull(), "no_json_object").when(F.col("_v").isNull(), "missing_point_3d")
              .when(F.size("_v") != 3, "point_3d_wrong_dimension")
              .when(F.exists("_n", lambda v: v.isNull()), "point_3d_nonfinite_or_not_number").otherwise(""))
    point = F.struct(*[F.get("_n", i).alias(a) for i, a in enumerate("xyz")])
    d = d.withColumn("invalid_reason", reason).withColumn("parse_ok", F.col("invalid_reason") == "")
    return d.withColumn("point", F.when(F.col("parse_ok"), point)).drop("_j", "_p", "_v", "_n")


def referents(c: Column | str) -> Column:
    """``parse_ok, referents`` of an answer, with normalised panel ids, unit gates, coordinate space and clamped confidence."""
    fields = ("mention", "panel_id", "coordinate_space", "point_source", "source", "space", "sheet_x_norm", "sheet_y_norm", "x_norm", "y_norm", "confidence")

    def entry(e: Column) -> Column:
        panel = tx.let(F.upper(tx.norm_text(e["panel_id"])), lambda p: F.when((p != "") & ~p.startswith("P"), F.concat(F.lit("P"), p)).otherwise(p))
        space = F.coalesce(*[F.nullif(e[n], F.lit("")) for n in ("coordinate_space", "point_source", "source", "space")])
        unit = [tx.let(tx.finite_double(e[n]), tx.unit_gate).alias(n) for n in ("sheet_x_norm", "sheet_y_norm", "x_norm", "y_norm")]
        return F.struct(
            tx.norm_text(e["mention"]).alias("mention"), panel.alias("panel_id"), tx.let(space, tx.coordinate_space).alias("coordinate_space"),
            *unit, tx.let(tx.finite_double(e["confidence"]), lambda c: tx.clamp(c, 0.0, 1.0)).alias("confidence"),
        )

    def read(j: Column) -> Column:
        items = F.coalesce(F.from_json(j, "referents array<string>")["referents"], F.array().cast("array<string>"))
        objects = F.transform(F.filter(items, lambda i: F.startswith(F.ltrim(i), F.lit("{"))),
                              lambda i: F.from_json(i, ", ".join(f"{f} string" for f in fields)))
        return F.struct(j.isNotNull().alias("parse_ok"), F.transform(objects, entry).alias("referents"))

    return tx.let(pl.object_candidates(c), read)


def parse_referents(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``referents`` as columns."""
    return _with_fields(df, referents(raw), ("parse_ok", "referents"))


def _names(c: Column) -> Column:
    """Names of a JSON list (texts or objects) or of a separated text."""
    def name(i: Column) -> Column:
        named = F.from_json(i, "object_name string, selected_object_name string")
        return F.when(F.startswith(F.ltrim(i), F.lit("{")), tx.let(named, lambda o: F.coalesce(F.nullif(o["object_name"], F.lit("")), o["selected_object_name"]))).otherwise(i)

    none = F.array().cast("array<string>")
    return tx.let(c, lambda t: F.when(t.isNull(), none).otherwise(F.coalesce(F.transform(pl.json_items(t), name), tx.split_names(t))))


_BOX = "struct<selected_object_names:string,selected_objects:string,selected_object_name:string>"
_ROW = "struct<object_name:string>"
_GENERATIONS = f"adjusted_response {_BOX}, parsed_response {_BOX}, resolved_object_rows array<{_ROW}>, resolved_object_row {_ROW}"


def collect_labels(c: Column | str) -> Column:
    """Ordered unique labels over the generations of the answer schema; the payload is read once."""
    def gather(p: Column) -> Column:
        parts = []
        for box in ("adjusted_response", "parsed_response"):
            parts += [_names(p[box]["selected_object_names"]), _names(p[box]["selected_objects"]), F.array(p[box]["selected_object_name"])]
        rows = F.coalesce(p["resolved_object_rows"]["object_name"], F.array().cast("array<string>"))
        return F.concat(*parts, rows, F.array(p["resolved_object_row"]["object_name"]))

    text = F.col(c) if isinstance(c, str) else c
    return tx.unique_by_key(tx.let(F.from_json(text, _GENERATIONS), gather))


def validate_selection(df: DataFrame, aliases: DataFrame, keys: Sequence[str], names: str = "names") -> DataFrame:
    """Check selected names against the inventory: status, resolved names in order and warnings.

    ``df`` has ``scene, referent_type, primary_source, note`` and the selected names of the answer.
    """
    keys = list(keys)
    exact = small_side(aliases.select("scene", F.lower("alias").alias("_k"), "anchor_id", "anchor_seq"))
    exact = exact.groupBy("scene", "_k").agg(F.min_by("anchor_id", "anchor_seq").alias("anchor_id"))
    flat = df.select(*dict.fromkeys([*keys, "scene"]), F.posexplode(names).alias("_pos", "_name")).withColumn("_k", F.lower("_name"))
    hit = flat.join(exact, ["scene", "_k"], "left")
    first = F.min(F.when(F.col("anchor_id").isNotNull(), F.col("_pos")))
    per = hit.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("anchor_id").isNull(), F.struct("_pos", "_name")))).alias("_bad"),
        F.array_sort(F.collect_list(F.when(F.col("anchor_id").isNotNull(), F.struct("_pos", "anchor_id")))).alias("_good"), first.alias("_first"),
    )
    out = df.join(per, keys, "left")
    bad, good = F.coalesce(F.size("_bad"), F.lit(0)), F.coalesce(F.size("_good"), F.lit(0))
    bad, good = F.greatest(bad, F.lit(0)), F.greatest(good, F.lit(0))
    none = (F.col("referent_type") == "none") | (F.col("primary_source") == "none")
    known = (F.col("primary_source") == "") | F.col("primary_source").isin(*SELECTION_SOURCES)
    n = F.size(names)
    status = (F.when(none & ~known, "inconsistent_source").when(none, F.when(F.col("referent_type") != "", "ok").otherwise("incomplete"))
              .when((bad > 0) & (good == 0), "invalid_object_name").when(bad > 0, "partial_invalid_object_name")
              .when((F.col("primary_source") == "gazePoint") & (n == 0), "incomplete").when(~known, "inconsistent_source")
              .when(F.col("referent_type") != "", "ok").otherwise("incomplete"))
    unexplained = ~F.lower("note").rlike("gaze|unreliable|invisible|inconsistent")
    warnings = F.concat(
        F.array_compact(F.array(
            F.when(~known, F.concat(F.lit("invalid_primary_source:"), F.col("primary_source"))),
            F.when(~none & (F.col("primary_source") == "gazePoint") & (n == 0), F.lit("gazePoint_requires_selected_object_names")),
        )),
        F.when(none | F.col("_bad").isNull(), F.array().cast("array<string>")).otherwise(
            F.transform("_bad", lambda b: F.concat(F.lit("invalid_object_name:"), b["_name"]))),
        F.array_compact(F.array(F.when(~none & (F.col("primary_source") == "visual_only") & unexplained, F.lit("visual_only_missing_gaze_unreliability_note")))),
    )
    resolved = F.when(none, F.array().cast("array<string>")).otherwise(F.array_distinct(F.coalesce(F.col("_good")["anchor_id"], F.array().cast("array<string>"))))
    return out.withColumn("response_status", status).withColumn("warnings", warnings).withColumn("resolved", resolved).drop("_bad", "_good", "_first")


def missing_fields(c: Column | str, required: Sequence[str]) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    have = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(r) for r in required]), have)


def validate_response(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Keyframe answer: enumerations, consistency of *none*, unit clamps; invalid answers give a NULL struct."""
    d = df.withColumn("_j", pl.object_candidates(raw))
    j = F.col("_j")
    kind, source, prior = F.lower(tx.norm_text(pl.field(j, "referent_type"))), tx.norm_text(pl.field(j, "primary_source")), tx.norm_text(pl.field(j, "prior_usage"))
    none = kind == "none"

    def unit(name: str) -> Column:
        return tx.clamp(tx.finite_double(pl.field(j, name)), 0.0, 1.0)

    def broken(name: str) -> Column:
        """A given value that is neither a marker of absence nor a finite number."""
        text = pl.field(j, name)
        return text.isNotNull() & ~text.isin("", "null", "None") & tx.finite_double(text).isNull()

    ok = (kind.isin(*REFERENT_TYPES) & source.isin(*PRIMARY_SOURCES) & prior.isin(*PRIOR_USAGE) & unit("confidence").isNotNull()
          & ~broken("u_norm") & ~broken("v_norm")
          & F.when(none, (source == "none") & (prior == "no_prior")).otherwise((source != "none") & unit("u_norm").isNotNull() & unit("v_norm").isNotNull()))
    parsed = F.struct(
        kind.alias("referent_type"), source.alias("primary_source"), prior.alias("prior_usage"),
        F.when(~none, unit("u_norm")).alias("u_norm"), F.when(~none, unit("v_norm")).alias("v_norm"), unit("confidence").alias("confidence"),
    )
    return d.withColumn("response", F.when(F.coalesce(ok, F.lit(False)), parsed)).drop("_j")


def override_with_prior(u: Column, v: Column, prior_u: Column, prior_v: Column, prior_source: Column, referent_type: Column, mode: str) -> tuple[Column, Column]:
    """Replace predicted (u, v) by the gaze prior unless the mode trusts the model."""
    use = F.lit(mode != "model") & (prior_source == "gazePoint") & prior_u.isNotNull() & prior_v.isNotNull() & (referent_type != "none")
    return F.when(use, prior_u).otherwise(u), F.when(use, prior_v).otherwise(v)


def squeezed(text: Column) -> Column:
    """Lower-case text without the blanks, underscores and hyphens between letters, so that every spelling of a name is one."""
    return F.regexp_replace(F.lower(text), r"(?<=[a-z])[\s_-]+(?=[a-z])", "")


def named_number(text: Column, names: Sequence[str]) -> Column:
    """The number that follows the first of ``names`` (squeezed spelling) and a colon or equals sign."""
    return F.regexp_extract(squeezed(text), f"(?:{'|'.join(names)})" + r'\s*[:=]\s*"?(\d+(?:\.\d+)?)', 1).try_cast("double")


def panel_mentions(text: Column) -> Column:
    """Distinct panel ids named anywhere in the text, upper-case, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[Pp]\d+"), F.lit(0)), F.upper))


def peak_time(df: DataFrame, raw: str = "raw", fallback: str = "midpoint") -> DataFrame:
    """Peak seconds of an answer: JSON field, else a number recovered from the text, else the fallback; kept inside the event.

    ``candidate_panel_ids`` are those of the JSON, else all panels that the text names; ``panel_id`` is the named one, else the first.
    """
    d = df.withColumn("_j", pl.object_candidates(raw))
    j, text = F.col("_j"), F.col(raw)
    names = ("primary_panel_timestamp_seconds", "panel_timestamp_seconds", "peak_time_seconds")
    t_json = F.coalesce(*[tx.finite_double(pl.field(j, n)) for n in names])
    c_json = tx.finite_double(pl.field(j, "confidence"))
    ok_json = t_json.isNotNull() & c_json.isNotNull()
    t_text = named_number(text, ("paneltimestampseconds", "peaktimeseconds"))
    c_text = F.coalesce(named_number(text, ("confidence",)), F.lit(0.5))
    lo, hi = F.col("t_start"), F.col("t_end")
    back = {"t_start": lo, "t_end": hi, "midpoint": lo + F.greatest(F.lit(0.0), hi - lo) / 2.0, "disable": F.lit(None).cast("double")}[fallback]
    how = F.when(ok_json, "json").when(t_text.isNotNull(), "text").otherwise("fallback")
    d = d.withColumn("peak_source", how)
    src = F.col("peak_source")
    peak = F.when(src == "json", tx.clamp(t_json, lo, hi)).when(src == "text", tx.clamp(t_text, lo, hi)).otherwise(back)
    conf = F.when(src == "json", tx.clamp(c_json, 0.0, 1.0)).when(src == "text", tx.clamp(c_text, 0.0, 1.0)).otherwise(
        F.lit(None if fallback == "disable" else 0.0).cast("double"))
    d = d.withColumn("peak_seconds", peak).withColumn("confidence", conf).withColumn("parse_ok", src != "fallback")
    named = F.upper(tx.norm_text(F.coalesce(pl.field(j, "primary_panel_id"), pl.field(j, "panel_id"))))
    listed = F.from_json(pl.field(j, "candidate_panel_ids"), "array<string>")
    listed = F.filter(F.transform(listed, lambda p: F.upper(tx.norm_text(p))), lambda p: p != "")
    found = panel_mentions(text)
    stated = F.regexp_extract(squeezed(text), r'panelid\s*[:=]\s*"?(p\d+)', 1)
    of_text = F.when(stated != "", F.upper(stated)).when(src == "fallback", F.get(found, 0))
    none = F.array().cast("array<string>")
    d = d.withColumn("panel_id", F.when(src == "json", F.nullif(named, F.lit(""))).otherwise(of_text))
    return d.withColumn("candidate_panel_ids", F.coalesce(F.when(src == "json", listed).otherwise(found), none)).drop("_j")


def batch_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of ok / none / warned answers and the mean confidence."""
    return df.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("response").isNotNull()).alias("ok_count"),
        F.count_if(F.col("response.referent_type") == "none").alias("none_count"),
        F.count_if(F.size("warnings") > 0).alias("warning_count"), F.avg("response.confidence").alias("mean_confidence"),
    )


def flatten_answers(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, "response.*", F.concat_ws("; ", "warnings").alias("warnings"))


def parse_modalities(c: Column | str) -> tuple[Column, Column]:
    """Ablated modalities of a free list and the names that are not known."""
    text = F.lower(tx.norm_text(c))
    tokens = F.when(text.isin(*NO_ABLATION), F.array().cast("array<string>")).otherwise(
        F.filter(F.split(text, r"[,;\s]+"), lambda t: t != ""))
    table = F.create_map(*[F.lit(x) for kv in MODALITY_ALIASES.items() for x in kv])
    named = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))
    known = F.array(*[F.lit(m) for m in MODALITIES])
    return F.array_sort(F.array_intersect(named, known)), F.array_sort(F.array_except(named, known))


def fan_out(df: DataFrame, variants: DataFrame) -> DataFrame:
    """Every row once per variant; the variant table is a handful of rows."""
    return df.crossJoin(small_side(variants, 1000))
