"""Text, number, label, path and timestamp expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens read as "missing", deictic words, label rewrites and coordinate-space names.
MISSING_TOKENS = ("", "nan", "null", "none", "na")
DEICTIC_WORDS = (
    "this", "that", "these", "those", "there", "here",
    "target", "selected", "current", "intended", "one", "it",
)
LABEL_REWRITES = {"fork": "forklift", "direct": "truck"}
CROP_SPACES = ("crop", "gaze_crop", "right_crop", "zoom", "zoom_crop", "cropped")
FULL_SPACES = ("full", "full_panel", "left_full", "left_panel", "panel", "image")

_SPLITTERS = {"alias": r"[,;/|]+", "name": r"[,;|]", "gt": r","}
_BLANKS = " \t\n\r\x0b\x0c"
_PHRASE_EDGE = " .,:;\"'"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind a value inside an expression, so that it is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column | str) -> Column:
    return F.btrim(_c(c).cast("string"), F.lit(_BLANKS))


def norm_text(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def is_missing(c: Column | str) -> Column:
    return F.lower(norm_text(c)).isin(*MISSING_TOKENS)


def finite_double(c: Column | str) -> Column:
    """Number or NULL; NaN and infinities count as missing."""
    value = strip(c).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)  # NaN sorts above infinity


def finite_int(c: Column | str, lenient: bool = False) -> Column:
    """Strict integer text, or with ``lenient`` the truncated number with 0 for anything else."""
    if lenient:
        return F.coalesce(finite_double(c).try_cast("bigint"), F.lit(0).cast("bigint"))
    text = strip(c)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def as_bool(c: Column | str, accepted: Sequence[str] = ("true",)) -> Column:
    return F.lower(norm_text(c)).isin(*accepted)


def label_key(c: Column | str, mode: str = "match") -> Column:
    """``match`` drops blanks, underscores and hyphens; ``alnum`` keeps letters and digits only."""
    pattern = r"[\s_\-]+" if mode == "match" else r"[^\p{L}\p{N}]+"
    return F.regexp_replace(F.lower(norm_text(c)), pattern, "")


def split_names(c: Column | str, mode: str = "alias") -> Column:
    parts = F.transform(F.split(norm_text(c), _SPLITTERS[mode]), lambda p: strip(p))
    return F.filter(parts, lambda p: p != "")


def unique_by_key(arr: Column | str, mode: str = "match") -> Column:
    """Keep the first spelling of each label key of a short cell, in order; blanks are dropped."""
    names = F.filter(F.transform(_c(arr), norm_text), lambda n: n != "")
    pairs = F.transform(names, lambda n: F.struct(n.alias("name"), label_key(n, mode).alias("key")))
    return let(pairs, lambda ps: F.filter(ps, lambda p, i: F.array_position(ps["key"], p["key"]) == i + 1))["name"]


def fallback_label_key(key: Column) -> Column:
    """Rewrite ``<old><number>`` keys of retired label families; NULL when no rule applies."""
    out = F.lit(None).cast("string")
    for old, new in LABEL_REWRITES.items():
        hit = F.regexp_extract(key, rf"^{old}(\d+)$", 1)
        out = F.when(hit != "", F.concat(F.lit(new), hit)).otherwise(out)
    return out


def trim_fraction(c: Column | str) -> Column:
    """Cut fractional seconds to microseconds."""
    return F.regexp_replace(norm_text(c), r"(\.\d{6})\d+", "$1")


def parse_iso(c: Column | str) -> Column:
    return F.try_to_timestamp(trim_fraction(c))


def filename_ts(c: Column | str) -> Column:
    """Capture start encoded in a recording's file name, in the session time zone."""
    pattern = r"ScreenRecord_(\d{4}-\d{2}-\d{2})-(\d{2})_(\d{2})_(\d{2})"
    name = _c(c)
    parts = [F.regexp_extract(name, pattern, i) for i in range(1, 5)]
    stamp = F.concat(parts[0], F.lit(" "), F.concat_ws(":", *parts[1:]))
    return F.when(parts[0] != "", F.try_to_timestamp(stamp))


def rewrite_path(c: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Replace the first matching prefix."""
    path = _c(c)
    out = path
    for old, new in reversed(list(rules)):
        out = F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(out)
    return out


def sanitize_token(c: Column | str) -> Column:
    cleaned = F.regexp_replace(norm_text(c), r"[^A-Za-z0-9._-]+", "_")
    return F.regexp_replace(cleaned, r"^_+|_+$", "")


def render_template(template: str, columns: Mapping[str, Column | str]) -> Column:
    """Fill ``{name}`` slots of a template from columns."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), norm_text(value))
    return out


def _strip_edges(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(_PHRASE_EDGE))


def clean_phrase(mention: Column | str, instruction: Column | str, strip_deictic: bool = True) -> Column:
    """Detector phrase: first non-empty text, separators to blanks, deictic words out, closing dot."""
    first = F.coalesce(F.nullif(norm_text(mention), F.lit("")), norm_text(instruction))
    phrase = _strip_edges(F.translate(first, "_-", "  "))
    if strip_deictic:
        words = r"(?iU)\b(" + "|".join(DEICTIC_WORDS) + r")\b"
        bare = _strip_edges(F.regexp_replace(phrase, words, " "))
        phrase = F.when(bare != "", bare).otherwise(phrase)
    raw = F.coalesce(F.nullif(norm_text(mention), F.lit("")), F.nullif(norm_text(instruction), F.lit("")), F.lit("object"))
    phrase = F.lower(F.when(phrase != "", phrase).otherwise(raw))
    return F.when(phrase.endswith("."), phrase).otherwise(F.concat(phrase, F.lit(".")))


def compress_text(c: Column | str, n: int) -> Column:
    """Collapse blanks and cut to ``n`` characters including the ellipsis."""
    flat = F.trim(F.regexp_replace(norm_text(c), r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(n - 3))), F.lit("...")))


def drop_lines(c: Column | str, terms: Sequence[str]) -> Column:
    """Drop lines that contain any blocked term (case-insensitive)."""
    lines = F.split(norm_text(c), "\n")
    kept = F.filter(lines, lambda line: ~F.greatest(F.lit(False), *[F.contains(F.lower(line), F.lit(t.lower())) for t in terms]))
    return F.concat_ws("\n", kept)


def representative(arr: Column | str, k: int) -> Column:
    """``k`` evenly spread elements (half-even rounding of positions), repeated at the end if few."""
    a = _c(arr)
    n = F.size(a)
    if k <= 1:
        picked = F.slice(a, F.floor(n / 2).cast("int") + 1, 1)
    else:
        step = (n - 1) / F.lit(float(k - 1))
        pos = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(step * i).cast("int")))
        picked = F.transform(pos, lambda p: F.get(a, p))
        last = F.get(a, n - 1)
        picked = F.concat(picked, F.array_repeat(last, F.lit(k) - F.size(pos)))
    return F.when(n <= k, a).otherwise(picked)


def coordinate_space(c: Column | str) -> Column:
    name = F.translate(F.lower(norm_text(c)), "- ", "__")
    return F.when(name.isin(*CROP_SPACES), "gaze_crop").when(name.isin(*FULL_SPACES), "full_panel").otherwise("")


def unit_gate(c: Column | str) -> Column:
    """Keep values of [0, 1], NULL otherwise."""
    value = _c(c)
    return F.when(value.between(0.0, 1.0), value)


def clamp(c: Column | str, low: Column | float, high: Column | float) -> Column:
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    value = _c(c)
    return F.when(value.isNotNull(), F.greatest(lo, F.least(hi, value)))
