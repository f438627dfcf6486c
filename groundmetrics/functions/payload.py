"""JSON payloads inside free text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundmetrics.functions import text as tx


def extract_json(c: Column | str) -> Column:
    """First ``{...}`` with matching braces; braces inside JSON strings do not count, NULL when they never match.

    The text from the first brace on is cut into strings, braces and the rest, and one fold counts the depth.
    """
    text = F.col(c) if isinstance(c, str) else c
    tokens = F.regexp_extract_all(F.regexp_extract(text, r"(?s)\{.*", 0), F.lit(r'(?s)"[^"\\]*+(?:\\.?[^"\\]*+)*+(?:"|\z)|[{}]|[^"{}]++'), F.lit(0))
    state = lambda depth, n: F.struct(depth.cast("int").alias("depth"), n.cast("int").alias("n"))

    def step(acc: Column, token: Column) -> Column:
        change = F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        return F.when((acc["depth"] == 0) & (acc["n"] > 0), acc).otherwise(state(acc["depth"] + change, acc["n"] + 1))

    def first(parts: Column) -> Column:
        return tx.let(F.aggregate(parts, state(F.lit(0), F.lit(0)), step),
                      lambda end: F.when((end["depth"] == 0) & (end["n"] > 0), F.array_join(F.slice(parts, 1, end["n"]), "")))

    return tx.let(tokens, first)


def relaxed_json(c: Column) -> Column:
    """Drop fences, line comments outside strings and trailing commas."""
    bare = F.regexp_replace(F.regexp_replace(tx.strip(c), r"^```(?:json)?", ""), r"```$", "")
    plain = F.regexp_replace(bare, r'("(?:[^"\\]++|\\.)*+")|//[^\r\n]*', "$1")
    return tx.strip(F.regexp_replace(plain, r",\s*([}\]])", "$1"))


def is_object(c: Column) -> Column:
    """Valid JSON whose top level is an object."""
    return F.coalesce(F.try_parse_json(c).isNotNull() & F.startswith(c, F.lit("{")), F.lit(False))


def object_candidates(c: Column | str) -> Column:
    """First JSON object of an answer: the whole text, each fenced block in turn, the outermost braces."""
    text = F.col(c) if isinstance(c, str) else c
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tried = F.transform(F.concat(F.array(text), fenced, F.array(braces)), relaxed_json)
    return F.get(F.filter(tried, is_object), 0)


def canonical_json(c: Column | str, list_key: str | None = None) -> Column:
    """One spelling of a JSON payload: keys sorted at every level, blanks and escapes settled, ``2.0`` and ``5e-1`` as ``2`` and ``0.5``.

    With ``list_key`` a bare list stands for an object with that key, and what is no JSON (null, empty and
    repeated keys included) for an empty list; without it such payloads are NULL.
    """
    text = F.to_json(F.try_parse_json(F.col(c) if isinstance(c, str) else c))
    # whole strings are matched first and kept; only digits outside them lose a zero fraction
    text = F.regexp_replace(text, r'("(?:[^"\\]++|\\.)*+")|(?<=\d)\.0+(?!\d)', "$1")
    if list_key is None:
        return text
    wrapped = tx.let(text, lambda t: F.when(F.startswith(t, F.lit("[")), F.concat(F.lit('{"' + list_key + '":'), t, F.lit("}"))).otherwise(t))
    return F.coalesce(wrapped, F.lit('{"' + list_key + '":[]}'))


def field(c: Column, name: str) -> Column:
    return F.get_json_object(c, f"$.{name}")


def json_items(c: Column) -> Column:
    """Elements of a JSON array text, each as text; NULL when it is not an array."""
    return tx.let(c, lambda t: F.when(F.startswith(F.ltrim(t), F.lit("[")), F.from_json(t, "array<string>")))


def json_number(c: Column) -> Column:
    """Finite number from a JSON scalar; booleans and words are not numbers."""
    return tx.finite_double(c)
