"""Sinks: fixed-column tables, nested JSON, Markdown reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(df: DataFrame, name: str, missing: str) -> Column:
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(missing).alias(name)
    c = F.col(name)
    if kind in ("double", "float"):
        return F.coalesce(F.when(~F.isnan(c), F.format_string("%.10f", c)), F.lit(missing)).alias(name)
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.to_json(c), F.lit(missing)).alias(name)
    if kind == "boolean":
        return F.coalesce(F.initcap(c.cast("string")), F.lit(missing)).alias(name)
    return F.coalesce(c.cast("string"), F.lit(missing)).alias(name)


def write_table(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "csv", missing: str = "", by_scene: bool = False) -> None:
    """Fixed column order; absent columns and NULLs become ``missing``, extra columns are dropped."""
    if fmt == "csv":
        out = df.select(*[_cell(df, c, missing) for c in columns])
    else:
        out = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    writer = out.write.mode("overwrite")
    if by_scene and "scene" in columns:
        writer = writer.partitionBy("scene")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_json(df: DataFrame, path: str, by_scene: bool = False) -> None:
    """Nested rows as one JSON-lines dataset instead of one file per row."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("scene") if by_scene else writer).json(path)


def to_markdown(summary: DataFrame, columns: Sequence[str], digits: int = 4, limit: int = 10_000) -> str:
    """Markdown table of an aggregated summary; lines are built in Spark, only they reach the driver."""
    kinds = dict(summary.dtypes)
    cells = [
        F.coalesce(F.format_number(c, digits) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("-")) for c in columns
    ]
    lines = summary.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).limit(limit + 1).collect()
    if len(lines) > limit:
        raise ValueError(f"more than {limit} summary rows: write a table instead")
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(head + [r["line"] for r in lines])
