"""Shared helpers: bounded Arrow batches, tables in the shared folder, connected components, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 256
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a session without that setting gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, readable after executors are lost."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches, so that a batch of very long texts still fits a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; every other column is left behind."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser over uint64 arrays (wraps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LONG = 1024


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs without ASCII white space) in an array of bytes."""
    edge = np.diff(np.concatenate(([1], _SPACE[b].astype(np.int8), [1])))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: bytes) -> np.ndarray:
    """A uint64 per word, from its length and its bytes, eight at a time for all words at once."""
    start, end = word_bounds(np.frombuffer(data, np.uint8))
    length = end - start
    out = length.astype(np.uint64) * _MUL
    if not len(start):
        return out
    padded = data + bytes(8)
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    alive, at = np.flatnonzero(length <= _LONG), 0
    while len(alive):
        left = length[alive] - at
        out[alive] = (out[alive] ^ mix64(eight[start[alive] + at] & _KEEP[np.minimum(left, 8)])) * _MUL
        alive, at = alive[left > 8], at + 8
    for i in np.flatnonzero(length > _LONG):
        out[i] = np.uint64(xxhash.xxh64_intdigest(data[start[i] : end[i]]))
    return mix64(out)


def word_hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    """``word_hashes`` of every text, computed together so that short texts cost no calls of their own."""
    joined = b" ".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, _ = word_bounds(np.frombuffer(joined, np.uint8))
    return np.split(word_hashes(joined), np.searchsorted(starts, ends[:-1])) if texts else []


def shingle_hashes(data: bytes, k: int) -> np.ndarray:
    """uint64 hashes of the k-word shingles; of the whole sequence if there are fewer words; none without words."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = max(len(w) - k + 1, 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(w))):
        out = out * _MUL + w[i : i + n]
    return mix64(out)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root): the smallest vertex reachable over ``edges`` (a, b), for every vertex that has an edge.

    Alternates large-star and small-star; each round is one aggregation and one join and is written to the
    shared folder. Isolated vertices are not listed.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = written(edges.select(*pair(F.col("a"), F.col("b"))).filter("a <> b").distinct())
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = sign(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large.select(*pair(F.col("a"), F.col("b"))))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), "m"), F.struct(F.col("b").alias("x"), "m"))).alias("e"))
        edges = written(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())
        now = sign(edges)
        if now == before:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")
