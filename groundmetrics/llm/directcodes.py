"""Token ids as directly addressable codes: any id can be read without decoding its neighbours.

An id is cut into chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that has one; a bitmap says of
each chunk whether its id goes on, and a rank directory counts the set bits before every 512th, so that the place of an id on
the next level is one directory entry and at most eight popcounts away.

A file is a row of shards, each followed by one zero byte; a shard describes itself:

    magic "DAC1", uint32 levels, uint64 ids, uint64 documents, uint64 shard number, uint64 bytes of the shard
    per level: uint64 chunks
    documents: int64 doc_id, uint8 is-null, uint64 end (ids of the shard up to and with this document)
    per level: uint8 chunks; but for the last level: uint64 bitmap words, uint64 rank directory

All parts are little-endian and padded to eight bytes. Shard numbers ascend with doc_id: the partition in the upper bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmetrics.llm.common import documents, map_batches
from groundmetrics.llm.tokens import Encoder, read_tokenizer

SHARD_IDS, SHARDS_PER_FILE, BLOCK_WORDS = 1 << 18, 64, 8
_HEAD = "<4sIQQQQ"


def _padded(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() + bytes(-a.nbytes % 8) for a in arrays]


def _bitmap(go_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, rank directory) of a boolean array."""
    bits = np.packbits(go_on, bitorder="little")
    words = np.frombuffer(bits.tobytes() + bytes(-len(bits) % 8), "<u8")
    counts = np.bitwise_count(words).astype(np.uint64)
    starts = np.arange(0, len(words), BLOCK_WORDS)
    ahead = np.concatenate(([0], np.cumsum(counts)))[starts].astype("<u8")
    return words, ahead


def encode_shard(number: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A shard of whole documents, in the given order."""
    flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype("<u4")
    levels, rest = [], flat
    while True:
        chunk, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        go_on = rest > 0
        levels.append((chunk, go_on))
        if not go_on.any():
            break
        rest = rest[go_on]
    parts = _padded(np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), np.cumsum([len(i) for i in ids]).astype("<u8"))
    for k, (chunk, go_on) in enumerate(levels):
        parts += _padded(chunk) + (_padded(*_bitmap(go_on)) if k + 1 < len(levels) else [])
    sizes = np.array([len(c) for c, _ in levels], "<u8").tobytes()
    body = b"".join(parts)
    return struct.pack(_HEAD, b"DAC1", len(levels), len(flat), len(ids), number, struct.calcsize(_HEAD) + len(sizes) + len(body)) + sizes + body


class Shard:
    """Reads a shard in place. ``at`` gives ids at any positions, ``all`` decodes everything, ``document`` one document."""

    def __init__(self, data, offset: int = 0):
        magic, n_levels, self.n_ids, self.n_docs, self.number, self.length = struct.unpack_from(_HEAD, data, offset)
        if magic != b"DAC1":
            raise ValueError("no shard where one must start")
        at = offset + struct.calcsize(_HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes + -out.nbytes % 8
            return out

        sizes = [int(n) for n in take("<u8", n_levels)]
        raw, null, self.ends = take("<i8", self.n_docs), take(np.uint8, self.n_docs), take("<u8", self.n_docs).astype(np.int64)
        self.doc_ids = [None if z else int(d) for d, z in zip(raw, null, strict=True)]
        self.levels = []
        for k, n in enumerate(sizes):
            chunk = take(np.uint8, n)
            words = -(-n // 64)
            self.levels.append((chunk, take("<u8", words), take("<u8", -(-words // BLOCK_WORDS))) if k + 1 < n_levels else (chunk, None, None))
        if at != offset + self.length:
            raise ValueError("truncated shard")

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The ids at ``positions``: per level one chunk, one bit and one rank each."""
        place, rows = np.asarray(positions, np.int64), np.arange(len(positions))
        if len(place) and not (0 <= place.min() and place.max() < self.n_ids):
            raise IndexError("no id at this position")
        out = np.zeros(len(place), np.uint32)
        for k, (chunk, words, ahead) in enumerate(self.levels):
            out[rows] |= chunk[place].astype(np.uint32) << np.uint32(8 * k)
            if words is None or not len(rows):
                break
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            go_on = (words[word] >> bit) & np.uint64(1) == 1
            rows, word, bit = rows[go_on], word[go_on], bit[go_on]
            block = word // BLOCK_WORDS
            near = block[:, None] * BLOCK_WORDS + np.arange(BLOCK_WORDS)
            counts = np.bitwise_count(words[np.minimum(near, len(words) - 1)]) * (near < word[:, None])
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            place = ahead[block].astype(np.int64) + counts.sum(axis=1, dtype=np.int64) + below
        return out

    def all(self) -> np.ndarray:
        """Every id of the shard, a level at a time from the last."""
        above = np.zeros(0, np.uint32)
        for chunk, words, _ in reversed(self.levels):
            out = chunk.astype(np.uint32)
            if words is not None:
                go_on = np.unpackbits(words.view(np.uint8), count=len(chunk), bitorder="little").astype(bool)
                out[go_on] |= above << np.uint32(8)
            above = out
        return above

    def document(self, i: int) -> np.ndarray:
        return self.at(np.arange(self.ends[i - 1] if i else 0, self.ends[i]))


def shards_of(data):
    """(offset, shard) of a file, from its headers."""
    at = 0
    while at < len(data):
        shard = Shard(data, at)
        yield at, shard
        at += shard.length + 1


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int) -> None:
    """Encodes every document, appends ``end_id`` and writes files in ascending doc_id order (null ids first).

    A null text is empty: its only id is ``end_id``. Repeated ids are written as often as they occur, shorter texts first; the
    row's place in the input breaks further ties, so that an id with very many rows is dealt to several tasks. Documents are never
    cut: a shard closes after SHARD_IDS ids. An empty table leaves no shard. Other columns are not read.
    """
    source = read_tokenizer(tokenizer_path)
    rows = documents(docs).withColumn("_len", F.length("text")).withColumn("_at", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_len"), F.col("_at")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, number = Encoder.shared(source), TaskContext.get().partitionId() << 32
        keys, ids, held = [], [], 0

        def close():
            nonlocal number, keys, ids, held
            out = pa.RecordBatch.from_arrays([pa.array([encode_shard(number, keys, ids)], pa.binary())], ["value"])
            number, keys, ids, held = number + 1, [], [], 0
            return out

        for b in batches:
            coded = encoder.encode(b.column("text").to_pylist())
            for key, code in zip(b.column("doc_id").to_pylist(), coded, strict=True):
                keys.append(key)
                ids.append(np.frombuffer(code + end, "<u4"))
                held += len(ids[-1])
                if held >= SHARD_IDS:
                    yield close()
        if keys:
            yield close()

    shards = map_batches(rows, run, "value binary").select(F.col("value").cast("string").alias("value"))
    shards.write.option("lineSep", "\0").option("maxRecordsPerFile", SHARDS_PER_FILE).text(f"{folder}/data")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document from the headers alone, no id is decoded: doc_id, shard, doc_no, first (ids of the shard before it),
    n_tokens, file, offset and shard_ids (of its shard)."""
    names = ["doc_id", "shard", "doc_no", "first", "n_tokens", "file", "offset", "shard_ids"]

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for at, s in shards_of(memoryview(content.as_buffer())):
                    n = s.n_docs
                    first = np.concatenate(([0], s.ends[:-1]))
                    cols = [s.doc_ids, [s.number] * n, range(n), first, s.ends - first, [path] * n, [at] * n, [s.n_ids] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "file" else pa.int64()) for c, k in zip(cols, names, strict=True)], names)

    return map_batches(_files(spark, folder).select("path", "content"), run, ", ".join(f"{n} {'string' if n == 'file' else 'long'}" for n in names))


def shard_starts(docs: DataFrame) -> DataFrame:
    """(shard, start): the ids of all shards before each. Sums run within partitions first; one row per partition is ordered alone."""
    shards = docs.filter("doc_no = 0").select("shard", "shard_ids", F.shiftright("shard", 32).alias("part"))
    parts = shards.groupBy("part").agg(F.sum("shard_ids").alias("n"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before("n", W.orderBy("part")).alias("_base"))
    inside = shards.withColumn("_inside", before("shard_ids", W.partitionBy("part").orderBy("shard")))
    return inside.join(parts, "part").select("shard", (F.col("_base") + F.col("_inside")).alias("start"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its decoded ids."""
    names = ["doc_id", "shard", "first", "n_tokens", "ids_crc32"]

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                for _, s in shards_of(memoryview(content.as_buffer())):
                    data, first = s.all().astype("<u4").tobytes(), np.concatenate(([0], s.ends[:-1]))
                    crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(first.tolist(), s.ends.tolist(), strict=True)]
                    cols = [s.doc_ids, [s.number] * s.n_docs, first, s.ends - first, crc]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    read = map_batches(_files(spark, folder).select("content"), run, ", ".join(f"{n} long" for n in names))
    both = read.join(shard_starts(index(spark, folder)), "shard")
    return both.select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Random access: ``wanted`` (doc_id, position) to (doc_id, position, token_id), by rank directories, without decoding blocks.

    Positions outside a document give no row; a null doc_id finds documents with a null id; a repeated doc_id gives a row for each.
    """
    w, d = wanted.select("doc_id", "position").distinct(), index(spark, folder).drop("shard", "shard_ids")
    hit = w.join(d.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("position").between(0, F.col("n_tokens") - 1))
    at = hit.select("file", F.struct("doc_id", "position", "offset", (F.col("first") + F.col("position")).alias("place")).alias("x"))
    files = _files(spark, folder).select(F.col("path").alias("file"), "content")
    # A group is at most the 65,536 places of one stretch of a shard, whatever is asked for.
    at = at.groupBy("file", "x.offset", F.shiftright("x.place", 16)).agg(F.collect_list("x").alias("at")).select("file", "at")

    def run(batches):
        names = ["doc_id", "position", "token_id"]
        for b in batches:
            for content, at in zip(b.column("content"), b.column("at").to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                got = Shard(data, at[0]["offset"]).at(np.array([x["place"] for x in at]))
                cols = [[x["doc_id"] for x in at], [x["position"] for x in at], got.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return map_batches(files.join(at, "file").select("content", "at"), run, "doc_id long, position long, token_id long")
