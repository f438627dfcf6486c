"""Bottom-k sketches of word shingles: mergeable, with resemblance, containment and distinct-count estimates.

A sketch is the sorted array of the k smallest distinct shingle hashes; shorter sketches are complete sets, for which
every estimate is exact. ``merge`` of the sketches of two parts is the sketch of their union.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundmetrics.llm.common import documents, map_batches, shingle_hashes, written

K, WORDS = 256, 5


def sketch(text: str | bytes, k: int = K, words: int = WORDS) -> np.ndarray:
    data = text if isinstance(text, bytes) else text.encode()
    h = np.unique(shingle_hashes(data, words)) if len(data) < 1 << 22 else _long(data, k, words)
    return h[:k]


def _long(data: bytes, k: int, words: int) -> np.ndarray:
    """Very long texts: the sketch of pieces that overlap by ``words`` - 1 words, merged."""
    parts = data.split()
    out, step = np.empty(0, np.uint64), 1 << 18
    for i in range(0, max(len(parts) - words + 1, 1), step):
        out = merge(out, np.unique(shingle_hashes(b" ".join(parts[i : i + step + words - 1]), words))[:k], k)
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard resemblance; two empty sketches are alike (1.0)."""
    low = merge(a, b, k)
    if not len(low):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(low, both, assume_unique=True).mean())


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1.0 if ``a`` is empty."""
    n = distinct(a, k)
    if not n:
        return 1.0
    union = distinct(merge(a, b, k), k)
    return float(min(1.0, max(0.0, resemblance(a, b, k) * union / n)))


def encoded(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def with_next(docs: DataFrame, bits: int = 10) -> DataFrame:
    """(doc_id, text, next_text): the text of the row with the next smaller doc_id, after the last that of the first.

    Ids are cut into buckets of 2**bits; each bucket also gets a copy of the first row of the bucket that follows, so
    the window never spans more than a bucket. Rows with equal ids follow each other by text; null ids come last.
    Repeated ids share their bucket. The table of bucket heads is ordered in one task: one row per 1024 ids.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63) + 1).cast("long"))
    rows = documents(docs).withColumn("_k", key).withColumn("_b", F.shiftright(key, bits))
    head = written(rows.groupBy("_b").agg(F.max_by(F.struct("doc_id", "text", "_k"), F.struct("_k", "text")).alias("h")))
    order = Window.orderBy(F.col("_b").desc())
    ids = head.select("_b")
    links = ids.select("_b", F.coalesce(F.lag("_b").over(order), F.min("_b").over(Window.partitionBy())).alias("_to"))
    ghosts = head.join(links, "_b").select("h.doc_id", "h.text", "h._k", F.col("_to").alias("_b"), F.lit(1).alias("_ghost"))
    w = Window.partitionBy("_b").orderBy("_ghost", F.col("_k").desc(), F.col("text").desc())
    return (
        rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts).withColumn("next_text", F.lead("text").over(w))
        .filter("_ghost = 0").select("doc_id", "text", "next_text")
    )


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Sketch of every text and of its edited text (last third replaced by the start of the next document).

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex of the sorted hashes), near_edited,
    near_next, containment_next, distinct_shingles. Empty texts have the empty fingerprint and resemble only each other.
    """

    def run(batches):
        last: tuple[str, np.ndarray] | None = None  # the next text of a row is mostly the text of the row that follows
        for b in batches:
            rows = []
            for text, after in zip(b.column("text").to_pylist(), b.column("next_text").to_pylist(), strict=True):
                after = text if after is None else after
                n = len(text)
                cut = n // 3
                edited = text[: n - cut] + after[:cut]
                own = last[1] if last and last[0] == text else sketch(text, k, words)
                other, changed = sketch(after, k, words), sketch(edited, k, words)
                last = (after, other)
                rows.append((n, hashlib.sha256(edited.encode()).hexdigest(), encoded(own), encoded(changed), resemblance(own, changed, k), resemblance(own, other, k), containment(own, other, k), distinct(own, k)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                                             ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "containment_next", "distinct_shingles"])

    return map_batches(with_next(docs), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, containment_next double, distinct_shingles double")
