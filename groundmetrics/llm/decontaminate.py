"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) and benchmark items become TF-IDF vectors over hashed words, projected on the leading right
singular vectors that a distributed randomised SVD finds. The passages that hold enough words of an item are checked in the order of
their cosine to it; a candidate counts if a longest common subsequence of words covers most of the item, or covers less of it but has all of its
rarest words (the answer check for paraphrases).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmetrics.llm.common import map_batches, word_hashes, word_hashes_of, written

FEATURES, RANK, STRIDE, SPAN = 1 << 14, 64, 16, 2  # a passage is SPAN strides
COVER, PARAPHRASE, ANSWER_WORDS = 0.8, 0.5, 4
MOST_ITEM_BYTES = 64 << 20
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BLOCK = 256
_FIT_WORDS = 1 << 16


def words_of(text: str) -> bytes:
    """The text in lower case with everything but letters and digits as single blanks."""
    return text.lower().encode().translate(_FOLD)


def features_of(data: bytes) -> np.ndarray:
    return (word_hashes(data) & np.uint64(FEATURES - 1)).astype(np.int64)


def in_groups(texts: list[str | None]):
    """(folded text, features) of every text, hashed in groups of bounded size; nulls count as empty."""
    group: list[bytes] = []
    size = 0

    def closed():
        return zip(group, [(h & np.uint64(FEATURES - 1)).astype(np.int64) for h in word_hashes_of(group)], strict=True)

    for t in texts:
        data = words_of(t or "")
        if group and size + len(data) > 1 << 20:
            yield from closed()
            group, size = [], 0
        group.append(data)
        size += len(data)
    yield from closed()


def passages(feat: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` (one vector a word) over windows of SPAN strides, every stride; one window for short texts."""
    if not len(feat):
        return np.zeros((0, rows.shape[1]), rows.dtype)
    block = np.add.reduceat(rows, np.arange(0, len(feat), STRIDE), axis=0)
    n = max(len(block) - SPAN + 1, 1)
    return sum(block[i : i + n] for i in range(min(SPAN, len(block))))


def feature_table(docs: DataFrame) -> DataFrame:
    """The features of every document's words in order (``feat``, two bytes a word), written once for the passes that follow."""

    def run(batches):
        for b in batches:
            cells = [feat.astype("<u2").tobytes() for _, feat in in_groups(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary())], ["feat"])

    return written(map_batches(docs.select("text"), run, "feat binary"))


def _features(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch.column("feat").to_pylist()]


def document_frequency(feats: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents of a ``feature_table`` each hashed word occurs (partial counts per task, summed by Spark), and their number."""

    def run(batches):
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for feat in _features(b):
                df[np.unique(feat)] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(FEATURES), -1)), pa.array(np.append(df, n))], ["f", "n"])

    got = map_batches(feats, run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1, np.int64)
    df[got["f"].to_numpy()] = got["n"].to_numpy()
    return df[:-1], int(df[-1])


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    """Squared inverse document frequency; words of more than half the documents keep a trace only."""
    return (np.maximum(np.log((1 + n) / (1 + df)) - np.log(2), 0.05) ** 2).astype(np.float32)


def add_passages(out: np.ndarray, group: list[np.ndarray], rows: np.ndarray) -> None:
    """Adds M'M ``rows`` to ``out`` (columns x FEATURES), where M counts the features of every passage of the documents in ``group``.

    ``rows`` has a last row of zeros beyond FEATURES, for the places that pad each document to whole strides.
    """
    sizes = np.array([len(f) for f in group])
    blocks = -(-sizes // STRIDE)
    ends = np.cumsum(blocks)
    n = int(ends[-1])
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[ends - blocks], last[ends - 1] = True, True
    feat = np.concatenate(group).astype(np.int64)
    at = np.arange(len(feat)) + np.repeat((ends - blocks) * STRIDE - (np.cumsum(sizes) - sizes), sizes)
    padded = np.full(n * STRIDE, FEATURES)
    padded[at] = feat
    block = np.concatenate([rows.take(padded[i : i + _FIT_WORDS], 0).reshape(-1, STRIDE, rows.shape[1]).sum(1) for i in range(0, len(padded), _FIT_WORDS)])
    # a passage is a block and the next one of its document (SPAN = 2), or the only block; each word gets the passages that hold it
    passage, inner = block.copy(), np.flatnonzero(~last)
    passage[inner] += block[inner + 1]
    passage[last & ~first] = 0
    back, later = passage.copy(), np.flatnonzero(~first)
    back[later] += passage[later - 1]
    back, at = np.ascontiguousarray(back.T), at // STRIDE
    for k in range(len(out)):
        out[k] += np.bincount(feat, back[k].take(at), FEATURES)


def gram_times(feats: DataFrame, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'A ``x`` over the TF-IDF vectors A of all passages of a ``feature_table``.

    A task keeps one sum for all its documents and returns it in blocks of features, which Spark adds up. There are as many sums as
    tasks, so their number follows the cluster, not the documents.
    """

    def run(batches):
        out = np.zeros(x.shape[::-1])
        rows = np.vstack([x * idf[:, None], np.zeros((1, x.shape[1]), np.float32)])
        group, size = [], 0
        for b in batches:
            for feat in _features(b):
                if len(feat):
                    group.append(feat)
                    size += len(feat)
                if size >= _FIT_WORDS:
                    add_passages(out, group, rows)
                    group, size = [], 0
        if group:
            add_passages(out, group, rows)
        done = (out.T * idf[:, None]).astype(np.float32)
        blocks = [done[i : i + _BLOCK].tobytes() for i in range(0, FEATURES, _BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array(blocks, pa.binary())], ["block", "part"])

    def total(batch_table: pa.Table) -> pa.Table:
        part = sum(np.frombuffer(c.as_py(), np.float32) for c in batch_table.column("part"))
        return pa.table({"block": batch_table.column("block")[:1], "part": pa.array([part.tobytes()], pa.binary())})

    tasks = 4 * feats.sparkSession.sparkContext.defaultParallelism
    parts = map_batches(feats.coalesce(tasks), run, "block long, part binary").groupBy("block").applyInArrow(total, "block long, part binary").collect()
    z = np.zeros(x.shape, np.float32)
    for r in parts:
        z[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["part"], np.float32).reshape(-1, x.shape[1])
    return z


def latent_basis(feats: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """FEATURES x rank basis of the passages' TF-IDF row space by randomised SVD, each direction divided by its singular value.

    Without that scaling the few directions that tell languages apart would dominate every cosine.

    Fitted on all passages of all documents of a ``feature_table``, in two passes; the driver only orthonormalises FEATURES x rank numbers.
    """
    start = np.random.default_rng(7).standard_normal((FEATURES, rank)).astype(np.float32)
    basis = np.linalg.qr(gram_times(feats, idf, start) + 1e-6 * start)[0].astype(np.float32)
    z = gram_times(feats, idf, basis)
    square, turned = np.linalg.eigh((basis.T @ z + z.T @ basis).astype(np.float64) / 2)
    return (basis @ (turned / np.sqrt(np.maximum(square, square.max() * 1e-9 + 1e-12)))).astype(np.float32)


@dataclass
class Index:
    idf: np.ndarray
    basis: np.ndarray  # already times idf
    ids: list
    words: list[list[bytes]]
    sets: list[set[bytes]]
    rare: list[set[bytes]]
    vectors: np.ndarray
    features: np.ndarray  # of the distinct words of all items, one item after the other
    starts: np.ndarray  # where each item's begin
    times: np.ndarray  # how often each of these words occurs in its item
    is_rare: np.ndarray  # whether it is one of its item's rarest


def make_index(idf: np.ndarray, basis: np.ndarray, items: list[tuple[object, bytes]]) -> Index:
    """The index of (item_id, folded text) items, none of them without words."""
    vectors, rare, words = [], [], [w.split() for _, w in items]
    for (_, w), names in zip(items, words, strict=True):
        feat = features_of(w)
        vectors.append(basis[feat].sum(0))
        order = sorted(range(len(names)), key=lambda k: (-idf[feat[k]], k))
        rare.append({names[k] for k in order[:ANSWER_WORDS]})
    counts = [Counter(n) for n in words]
    sizes = np.array([len(c) for c in counts], np.int64)
    flat = [(n, w in r) for c, r in zip(counts, rare, strict=True) for w, n in c.items()]
    return Index(idf, basis, [i for i, _ in items], words, [set(c) for c in counts], rare, unit(np.array(vectors, np.float32).reshape(len(items), RANK)),
                 np.concatenate([np.empty(0, np.int64), *(features_of(b" ".join(c)) for c in counts)]), np.cumsum(sizes) - sizes,
                 np.array([n for n, _ in flat], np.int64), np.array([r for _, r in flat], np.int64))


def possible(feat: np.ndarray, index: Index) -> np.ndarray:
    """The items that a text with these features may hold: it has the words of COVER of the item, or of PARAPHRASE and all of
    the item's rarest. Words with one feature count for each other, so no match is left out."""
    seen = np.zeros(FEATURES, np.int64)
    seen[feat] = 1
    has = seen[index.features]
    covered, size = np.add.reduceat(has * index.times, index.starts), np.add.reduceat(index.times, index.starts)
    answers = np.add.reduceat((1 - has) * index.is_rare, index.starts) == 0
    return np.flatnonzero((covered >= COVER * size) | answers & (covered >= PARAPHRASE * size))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def build(docs: DataFrame, benchmark: DataFrame) -> Index:
    """The index of all items. Items are the stated query set; they are refused above ``MOST_ITEM_BYTES``, where callers pass
    the benchmark in parts and join the findings. Null or wordless items match nothing; equal items are all reported."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > MOST_ITEM_BYTES:
        raise ValueError("pass a benchmark of this size in parts")
    feats = feature_table(docs)
    idf = inverse_frequency(*document_frequency(feats))
    basis = latent_basis(feats, idf) * idf[:, None]
    got = [(r["item_id"], words_of(r["text"])) for r in items.collect()]
    return make_index(idf, basis, [(i, w) for i, w in got if w.split()])


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def candidates(feat: np.ndarray, item: int, index: Index, own: np.ndarray) -> np.ndarray:
    """The passages near which the item may lie, the likeliest by cosine first. ``own`` is a buffer of zeros, left as such.

    Left out are those around which too few words have a feature of the item, or of its rarest words, for the final check, in any order;
    the vectors leave nothing out.
    """
    size, begin = len(index.words[item]), index.starts[item]
    end = begin + len(index.sets[item])
    mine = index.features[begin:end]
    rare = mine[index.is_rare[begin:end] == 1]
    start = np.arange(max(-(-len(feat) // STRIDE) - SPAN + 1, 1)) * STRIDE
    low, high = np.maximum(start - size, 0), np.minimum(start + SPAN * STRIDE + size, len(feat))

    def held(some: np.ndarray) -> np.ndarray:
        own[some] = 1
        upto = np.concatenate(([0], np.cumsum(own[feat], dtype=np.int32)))
        own[some] = 0
        return upto[high] - upto[low]

    words = held(mine)
    enough = words >= COVER * size
    part = words >= PARAPHRASE * size
    if part.any():
        enough |= part & (held(rare) >= len(index.rare[item]))
    start = start[enough]
    if len(start) < 2:
        return start
    near = unit(np.stack([index.basis[feat[s : s + SPAN * STRIDE]].sum(0) for s in start.tolist()])) @ index.vectors[item]
    return start[np.argsort(-near, kind="stable")]


def matches(data: bytes, feat: np.ndarray, index: Index) -> dict[int, float]:
    """Item number -> share of its words found in order, for the items that the folded text contains.

    Items and passages that fail the final check whatever the order of the words are left out first, which changes no result. An item is
    done once all its words are found.
    """
    out: dict[int, float] = {}
    alive = possible(feat, index) if len(feat) and index.ids else []
    if not len(alive):
        return out
    words, own_features = data.split(), np.zeros(FEATURES, np.int8)
    for k in alive.tolist():
        item = index.words[k]
        for at in candidates(feat, k, index, own_features).tolist():
            region = words[max(0, at - len(item)) : at + SPAN * STRIDE + len(item)]
            own = index.sets[k].intersection(region)
            if 2 * len(own) < len(index.sets[k]):
                continue
            share = common_subsequence(item, region) / len(item)
            if share >= COVER or share >= PARAPHRASE and index.rare[k] <= own:
                out[k] = max(share, out.get(k, 0.0))
                if share == 1:
                    break
    return out


def search(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, item_id, score): a row per document row and item that it contains; whole texts, null ones as empty."""
    def run(batches):
        for b in batches:
            rows = [(d, index.ids[k], s) for d, t in zip(b.column("doc_id").to_pylist(), in_groups(b.column("text").to_pylist()), strict=True) for k, s in sorted(matches(*t, index).items())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["doc_id", "item_id", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, item_id long, score double")


def clean(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns stay as they are."""
    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not matches(*t, index) for t in in_groups(b.column(b.schema.get_field_index("text")).to_pylist())], pa.bool_()))

    return map_batches(docs, run, docs.schema)
