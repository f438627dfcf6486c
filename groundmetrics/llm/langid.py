"""Language identification with bit-sliced Bloom filters of character n-grams.

Position p of the filter table holds a bit mask of languages: bit l is set if p is set in the Bloom filter of language l.
The and of the masks at an n-gram's positions gives all languages that (may) contain it. A text's n-grams are counted by
language, expected false positives are taken off, and the highest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmetrics.llm.common import map_batches, mix64

SIZES, POSITIONS, HASHES = (2, 3, 4), 1 << 20, 2
FIT_ROWS, LEAST_COUNT, NEAR_BEST = 20_000, 4, 0.5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 16


def grams(text: str, sizes=SIZES):
    """Arrays of n-gram hashes of the lower-cased text, white space as one word edge, in pieces of bounded size."""
    folded = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(folded.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    for at in range(0, len(c), _STEP):
        for n in sizes:
            part = c[at : at + _STEP + n - 1]
            m = len(part) - n + 1
            if m > 0:
                h = np.full(m, n, np.uint64)
                for i in range(n):
                    h = h * _ODD + part[i : i + m]
                yield mix64(h)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # uint64 mask per position
    false: np.ndarray  # false-positive rate per language
    prior: str


def counts_by_mask(text: str, model: Model) -> tuple[np.ndarray, int]:
    out, total = np.zeros(len(model.langs)), 0
    for h in grams(text):
        at = h & np.uint64(POSITIONS - 1)
        mask = model.table[at]
        for k in range(1, HASHES):
            mask = mask & model.table[(h >> np.uint64(24 * k)) & np.uint64(POSITIONS - 1)]
        kinds, n = np.unique(mask, return_counts=True)
        for i in range(len(out)):
            out[i] += n[(kinds >> np.uint64(i)) & np.uint64(1) == 1].sum()
        total += len(h)
    return out, total


def decide(text: str | None, model: Model) -> tuple[str, float]:
    """(language, score); ``und`` with score 0 for a null text or one without a letter."""
    if text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    hits, n = counts_by_mask(text, model)
    true = np.clip((hits - n * model.false) / (1 - model.false), 0, None)
    if not len(true) or not true.sum():
        return model.prior, 0.0
    best = int(np.argmax(true))
    rest = np.delete(true, best).max() if len(true) > 1 else 0.0
    return model.langs[best], float(true[best] / (true[best] + rest))


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Filters from (text, lang) rows; nulls are left out.

    At most about ``fit_rows`` rows, chosen by a hash of the text, are read for n-grams. A language holds an n-gram if it
    occurs ``LEAST_COUNT`` times and its rate is at least ``NEAR_BEST`` of that of the language where it is most frequent.
    The driver gets at most ``POSITIONS`` (position, mask) pairs.
    """
    rows = rows.select("text", "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(64).collect()}
    langs = sorted(sizes)
    if len(langs) > 63:
        raise ValueError("a mask holds 63 languages")
    if not langs:
        return Model([], np.zeros(POSITIONS, np.uint64), np.zeros(0), "und")
    prior = max(langs, key=lambda x: (sizes[x], x))
    every = -(-sum(sizes.values()) // fit_rows)
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    where = {x: i for i, x in enumerate(langs)}

    def run(batches):
        for b in batches:
            texts, names = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for name in set(names):
                got = [h for t, x in zip(texts, names, strict=True) if x == name for h in grams(t)]
                if got:
                    h, n = np.unique(np.concatenate(got), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), where[name], np.int32)), pa.array(n.astype(np.int64))], ["h", "l", "n"])

    seen = map_batches(some, run, "h long, l int, n long")
    per = seen.groupBy("h").agg(*[F.sum(F.when(F.col("l") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(langs))])
    per = per.filter(" or ".join(f"n{i} >= {LEAST_COUNT}" for i in range(len(langs))))
    chars = some.groupBy("lang").agg(F.sum(F.length("text")).alias("n"))
    total = {r["lang"]: max(r["n"], 1) for r in chars.collect()}
    rate = [F.col(f"n{i}") / F.lit(float(total.get(x, 1))) for i, x in enumerate(langs)]
    best = F.greatest(*rate) if len(rate) > 1 else rate[0]
    mask = sum((F.when((r >= NEAR_BEST * best) & (F.col(f"n{i}") >= LEAST_COUNT), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rate)), F.lit(0).cast("long"))
    at = F.array(*[F.shiftrightunsigned("h", 24 * k).bitwiseAND(F.lit(POSITIONS - 1)) for k in range(HASHES)])
    got = per.select(F.explode(at).alias("p"), mask.alias("m")).groupBy("p").agg(F.bit_or("m").alias("m")).toPandas()
    table = np.zeros(POSITIONS, np.uint64)
    table[got["p"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([((table >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Model(langs, table, np.minimum(fill**HASHES, 0.99), prior)


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a row per document row; predictions see the text only."""
    def run(batches):
        for b in batches:
            got = [decide(t, model) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(held_out(docs.select("doc_id", "text")), run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows that are not held out and predicts all. Without any label every text with a letter gets ``und``."""
    learn = held_out(docs.select("doc_id", "text", "lang")).filter("not held_out")
    return predict(docs, fit(learn))
