"""Toxicity: Levenshtein automata run against a lexicon trie, and scores of the context of each hit.

The lexicon (whole words, and stems that open a word) and the weights are learned from labelled rows. A token is
matched by walking the trie with the set of (node, edits) that a Levenshtein automaton of distance 1 could be in;
state sets are numbered when first met, so later tokens cost one dictionary lookup per character. A hit inside quotation
marks, or after a reporting verb, counts apart from a plain or directly addressed one.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmetrics.llm.common import map_batches, written

FIT_ROWS, LEXICON, LEAST_DOCS, FUZZY_FROM = 20_000, 400, 4, 5
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_][^\W_]*")
_LEET = str.maketrans("013457@$", "oleastas")
QUOTES = "\"“”„«»"
REPORT = {"said", "says", "wrote", "called", "quote", "quoted", "word", "term"}  # fixed values
ADDRESS = {"you", "your", "youre", "du", "tu", "vous", "ihr", "usted"}  # fixed values
STEM = (4, 5, 6, 7, 8)
WINDOW = 5
KINDS = ("plain", "misspelt", "quoted", "addressed")


@dataclass
class Trie:
    """Terms by character; ``word`` nodes end a whole word, ``stem`` nodes match whatever follows."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    word: dict[int, int] = field(default_factory=dict)
    stem: dict[int, int] = field(default_factory=dict)
    long: dict[int, int] = field(default_factory=dict)

    def add(self, term: str, number: int, stem: bool) -> None:
        at = 0
        for c in term:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
            at = self.children[at][c]
        (self.stem if stem else self.word)[at] = number
        if not stem and len(term) >= FUZZY_FROM:
            self.long[at] = number


class Automaton:
    """Levenshtein automaton of distance ``edits`` intersected with a trie, made deterministic as tokens need it."""

    def __init__(self, trie: Trie, edits: int = 1, most_states: int = 200_000):
        self.trie, self.edits, self.most = trie, edits, most_states
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self.number(self.closed({(0, 0)}))

    def number(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
        return self.ids[states]

    def closed(self, states: set) -> frozenset:
        """With the moves that skip a character of the term."""
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if e < self.edits:
                for child in self.trie.children[node].values():
                    if (child, e + 1) not in states:
                        states.add((child, e + 1))
                        todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in states:
            best[node] = min(e, best.get(node, e))
        return frozenset(best.items())

    def step(self, at: int, c: str) -> int:
        got = self.moves[at].get(c)
        if got is None:
            states = set()
            for node, e in self.sets[at]:
                kids = self.trie.children[node]
                if c in kids:
                    states.add((kids[c], e))
                if e < self.edits:
                    states.add((node, e + 1))
                    states.update((k, e + 1) for k in kids.values())
            got = self.moves[at][c] = self.number(self.closed(states)) if states else -1
        return got

    def match(self, token: str) -> list[tuple[int, int]]:
        """(term, edits) that the token matches: whole words within the distance, stems exactly."""
        if len(self.sets) > self.most:
            self.reset()
        out: dict[int, int] = {}
        at, node = self.start, 0
        for c in token:
            if node >= 0:
                node = self.trie.children[node].get(c, -1)
                if node in self.trie.stem:
                    out[self.trie.stem[node]] = 0
            if at >= 0:
                at = self.step(at, c)
            if at < 0 and node < 0:
                break
        if at >= 0:
            for n, e in self.sets[at]:
                term = self.trie.word.get(n) if not e else self.trie.long.get(n)
                if term is not None:
                    out[term] = min(e, out.get(term, e))
        return list(out.items())


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: np.ndarray
    bias: float

    def scorer(self):
        trie = Trie()
        for i, (t, stem) in enumerate(self.terms):
            trie.add(t, i, stem)
        auto, cache = Automaton(trie), {}

        def features(text: str) -> list[tuple[int, float]]:
            """Sparse features: presence of a term, and hits by kind of context."""
            low = text.lower()
            kinds, terms = [0] * len(KINDS), set()
            tokens = _TOKEN.findall(low)
            found = {}
            for token in set(tokens):
                got = cache.get(token)
                if got is None:
                    if len(cache) > 200_000:
                        cache.clear()
                    got = auto.match(token)
                    if not got and not token.isalpha():
                        got = auto.match(token.translate(_LEET))
                    cache[token] = got
                if got:
                    found[token] = got
            if not found:
                return []
            hits = [(i, t, found[t]) for i, t in enumerate(tokens) if t in found]
            if any(q in low for q in QUOTES):
                inside, at, quoted = False, 0, set()
                for m in re.finditer(rf"[{QUOTES}]|{_TOKEN.pattern}", low):
                    if m[0] in QUOTES:
                        inside = not inside
                    else:
                        if inside:
                            quoted.add(at)
                        at += 1
            else:
                quoted = set()
            for i, _, got in hits:
                near = set(tokens[max(0, i - WINDOW) : i + WINDOW + 1])
                context = 2 if i in quoted or near & REPORT and not near & ADDRESS else 3 if near & ADDRESS else 0
                edits = min(e for _, e in got)
                kinds[1 if edits and context != 2 else context] += 1
                terms.update(t for t, e in got if context != 2)
            size = len(KINDS)
            return [(k, math.log1p(n)) for k, n in enumerate(kinds) if n] + [(size + t, 1.0) for t in sorted(terms)]

        def score(text: str) -> float:
            z = self.bias + sum(self.weights[i] * v for i, v in features(text))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return features, score


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)))


def learn_terms(rows: DataFrame, size: int = LEXICON) -> list[tuple[str, bool]]:
    """The ``size`` words and stems whose presence tells most about the label; a model parameter, so the driver gets it."""

    def run(batches):
        seen: dict[str, list[int]] = {}

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["w", "n0", "n1"])
            seen.clear()
            return out

        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = set(_TOKEN.findall(text.lower()))
                for w in {"w" + w for w in words if len(w) <= 32} | {"s" + w[:k] for w in words for k in STEM if len(w) > k}:
                    seen.setdefault(w, [0, 0])[y] += 1
                if len(seen) > 500_000:
                    yield batch()
        yield batch()

    total = rows.agg(F.sum(F.lit(1) - F.col("toxic")), F.sum("toxic")).first()
    if not total[0] or not total[1]:
        return []
    n0, n1 = float(total[0]), float(total[1])
    per = map_batches(rows, run, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    lift = ((F.col("n1") + 0.1) / n1) / ((F.col("n0") + 0.5) / n0)
    per = per.filter(F.col("n1") >= LEAST_DOCS).withColumn("g", F.col("n1") * F.log(lift)).filter(lift > 4)
    got = per.orderBy(F.col("g").desc(), "w").limit(size).collect()
    return sorted((r["w"][1:], r["w"][0] == "s") for r in got)


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon and logistic weights from (doc_id, text, toxic) rows.

    At most about ``fit_rows`` rows, chosen by a hash of the id, are read. Their features (a few numbers a row) come to
    the driver, where the weights are fitted. Without both labels the model is constant.
    """
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    every = max(1, -(-rows.count() // fit_rows))
    some = written(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text", "toxic"))
    terms = learn_terms(some)
    model = Model(terms, np.zeros(len(KINDS) + len(terms)), 0.0)

    def run(batches):
        features, _ = model.scorer()
        for b in batches:
            got = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[i for i, _ in g] for g in got], pa.list_(pa.int32())), pa.array([[v for _, v in g] for g in got], pa.list_(pa.float64())), b.column("toxic")], ["i", "v", "y"])

    data = map_batches(some, run, "i array<int>, v array<double>, y int").collect()
    y = np.array([r["y"] for r in data], float)
    if not len(y) or y.min() == y.max():
        return Model([], np.zeros(len(KINDS)), -3.0 if not len(y) or not y.max() else 3.0)
    x = np.zeros((len(y), len(model.weights) + 1), np.float32)
    x[:, -1] = 1
    for k, r in enumerate(data):
        x[k, r["i"]] = r["v"]
    w, velocity = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    decay = np.append(np.full(x.shape[1] - 1, 1e-4), 0)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        velocity = 0.9 * velocity - 0.5 * (x.T @ (p - y) / len(y) + decay * w)
        w = w + velocity
    return Model(terms, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled documents that are not held out."""
    known = labels.select("doc_id", "toxic").filter("toxic is not null")
    return fit(held_out(docs.select("doc_id", "text")).filter("not held_out").join(known, "doc_id"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row per document row; null texts score as empty ones."""
    def run(batches):
        _, score_of = model.scorer()
        for b in batches:
            s = [score_of(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32())],
                                             ["doc_id", "held_out", "score", "predicted"])

    return map_batches(held_out(docs.select("doc_id", "text")), run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay as they are."""
    def run(batches):
        _, score_of = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score_of(t or "") < threshold for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)
