"""Hard negatives, directly addressable token ids and turn repair against brute force and edge cases; cached encoding."""

import collections
import functools
import hashlib
import os
import random
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from groundmetrics.llm import directcodes, negatives, packing, queries, tokens, turns  # noqa: E402
from groundmetrics.llm.common import shared_folder  # noqa: E402

SF = "/root/testdata/sf0.001"
TRICKY = ["", " ", "a", "Don't  stop. It'S\n\nfine,ok", "tab\there  \tx", "  lead", "trail  ", "a <|endoftext|> b<|endoftext|>", "x  <|endoftext|>", "İstanbul. ß y é é ññ.",
          "日本語 text123 45.6", "\r\nwin\r\n", "a b 　c", "word" * 400, "it's'll we've", "-- ' 's", "x\x1cy \x85z", "No² Ⅷ _a_b 1a2"]


# ---- cached encoding


@pytest.mark.parametrize("path", [queries.TOKENIZER, queries.WORD_TOKENIZER])
def test_cached_ids_are_the_tokenizers_ids(spark, path):
    from tokenizers import Tokenizer

    plain, source = Tokenizer.from_file(path), tokens.read_tokenizer(path)
    rng = random.Random(1)
    alphabet = ["a", "Bé", "İ", " ", "  ", "\n", "\t", ".", "'s", "'", "7", "語", "́", "<|endoftext|>", " ", "don't", "_", "²"]
    texts = TRICKY + ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(3000)] + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    encoder = tokens.Encoder(source)
    assert encoder.pattern is not None
    for part in (texts[:50], texts):
        for text, got in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert not any(len(p) > tokens.CACHED_LENGTH for p in encoder.cache)


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.TOKENIZER)
    docs = spark.createDataFrame([*((i, t) for i, t in enumerate(TRICKY)), (90, None), (None, "null id")], "doc_id long, text string")
    got = collections.defaultdict(dict)
    for r in packing.pack(docs, queries.TOKENIZER, with_ids=True).collect():
        got[r.doc_id][r.start] = r.ids
    for doc, text in [*enumerate(TRICKY), (90, ""), (None, "null id")]:
        assert [i for _, part in sorted(got[doc].items()) for i in part] == [*plain.encode(text, add_special_tokens=False).ids, 0]


# ---- op12


def test_direct_codes_shard():
    rng = np.random.default_rng(0)
    for high in (1, 200, 256, 70_000, 1 << 31):
        ids = [rng.integers(0, high, n).astype("<u4") for n in (0, 1, 513, 5000)]
        flat = np.concatenate(ids)
        shard = directcodes.Shard(b"xx" + directcodes.encode_shard(7, [3, None, -5, 3], ids), 2)
        assert shard.number == 7 and shard.doc_ids == [3, None, -5, 3] and np.array_equal(shard.all(), flat)
        at = rng.permutation(len(flat))
        assert np.array_equal(shard.at(at), flat[at]) and np.array_equal(shard.document(2), ids[2]) and not len(shard.document(0))
        with pytest.raises(IndexError):
            shard.at(np.array([len(flat)]))
    with pytest.raises(ValueError):
        directcodes.Shard(bytes(100))


def test_token_codes_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.WORD_TOKENIZER)
    docs = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    got, at = {r.doc_id: r for r in queries.op12_token_codes(spark, SF).collect()}, 0
    assert len(got) == len(docs)
    for doc, text in docs:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_codes_edges_and_random_access(spark, monkeypatch):
    monkeypatch.setattr(directcodes, "SHARD_IDS", 50)
    monkeypatch.setattr(directcodes, "SHARDS_PER_FILE", 3)
    rows = [(5, "five words are in here", 0), (None, "no id", 1), (2, None, 2), (2, "", 2), (9, "w " * 3000, 3), *((7, "same text", 4) for _ in range(40)), (-1, "minus", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    folder = shared_folder(spark)
    directcodes.write(docs, queries.WORD_TOKENIZER, folder, end_id=2)
    got = sorted(directcodes.read_documents(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -1, 2, 2, 5, *[7] * 40, 9]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and [r.n_tokens for r in got if r.doc_id == 2] == [1, 1]
    wanted = spark.createDataFrame([(9, 0), (9, 3000), (9, 3001), (None, 2), (2, 0), (7, 1), (99, 0)], "doc_id long, position long")
    some = directcodes.tokens_at(spark, folder, wanted).collect()
    count = collections.Counter((r.doc_id, r.position) for r in some)
    assert count == {(9, 0): 1, (9, 3000): 1, (None, 2): 1, (2, 0): 2, (7, 1): 40}
    assert {r.token_id for r in some if (r.doc_id, r.position) in ((9, 3000), (None, 2), (2, 0))} == {2}
    empty = shared_folder(spark)
    directcodes.write(docs.limit(0), queries.WORD_TOKENIZER, empty, end_id=2)
    assert directcodes.read_documents(spark, empty).count() == 0


# ---- op13


def slow_repair(rows):
    """The definition itself: (cost, audit, text) by trying every sequence, rows as (role, text)."""
    seen, kinds = set(), []
    for role, text in rows:
        bare = text.strip(turns.SPACES)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, left):
        out = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if left:
            for letter, role in (("u", "user"), ("a", "assistant")):
                if (state, letter) in step and (x := best(i, step[state, letter], left - 1)):
                    out.append((5 + x[0], "I" + x[1], ((role, ""), *x[2])))
        if i < len(rows):
            role, text = rows[i]
            late = 5 if kinds[i] == "truncated" else 0
            if x := best(i + 1, state, 3):
                out.append((2 + x[0], "D" + x[1], x[2]))
            if kinds[i] not in ("blank", "duplicate"):
                if (state, role[:1]) in step and (x := best(i + 1, step[state, role[:1]], 3)):
                    out.append((late + x[0], "K" + x[1], ((role, text), *x[2])))
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if (state, letter) in step and (x := best(i + 1, step[state, letter], 3)):
                        out.append((late + 1 + x[0], "R" + x[1], ((name, text), *x[2])))
        return min(out) if out else None

    cost, audit, kept = best(0, "", 3)
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(rows, rows[1:], strict=False)]
    return (*(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def in_turn_order(rows):
    return sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2]))


def test_turn_repair_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(turns, "SPILL_ROWS", 3)
    rng = random.Random(3)
    talks = {c: [(rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", "User", "ux"]), rng.choice(["", " \n", "Fine.", "Cut off", "Yes! ", "No?\n", "a.", "b"]))
                 for _ in range(rng.randint(0, 9))] for c in range(400)}
    rows = [(c, t, r, x, "clash") for c, talk in talks.items() for t, r, x in talk]
    got = {r.conv_id: tuple(r)[1:] for r in turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string")).collect()}
    assert set(got) == {c for c, talk in talks.items() if talk}
    for c, talk in talks.items():
        if talk:
            real = [t for t, _, _ in talk if t is not None]
            gaps = max(real) - min(real) + 1 - len(set(real)) if real else 0
            assert got[c] == (gaps, *slow_repair([(r, x) for _, r, x in in_turn_order(talk)])), talk


def test_turn_repair_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = collections.defaultdict(list)
    for r in rows:
        c, t, role, text = r.conv_id, r.turn, " " if r.role is None else r.role, " " if r.text is None else r.text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[c] += [] if kind == 0 else [(t, "user" if kind == 4 else role, "" if kind == 1 else text.translate({ord(s): None for s in ".!?"}) if kind == 2 else text)] * (2 if kind == 3 else 1)
    got = {r.conv_id: tuple(r)[2:] for r in queries.op13_turn_repair(spark, SF).collect()}
    assert set(got) == set(want)
    for c, talk in want.items():
        assert got[c] == slow_repair([(r, x) for _, r, x in in_turn_order(talk)])


def test_turn_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "x")]
    got = {r.conv_id: r for r in turns.repair(spark.createDataFrame(rows, schema)).collect()}
    assert (got[None].blank, got[None].audit, got[None].gaps) == (1, "DD", 0) and got[1].repaired_sha256 == nothing and got[1].cost == 2
    gone = turns.repair(spark.createDataFrame([(4, 1, "user", "x", True), (4, 2, "user", "y", True)], schema + ", dropped boolean")).collect()
    assert [tuple(r) for r in gone] == [(4, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert turns.repair(spark.createDataFrame([], schema)).count() == 0
    long = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(30000)]
    one = turns.repair(spark.createDataFrame(long, schema)).first()
    assert one.cost == 0 and one.audit == "K" * 30000 and one.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in long).encode()).hexdigest()


# ---- op11


def test_hard_negatives_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.sql(queries.ORACLES["op11_hard_negatives"]).fetchall())
    assert want and sorted(map(tuple, queries.op11_hard_negatives(spark, SF).collect())) == want


def slow_negatives(rows, scale=256):
    fine = [(i, label, anchor, [int(np.floor(scale * x)) for x in v]) for i, label, anchor, v in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda s, i: (-s, negatives.NO_ID if i is None else i)
    out = []
    for a, (i, label, anchor, v) in enumerate(fine):
        if anchor:
            scored = [(sum(p * q for p, q in zip(v, w, strict=False)), j, other) for b, (j, other, _, w) in enumerate(fine) if b != a]
            for s, j, _ in sorted((x for x in scored if x[2] == label), key=lambda x: order(x[0], x[1]))[:5]:
                fit = sorted((x for x in scored if x[2] != label and 50 * s <= 100 * x[0] <= 95 * s), key=lambda x: order(x[0], x[1]))[:3]
                out += [(i, j, r + 1, k, s, n) for r, (n, k, _) in enumerate(fit)]
    return sorted(out, key=repr)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("TILE", 7), ("PAGE", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 5))
    rows = [(i, int(rng.integers(0, 3)), i % 4 == 0, (centre[i % 6] + rng.standard_normal(5) * 0.2).tolist()) for i in range(300)]
    rows += [(1000 + i, 1, i % 9 == 0, [1.0, 2.0, 0.5, -1.0, 0.25]) for i in range(60)]  # one vector many times
    rows += [(7, 2, True, [0.5, 1.0]), (8, None, True, [1.0] * 5), (9, 1, True, None), (10, 1, True, [1.0, float("nan"), 0.0, 0.0, 0.0]), (11, 1, True, [1.0, None, 0.0, 0.0, 0.0]), (12, 1, True, []), (13, 0, None, [0.0] * 5),
             (None, 0, False, [1.0, 2.0, 0.5, -1.0, 0.2]), (None, 1, True, [1.0] * 5), (3, 0, True, [2.0] * 5), (3, 0, True, [2.0] * 5), (14, 2, True, [3e5] * 5), (15, 1, True, [float("inf")] * 5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, label int, anchor boolean, vector array<double>, row string").repartition(5)
    assert sorted(map(tuple, negatives.mine(df).collect()), key=repr) == slow_negatives(rows)
    assert negatives.mine(df.limit(0)).count() == 0 and negatives.mine(df.filter("not anchor")).count() == 0


def test_bounds_hold_and_choose(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (40, 6))
    a = rng.integers(-300, 300, (9, 6))
    low, high = negatives.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    s = negatives.product(a, x)
    assert (low[:, 0] <= s.min(axis=1)).all() and (s.max(axis=1) <= high[:, 0]).all()
    cells = np.array([[i, j] for i in range(8) for j in range(8)])
    path = cells[np.argsort(negatives.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    # Far clusters: most blocks are not read.
    rows = [(i, i % 2, i % 50 == 0, [10.0 * ((i // 1024) == k) + float(rng.random()) * 0.1 for k in range(8)]) for i in range(8192)]
    df = spark.createDataFrame(rows, "id long, label int, anchor boolean, vector array<double>")
    folder = shared_folder(spark)
    blocks = negatives.write_blocks(negatives.keyed(df, 256), folder)
    tiles = negatives.write_tiles(blocks, folder, 5)
    assert negatives.choose(tiles, blocks, False).count() <= tiles.count() * blocks.count()
    assert negatives.product(np.full((1, 4), 1 << 40), np.full((1, 4), 1 << 40))[0, 0] == negatives.LIMIT
