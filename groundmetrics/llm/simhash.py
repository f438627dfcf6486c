"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within ``radius`` 2 agree in at least two of four 16-bit blocks, so every link lies within a group of
fingerprints that share a pair of blocks. Inside a group, fingerprints are sorted by population count and compared
tile by tile with exclusive-or and bit counts; tile pairs whose counts differ by more than the radius are skipped.
Groups above ``TILE`` rows are cut into tile pairs that different tasks compare. No link is lost, none is sampled.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmetrics.llm.common import components, documents, map_batches, mix64, shingle_hashes, written

RADIUS, TILE = 2, 4096


def fingerprint(text: str | bytes, words: int = 3) -> int:
    """64-bit majority fingerprint of the word shingles (A-Z lowered); 0 without words."""
    w = (text if isinstance(text, bytes) else text.encode()).lower().split()
    if not w:
        return 0
    hash_ = xxhash.xxh64_intdigest
    n = max(len(w) - words + 1, 1)
    counts, step = np.zeros(64, np.int64), 1 << 15
    for at in range(0, n, step):
        part = w[at : at + step + words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if n > 1 or len(w) == words else [b" ".join(w)]
        h = np.fromiter((hash_(g, 42) for g in grams), np.dtype("<u8"))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_rows(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document row; null texts count as empty."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return map_batches(documents(docs), run, "doc_id long, fp long")


def stars(fp: np.ndarray, radius: int = RADIUS, tile: int = 512) -> list[tuple[int, int]]:
    """Links of the distinct fingerprints ``fp`` (uint64) as (fingerprint, smallest of its group here)."""
    pop = np.bitwise_count(fp)
    order = np.argsort(pop, kind="stable")
    fp, pop = fp[order], pop[order].astype(np.int64)
    root = np.arange(len(fp))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a in range(0, len(fp), tile):
        x, top = fp[a : a + tile], pop[min(a + tile, len(fp)) - 1]
        for b in range(a, len(fp), tile):
            if pop[b] - top > radius:
                break
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ fp[None, b : b + tile]) <= radius)
            keep = i + a < j + b
            for p, q in zip((i[keep] + a).tolist(), (j[keep] + b).tolist(), strict=True):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
    out = []
    for i in range(len(fp)):
        r = find(i)
        if r != i:
            out.append((int(fp[i]), int(fp[r])))
    return out


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints within ``radius`` of each other, over distinct ``fp``."""
    if radius > 2:
        raise ValueError("four blocks find links up to radius 2")
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.struct(F.lit(c).alias("c"), (block(i) * 65536 + block(j)).alias("k")) for c, (i, j) in enumerate(combinations(range(4), 2))]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.c", "x.k")
    counts = written(keyed.groupBy("c", "k").agg(F.count("*").alias("n")).filter("n > 1"))
    keyed = keyed.join(counts, ["c", "k"])
    parts = F.ceil(F.col("n") / tile).cast("long")
    mine = F.pmod(F.xxhash64("fp"), parts)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda o: F.struct(F.least(mine, o).alias("t"), F.greatest(mine, o).alias("u")))
    keyed = keyed.select("c", "k", "fp", F.explode(pairs).alias("p")).select("c", "k", "p.t", "p.u", "fp")
    tiles = keyed.repartition("c", "k", "t", "u").sortWithinPartitions("c", "k", "t", "u")

    def run(batches):
        held: list[np.ndarray] = []
        key: np.ndarray | None = None

        def close():
            return stars(np.unique(np.concatenate(held)), radius) if held else []

        def batch(found):
            a = np.array([f for f, _ in found], np.uint64).view(np.int64)
            b = np.array([f for _, f in found], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for x in batches:
            if not x.num_rows:
                continue
            ids = np.stack([x.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("c", "k", "t", "u")], 1)
            fp = x.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            found = []
            for s, e in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if key is None or (ids[s] != key).any():
                    found += close()
                    held, key = [], ids[s].copy()
                held.append(fp[s:e].copy())
            yield batch(found)
        yield batch(close())

    return map_batches(tiles, run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links, itself included.

    Null ids never name a component (it is null only if no member has an id); repeated rows share their component.
    """
    rows = written(fingerprint_rows(docs, words))
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(fingerprint_links(prints, radius))
    label = prints.join(roots, prints["fp"] == roots["v"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = label.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = written(label.join(least, "root").select("fp", "component_id"))
    return rows.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates by similarity: bands, wide fingerprints and signatures only propose pairs; exact shingle sets decide.

SLOTS, BANDS, BAND_SLOTS = 128, 8, 2
WIDE, LOOSE, SIMILARITY = 24, 0.65, 0.8
TILE_BYTES, AT_ONCE = 32 << 20, 16
_ODD = mix64(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """The distinct shingle hashes of the lower-cased words, sorted."""
    return np.unique(shingle_hashes(text.encode().lower(), words))


def set_key(h: np.ndarray) -> int:
    """One signed number for a shingle set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def signature(h: np.ndarray) -> tuple[int, bytes, list[int]]:
    """(SimHash, one byte of each of SLOTS minima, band keys) of a shingle set."""
    if not len(h):
        return 0, bytes(SLOTS), [0] * BANDS
    low = np.full(SLOTS, np.uint64(2**64 - 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        for i in range(SLOTS):
            low[i] = min(low[i], (part * _ODD[i]).min())
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp = int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])
    low = mix64(low)
    keys = low[:BANDS].copy()
    for i in range(1, BAND_SLOTS):
        keys = mix64(keys * _ODD[i] + low[i * BANDS : (i + 1) * BANDS])
    return fp, (low & np.uint64(255)).astype(np.uint8).tobytes(), keys.view(np.int64).tolist()


def jaccard(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard of a shingle set with each of ``many``; none is empty."""
    flat, sizes = np.concatenate(many), np.array([len(m) for m in many], np.int64)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both / (sizes + len(one) - both)


def similar_stars(ids: np.ndarray, fp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray] | None = None, tile: int = 512) -> list[tuple[int, int]]:
    """Links (id, id of its group here) of rows whose fingerprints differ in at most WIDE bits and whose signatures agree in
    LOOSE of the slots and, with ``sets``, whose exact Jaccard is SIMILARITY or more. Tiles are ordered by population count;
    pairs that are already connected are passed over."""
    pop = np.bitwise_count(fp)
    order = np.lexsort((ids, pop))
    ids, fp, sig, pop = ids[order], fp[order], sig[order], pop[order].astype(np.int64)
    root = np.arange(len(fp))
    if sets is not None:
        sets = [sets[i] for i in order]
        size = np.array([len(x) for x in sets], np.int64)

    def link(p, j):
        all_ = np.unique(np.append(root[j], root[p]))
        root[np.isin(root, all_)] = all_[0]

    for a in range(0, len(fp), tile):
        last = min(a + tile, len(fp)) - 1
        for b in range(a, len(fp), tile):
            if pop[b] - pop[last] > WIDE:
                break
            near = np.bitwise_count(fp[a : a + tile, None] ^ fp[None, b : b + tile]) <= WIDE
            for p in np.flatnonzero(near.any(1)):
                j, p = np.flatnonzero(near[p]) + b, p + a
                j = j[(root[j] != root[p]) & (j > p)]
                if sets is not None:
                    j = j[(size[j] > 0) & (np.minimum(size[j], size[p]) >= SIMILARITY * np.maximum(size[j], size[p]) - 1e-6)]
                if not len(j):
                    continue
                same = (sig[j] == sig[p]).mean(1)
                j, same = j[same >= LOOSE], same[same >= LOOSE]
                if sets is None:
                    if len(j):
                        link(p, j)
                    continue
                j = j[np.argsort(-same, kind="stable")]
                while len(j):
                    ok = j[:AT_ONCE][jaccard(sets[p], [sets[i] for i in j[:AT_ONCE]]) >= SIMILARITY]
                    j = j[AT_ONCE:]
                    if len(ok):
                        link(p, ok)
                        j = j[root[j] != root[p]]
    return [(int(ids[i]), int(ids[root[i]])) for i in np.flatnonzero(root != np.arange(len(fp)))]


def tiled_links(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): links of ``similar_stars`` among rows (id, fp, sig and perhaps set) of one group; ``groups`` has its ``parts``,
    and each pair of parts is one tile."""
    exact = "set" in rows.columns
    mine = F.pmod(F.xxhash64("id"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least(mine, o).alias("t"), F.greatest(mine, o).alias("u")))
    data, keys = ["id", "fp", "sig", *(["set"] if exact else [])], [*by, "t", "u"]
    tiles = rows.join(groups, by).select(*by, F.explode(pairs).alias("p"), *data).select(*by, "p.t", "p.u", *data)
    tiles = tiles.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held: list[tuple] = []
        key = None

        def close():
            if not held:
                return []
            ids, fp, sig, sets = zip(*held, strict=True)
            return similar_stars(np.concatenate(ids), np.concatenate(fp), np.concatenate(sig), [x for s in sets for x in s] if exact else None)

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.int64()), pa.array([f for _, f in found], pa.int64())], ["a", "b"])

        for x in batches:
            if not x.num_rows:
                continue
            at = np.stack([x.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in keys], 1)
            ids, fp = x.column("id").to_numpy(zero_copy_only=False), x.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            sig = np.frombuffer(b"".join(x.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
            sets = [np.frombuffer(s, "<u8") for s in x.column("set").to_pylist()] if exact else []
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
            found = []
            for s, e in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if key is None or (at[s] != key).any():
                    found += close()
                    held, key = [], at[s].copy()
                held.append((ids[s:e].copy(), fp[s:e].copy(), sig[s:e].copy(), sets[s:e]))
            yield batch(found)
        yield batch(close())

    return map_batches(tiles, run, "a long, b long")


def similar_groups(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, component_id) of documents linked by an exact Jaccard of 0.8 or more on word shingles.

    Texts with the same shingle set are one class. Classes that share a band key (two minima of eight bands) and are loosely
    alike in bits and slots are joined to candidate groups; within these the shingle sets, read again from the texts of the
    candidates only, decide every pair that is not connected yet. A pair at 0.8 is proposed with probability 0.9997 (bands;
    bits and slots lose fewer than one in 10,000), and none below 0.8 is linked. component_id is the smallest linked doc_id; rows without
    id are left out.
    """
    named = documents(docs).filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))

    def sign(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            got = [signature(h) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([set_key(h) for h in sets], pa.int64()), pa.array(np.array([g[0] for g in got], np.uint64).view(np.int64)), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.int64()))],
                                             ["doc_id", "class", "fp", "sig", "keys"])

    rows = written(map_batches(named, sign, "doc_id long, class long, fp long, sig binary, keys array<long>"))
    classes = written(rows.groupBy("class").agg(F.min("doc_id").alias("id"), F.any_value("fp").alias("fp"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys")))
    keyed = classes.select("id", "fp", "sig", F.posexplode("keys").alias("c", "k"))
    counts = written(classes.select(F.posexplode("keys").alias("c", "k")).groupBy("c", "k").agg(F.count("*").alias("n")).filter("n > 1"))
    loose = components(tiled_links(keyed, counts.select("c", "k", F.ceil(F.col("n") / TILE).cast("long").alias("parts")), ["c", "k"]))

    def sets_of(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            mine = pa.array([set_key(h) == c for h, c in zip(sets, b.column("class").to_pylist(), strict=True)], pa.bool_())
            out = [b.column(b.schema.get_field_index(n)) for n in ("root", "class", "id", "fp", "sig")]
            yield pa.RecordBatch.from_arrays([*out, pa.array([h.tobytes() for h in sets], pa.binary())], ["root", "class", "id", "fp", "sig", "set"]).filter(mine)

    wanted = classes.join(loose, classes["id"] == loose["v"]).select("root", "class", "id", "fp", "sig")
    texts = named.join(wanted, named["doc_id"] == wanted["id"]).select("root", "class", "id", "fp", "sig", "text")
    held = map_batches(texts, sets_of, "root long, class long, id long, fp long, sig binary, set binary").groupBy("class").agg(*(F.any_value(n).alias(n) for n in ("root", "id", "fp", "sig", "set")))
    held = written(held)
    groups = written(held.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.octet_length("set")) / TILE_BYTES)).cast("long").alias("parts")))
    roots = components(tiled_links(held, groups, ["root"]))
    label = written(classes.join(roots, classes["id"] == roots["v"], "left").select("class", F.coalesce("root", "id").alias("component_id")))
    return rows.select("doc_id", "class").join(label, "class").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with the row of the smallest id of each group of similar documents; a repeated (doc_id, text) stays once, rows without id stay."""
    kept = written(similar_groups(docs, words).filter("doc_id = component_id").select("doc_id").distinct())
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns)
    return named.dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id is null"))
