"""Hard negatives by exact windowed search over Hilbert-ordered candidate blocks with zone maps.

Vectors become integers, floor(scale * component). Rows are ordered along a Hilbert curve through a fixed projection of their
directions and packed into blocks of BLOCK rows, one Parquet row each, with the minimum and maximum of every dimension.
Anchors are packed in the same order into tiles of up to TILE rows. By interval arithmetic a block's zone map bounds the inner
product of each anchor with all of its rows from above and below:

* positives: a block is read for a tile if some anchor's upper bound reaches the anchor's n-th best score within its own block;
* negatives: a block is read if the bounds of some anchor meet the window that its positives leave open.

A (tile, block) pair is all that Spark shuffles. A tile's blocks are dealt to SALTS tasks, best bound first; a task keeps the
leading rows of each anchor and skips what cannot enter. Nothing is approximate: skipped blocks hold no row of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmetrics.llm.common import map_batches, shared_folder

BLOCK, TILE, SALTS, PAGE, PAGE_COPIES = 1024, 1024, 4, 1024, 16
CURVE_DIMS, CURVE_BITS = 8, 5
NO_ID, LOWEST, LIMIT = np.iinfo(np.int64).max, np.iinfo(np.int64).min, 1 << 62


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells (rows x dimensions, ``bits`` bits each; dimensions * bits <= 62)."""
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(inside, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(turn)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> bit & 1)
    return key


def curve_cells(vectors: np.ndarray) -> np.ndarray:
    """Cells of a fixed orthonormal projection of the vectors' directions; the zero vector lies in the middle."""
    dims = vectors.shape[1]
    axes = np.linalg.qr(np.random.default_rng(0).standard_normal((max(dims, 1), min(CURVE_DIMS, max(dims, 1)))))[0]
    v = vectors.astype(np.float64)
    along = v @ axes[:dims] / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None] * np.sqrt(max(dims, 1))
    return np.clip((np.tanh(along / 1.5) + 1) / 2 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b (int64); beyond 62 bits they stay at that limit. The shorter side counts as padded with zeros."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = lambda x: int(max(x.max(initial=0), -int(x.min(initial=0))))
    if most(a) * most(b) * max(d, 1) < 1 << 52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each anchor with any vector between ``low`` and ``high`` (zones x dimensions)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def leading(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k of each group by falling score, then id, then row; groups ascend."""
    order = np.lexsort((rows, ids, -score, group))
    g = group[order]
    first = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else np.zeros(0, int)
    return order[rank < k]


class Leaders:
    """The first k rows of each of ``groups`` groups; ``bar`` is the score that a further row must reach."""

    def __init__(self, groups: int, k: int, bar: np.ndarray):
        self.k, self.bar = k, bar.copy()
        self.group = self.score = self.ids = self.rows = np.zeros(0, np.int64)

    def add(self, group, score, ids, rows) -> None:
        if not len(group):
            return
        cols = [np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.ids, ids), (self.rows, rows))]
        keep = leading(*cols, self.k)
        self.group, self.score, self.ids, self.rows = (c[keep] for c in cols)
        full, counts = np.unique(self.group, return_counts=True)
        last = np.cumsum(counts) - 1
        full, last = full[counts == self.k], last[counts == self.k]
        self.bar[full] = np.maximum(self.bar[full], self.score[last])


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes that hold them."""
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _ints(data, rows: int, dims: int) -> np.ndarray:
    size = len(data) // max(rows * dims, 1)
    return np.frombuffer(data, {2: "<i2", 4: "<i4"}.get(size, "<i8")).reshape(rows, dims) if rows * dims else np.zeros((rows, dims), np.int64)


def _long(data) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


KEYED = "key long, id long, label long, anchor boolean, dims int, vec binary"
BLOCKS = "block long, n int, dims int, ids binary, labels binary, anchors binary, vecs binary, low binary, high binary, label_low long, label_high long"
TILES = "tile long, n int, dims int, rows binary, ids binary, labels binary, vecs binary, bar binary"


def keyed(rows: DataFrame, scale: int) -> DataFrame:
    """Integer vectors and curve keys of (id, label, anchor, vector). Rows with a null label or vector, or a null or non-finite component, take no part."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select("id", F.col("label").cast("long").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(fine)

    def run(batches):
        for b in batches:
            lists = b.column("vector")
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            flat = np.clip(np.floor(np.asarray(lists.flatten(), np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            ids, labels, anchor = b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("anchor").to_pylist()
            out = []
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                x = flat[starts[at][:, None] + np.arange(dims)]
                keys = hilbert_keys(curve_cells(x), CURVE_BITS) if dims else np.zeros(len(at), np.int64)
                x = _narrow(x)
                out += [(int(k), ids[i], labels[i], anchor[i], dims, v.tobytes()) for k, i, v in zip(keys, at.tolist(), x, strict=True)]
            yield _batch(KEYED, out)

    return map_batches(rows, run, KEYED)


def write_blocks(rows: DataFrame, folder: str) -> DataFrame:
    """Candidate blocks in curve order below ``folder``. Ties of the curve are split by id and place, so that equal vectors fill many blocks."""
    order = ["key", "id", "_at"]
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, []

        def close():
            nonlocal number, held
            dims = max(r[3] for r in held)
            x = np.zeros((len(held), dims), np.int64)
            for i, (_, _, _, d, v) in enumerate(held):
                x[i, :d] = _ints(v, 1, d)[0]
            labels = np.array([r[1] for r in held], "<i8")
            ids = np.array([NO_ID if r[0] is None else r[0] for r in held], "<i8")
            zone = [_narrow(z).tobytes() for z in (x.min(axis=0), x.max(axis=0))]
            out = (number, len(held), dims, ids.tobytes(), labels.tobytes(), np.array([r[2] for r in held], np.uint8).tobytes(), _narrow(x).tobytes(), *zone, int(labels.min()), int(labels.max()))
            number, held = number + 1, []
            return _batch(BLOCKS, [out])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "label", "anchor", "dims", "vec")), strict=True):
                held.append(row)
                if len(held) == BLOCK:
                    yield close()
        if held:
            yield close()

    map_batches(rows.select("id", "label", "anchor", "dims", "vec"), run, BLOCKS).write.parquet(f"{folder}/blocks")
    return rows.sparkSession.read.schema(BLOCKS).parquet(f"{folder}/blocks")


def write_tiles(blocks: DataFrame, folder: str, positives: int) -> DataFrame:
    """Anchors packed in block order, each with its ``positives``-th best score among the rows of its label in its own block."""

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, []

        def close():
            nonlocal number, held
            dims = max(v.shape[0] for *_, v in held)
            x = np.zeros((len(held), dims), np.int64)
            for i, (*_, v) in enumerate(held):
                x[i, : len(v)] = v
            out = (number, len(held), dims, *(np.array([r[k] for r in held], "<i8").tobytes() for k in (0, 1, 2)), _narrow(x).tobytes(), np.array([r[3] for r in held], "<i8").tobytes())
            number, held = number + 1, []
            return _batch(TILES, [out])

        for b in batches:
            for row in b.to_pylist():
                n, dims = row["n"], row["dims"]
                x, ids, labels = _ints(row["vecs"], n, dims), _long(row["ids"]), _long(row["labels"])
                at = np.flatnonzero(np.frombuffer(row["anchors"], np.uint8))
                if not len(at):
                    continue
                scores = product(x[at], x)
                other = (labels[at][:, None] == labels[None, :]) & (at[:, None] != np.arange(n)[None, :])
                scores = np.where(other, scores, LOWEST)
                bar = np.sort(scores, axis=1)[:, -positives] if n >= positives else np.full(len(at), LOWEST)
                for i, score in zip(at.tolist(), bar.tolist(), strict=True):
                    held.append((row["block"] * BLOCK + i, int(ids[i]), int(labels[i]), score, x[i]))
                    if len(held) == TILE:
                        yield close()
        if held:
            yield close()

    map_batches(blocks.select("block", "n", "dims", "ids", "labels", "anchors", "vecs"), run, TILES).write.parquet(f"{folder}/tiles")
    return blocks.sparkSession.read.schema(TILES).parquet(f"{folder}/tiles")


def choose(tiles: DataFrame, blocks: DataFrame, windows: bool) -> DataFrame:
    """(tile, block, ord): the blocks that some anchor of a tile must read, best bound first. ``bar`` holds the scores to reach; with
    ``windows``, ``bar`` and ``top`` hold the ends of each anchor's windows and labels are not asked for."""
    zones = blocks.select("block", F.struct("block", "dims", "low", "high", "label_low", "label_high").alias("zone"))
    page = [F.shiftright("block", 32), (F.col("block") % (1 << 32) / PAGE).cast("int")]
    pages = zones.groupBy(*page).agg(F.collect_list("zone").alias("zones")).select("zones", F.explode(F.sequence(F.lit(0), F.lit(PAGE_COPIES - 1))).alias("_copy"))
    tiles = tiles.withColumn("_copy", F.pmod(F.xxhash64("tile"), F.lit(PAGE_COPIES)).cast("int"))
    cols = ["tile", "n", "dims", "labels", "vecs", "bar", *(["top"] if windows else []), "zones"]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                a, zones = _ints(row["vecs"], row["n"], row["dims"]).astype(np.int64), row["zones"]
                dims = max(z["dims"] for z in zones)
                low, high = np.zeros((2, len(zones), dims), np.int64)
                for i, z in enumerate(zones):
                    low[i, : z["dims"]], high[i, : z["dims"]] = _ints(z["low"], 1, z["dims"])[0], _ints(z["high"], 1, z["dims"])[0]
                least, most = bounds(a, low, high)
                bar = _long(row["bar"]).reshape(row["n"], -1)
                if windows:
                    top = _long(row["top"]).reshape(row["n"], -1)
                    open_ = bar <= top
                    want = np.zeros(most.shape, bool)
                    for p in range(bar.shape[1]):
                        want |= (most >= bar[:, [p]]) & (least <= top[:, [p]]) & open_[:, [p]]
                else:
                    labels = _long(row["labels"])[:, None]
                    want = (most >= bar) & (labels >= np.array([z["label_low"] for z in zones])) & (labels <= np.array([z["label_high"] for z in zones]))
                best = np.where(want, most, LOWEST).max(axis=0)
                yield _batch("tile long, block long, ord long", [(row["tile"], zones[i]["block"], -int(best[i])) for i in np.flatnonzero(want.any(axis=0)).tolist()])

    return map_batches(tiles.join(pages, "_copy").select(*cols), run, "tile long, block long, ord long")


FOUND = "tile long, i int, p int, score long, id long, row long"


def search(tiles: DataFrame, blocks: DataFrame, k: int, windows: bool, groups: int) -> DataFrame:
    """FOUND rows: for each anchor i of a tile the first k rows of its label (p is 0) or, with ``windows``, the first k of other labels in each window p."""
    pairs = choose(tiles, blocks, windows)
    salt = F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")
    cols = ["tile", "salt", "ord", "n", "dims", "rows", "ids", "labels", "vecs", "bar", "top"]
    none = F.lit(None).cast("binary")
    read = pairs.join(blocks.drop("anchors", "low", "high"), "block").withColumns({"salt": salt, "rows": F.col("block").cast("string").cast("binary"), "bar": none, "top": none})
    heads = tiles.withColumns({"salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))), "ord": F.lit(LOWEST).cast("long"), **({} if windows else {"top": none})})
    stream = read.select(*cols).unionByName(heads.select(*cols)).repartition("tile", "salt").sortWithinPartitions("tile", "salt", "ord")

    def run(batches):
        tile = at = None

        def result():
            g = at["lead"].group
            return _batch(FOUND, list(zip([tile[0]] * len(g), (g // groups).tolist(), (g % groups).tolist(), at["lead"].score.tolist(), at["lead"].ids.tolist(), at["lead"].rows.tolist(), strict=True)))

        for b in batches:
            for j in range(b.num_rows):
                row = b.slice(j, 1).to_pylist()[0]
                x, ids, labels = _ints(row["vecs"], row["n"], row["dims"]), _long(row["ids"]), _long(row["labels"])
                if row["bar"] is not None:
                    if at is not None:
                        yield result()
                    tile, bar = (row["tile"], row["salt"]), _long(row["bar"])
                    at = {"x": x, "labels": labels, "rows": _long(row["rows"]), "top": _long(row["top"]) if windows else None, "lead": Leaders(len(bar), k, bar)}
                    continue
                block = int(row["rows"])
                lead, scores, rows = at["lead"], product(at["x"], x), block * BLOCK + np.arange(row["n"])
                same = at["labels"][:, None] == labels[None, :]
                for p in range(groups):
                    bar = lead.bar[p::groups]
                    if windows:
                        top = at["top"][p::groups]
                        fits = ~same & (scores >= bar[:, None]) & (scores <= top[:, None])
                    else:
                        fits = same & (scores >= bar[:, None]) & (at["rows"][:, None] != rows[None, :])
                    i, c = np.nonzero(fits)
                    lead.add(i * groups + p, scores[i, c], ids[c], rows[c])
        if at is not None:
            yield result()

    found = map_batches(stream, run, FOUND)
    rank = F.row_number().over(W.partitionBy("tile", "i", "p").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(rows: DataFrame, scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (id, label, anchor, vector): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first ``positives`` other rows of the same label by falling score, then id; for each, the first
    ``negatives`` rows of another label whose score is at least ``least`` and at most ``most`` percent of the positive's are given.
    A null anchor flag is false. A null id comes last among ties and stays null. Repeated rows are rows of their own, also as each
    other's positives. Shorter vectors count as padded with zeros; a negative positive_score leaves an empty window. An empty
    table, or one without anchors, gives no rows. Components are cut at 2**62 after scaling.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    blocks = write_blocks(keyed(rows, scale), folder)
    tiles = write_tiles(blocks, folder, positives)
    near = search(tiles, blocks, positives, False, 1)
    near.select("tile", "i", (F.col("rank") - 1).alias("p"), "score", "id").write.parquet(f"{folder}/positives")
    near = spark.read.parquet(f"{folder}/positives")
    lists = near.groupBy("tile").agg(F.collect_list(F.struct("i", "p", "score")).alias("found"))  # at most TILE * positives

    def windows(batches):
        for b in batches:
            for row in b.to_pylist():
                bar, top = np.ones((row["n"], positives), "<i8"), np.zeros((row["n"], positives), "<i8")
                for f in row["found"]:
                    bar[f["i"], f["p"]], top[f["i"], f["p"]] = -(-f["score"] * least // 100), f["score"] * most // 100
                yield _batch(f"{TILES}, top binary", [(*(row[c] for c in ("tile", "n", "dims", "rows", "ids", "labels", "vecs")), bar.tobytes(), top.tobytes())])

    open_ = map_batches(tiles.join(lists, "tile"), windows, f"{TILES}, top binary")
    far = search(open_, blocks, negatives, True, positives)
    anchors = tiles.select("tile", "ids")

    def names(batches):
        for b in batches:
            for row in b.to_pylist():
                yield _batch("tile long, i int, anchor_id long", [(row["tile"], i, v) for i, v in enumerate(_long(row["ids"]).tolist())])

    named = map_batches(anchors, names, "tile long, i int, anchor_id long")
    both = far.select("tile", "i", "p", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    both = both.join(near.select("tile", "i", "p", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), ["tile", "i", "p"]).join(named, ["tile", "i"])
    real = lambda c: F.nullif(c, F.lit(int(NO_ID))).alias(c)
    return both.select(real("anchor_id"), real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score")
