"""Sums whose last bits decide ties, panels in one pass, a latent basis of all passages."""

import math

import numpy as np

import __spark_entry__ as entry
from groundmetrics.llm import decontaminate
from groundmetrics.operators import panels as pn
from groundmetrics.operators import timeline as tl


def last_first(values):
    total = 0.0
    for v in reversed(values):
        total += v
    return total / len(values)


def test_neighbours_are_added_from_the_last_to_the_first(spark):
    steps = [0.1, 0.2, 0.3]
    rows = [("a", 0, 100, (0.0, 0.0, 0.0))] + [("a", i + 1, 100 + 10 * (i + 1), (x, 0.0, 0.0)) for i, x in enumerate(steps)]
    want = last_first([math.sqrt(x * x) for x in steps])
    assert want != last_first([math.sqrt(x * x) for x in reversed(steps)])
    for given in (rows, rows[::-1]):
        # both in one bucket of the window and over three of them
        for shift in (0, 870):
            s = spark.createDataFrame([(k, q, t + shift, p) for k, q, t, p in given], "k string, file_seq bigint, t_us bigint, p struct<x:double,y:double,z:double>").coalesce(1)
            got = tl.neighbour_stats(s.filter("file_seq = 0").select("k", "t_us", "p"), s, ["k"], 1000, ["p"]).collect()
            assert [(r.p_move, r.p_neighbours) for r in got] == [(want, 3)]


def test_pixel_means_are_added_from_the_last_to_the_first(spark):
    steps = [0.1, 0.2, 0.3]
    rows = [("a", 0, 100, (0.0, 0.0), (0.0, 0.0, 0.0))] + [("a", i + 1, 100 + 10 * (i + 1), (x, 0.0), (x, 0.0, 0.0)) for i, x in enumerate(steps)]
    want = last_first([math.sqrt(x * x) for x in steps])
    for given in (rows, rows[::-1]):
        s = spark.createDataFrame(given, "k string, file_seq bigint, t_us bigint, gaze_uv struct<u:double,v:double>, camera struct<x:double,y:double,z:double>").coalesce(1)
        got = tl.pixel_stats(s.filter("file_seq = 0"), s, ["k"], 1000, 1, 1).collect()
        assert [(r.gaze_move, r.camera_move) for r in got] == [(want, want)]


PANELS = "scene string, row_index bigint, panel_id string, panel_index int, video_time double, panel_score double"


def test_panels_of_all_strategies_come_from_one_shuffle(spark):
    rows = [("s", 1, "P1", 1, 0.0, 0.2), ("s", 1, "P2", 2, 1.0, 0.9), ("s", 1, "P3", 3, 2.0, 0.9), ("s", 1, "P3", 3, 1.5, 0.1), ("s", 1, "P4", 4, 3.0, None),
            ("s", 2, "P5", 5, 0.0, None), ("t", 1, "P1", 1, 0.0, 0.5), ("t", 1, "P2", 2, 0.0, 0.5)]
    m = spark.createDataFrame(rows, PANELS)
    out = pn.choose_panels(m)
    want = {("s", 1, "first", "P1"), ("s", 1, "middle", "P3"), ("s", 1, "highest_score", "P2"), ("s", 2, "first", "P5"), ("s", 2, "middle", "P5"),
            ("s", 2, "highest_score", "P5"), ("t", 1, "first", "P1"), ("t", 1, "middle", "P2"), ("t", 1, "highest_score", "P1")}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert tuple(pn.choose_panel(m, "middle").filter("scene = 's' AND row_index = 1").first()) == ("s", 1, "P3", 3, 1.5, 0.1)


def test_choose_panel_moves_line_items_once(spark):
    query = entry.queries()["choose_panel"]
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("/lineitem.parquet") == 1


def test_latent_basis_is_fitted_on_every_document(spark):
    # a sample by a hash of the text leaves a text out with all its copies, however many there are
    texts = [f"word{i} " * 20 for i in range(60)]
    docs = spark.createDataFrame([(i, texts[i % 60]) for i in range(12600)], "doc_id long, text string")
    items = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "item_id long, text string")
    index = decontaminate.build(docs, items)
    size = np.linalg.norm(index.basis[[decontaminate.features_of(x.split()[0].encode())[0] for x in texts]], axis=1)
    assert size.min() > 0.1 * size.max()


def test_gram_of_all_passages_equals_the_plain_one(spark):
    rng = np.random.default_rng(3)
    lengths = [0, 1, 15, 16, 17, 32, 33, 500, 70_000]
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 300, n)) for n in lengths] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    feats = decontaminate.feature_table(docs)
    df, n = decontaminate.document_frequency(feats)
    assert n == len(texts) and df[decontaminate.features_of(b"w7")[0]] >= 2
    x, idf = rng.standard_normal((decontaminate.FEATURES, 3)).astype(np.float32), rng.random(decontaminate.FEATURES).astype(np.float32)
    want = np.zeros((decontaminate.FEATURES, 3))
    for text in texts:
        f = decontaminate.features_of(decontaminate.words_of(text or ""))
        step, span = decontaminate.STRIDE, decontaminate.SPAN * decontaminate.STRIDE
        for at in range(0, max(len(f) - step, 1) if len(f) else 0, step):
            part = f[at : at + span]
            np.add.at(want, part, (idf[part, None] * x[part]).sum(0, dtype=np.float64))
    want *= idf[:, None]
    got = decontaminate.gram_times(feats, idf, x)
    assert np.abs(got - want).max() <= 1e-5 * np.abs(want).max()


def test_vectors_leave_no_finding_out(spark):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[40:60])
    texts = [" ".join(words), " ".join(words[:39]), item, " ".join(words[40:57]), " ".join(words[45:60][::-1]), ""]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    index = decontaminate.build(docs, items)
    want = [{0: 1.0}, {}, {0: 1.0}, {0: 0.85}, {}, {}]
    for turned in (index.vectors, -index.vectors):
        index.vectors = turned
        found = [decontaminate.matches(t.encode(), decontaminate.features_of(t.encode()), index) for t in texts]
        assert found == want
