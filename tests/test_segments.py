"""Segments of event timelines: batch and live, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from groundmetrics.operators import timeline as tl
from groundmetrics.streaming import jobs

KEYS = ["scene", "row_index"]
POINT = "struct<x:double,y:double,z:double>"
SCHEMA = f"scene string, row_index bigint, t_us bigint, file_seq bigint, gaze {POINT}, gaze_origin {POINT}, gaze_vector {POINT}, hand_hit {POINT}"
ANCHORS = [("s", "a", 0.0, 0.0, 0.0), ("s", "b", 4.0, 0.0, 0.0), ("s", "c", 0.0, 4.0, 0.0), ("s", "d", 4.0, 4.0, 0.0), ("s", "d", 9.0, 9.0, 0.0), ("other", "e", 0.0, 0.0, 0.0)]
EVENTS = [("s", 0, 100, 4_300_100), ("s", 1, 0, 2_000_000), ("s", 2, 5, 5), ("bare", 3, 0, 9_000_000)]
DURATION = 500_000


def feed(n=400, seed=3):
    r = random.Random(seed)
    point = lambda: tuple(float(r.randrange(5)) for _ in range(3))
    out = []
    for i in range(n):
        scene, key = r.choice([("s", 0), ("s", 0), ("s", 1), ("bare", 3)])
        gaze = point() if r.random() < 0.7 else None
        out.append((scene, key, r.randrange(46) * 100_000, i, gaze, point() if r.random() < 0.5 else None, None, point() if r.random() < 0.3 else None))
    return out


def plain(samples, top=3):
    """Segment by segment, sample by sample."""
    found = {}
    for scene, key, start, end in EVENTS:
        anchors = [a for a in ANCHORS if a[0] == scene]
        own = sorted((s for s in samples if (s[0], s[1]) == (scene, key)), key=lambda s: (s[2], s[3]))
        at = start
        while at < end and anchors:
            stop = min(at + DURATION, end)
            here = [s for s in own if at <= s[2] < stop]
            eyes = [s for s in here if s[4]]
            if len(eyes) >= 2:
                stats = []
                for a in anchors:
                    d = [math.sqrt(sum((p - q) ** 2 for p, q in zip(s[4], a[2:]))) for s in eyes]
                    stats.append((min(d), -sum(x <= min(d) + 0.75 for x in d), a[1], eyes[d.index(min(d))][2]))
                stats.sort(key=lambda s: s[:3])
                near = min(eyes, key=lambda s: abs(s[2] - stats[0][3]))
                middle = eyes[len(eyes) // 2]
                cues = [near] + ([middle] if abs(middle[2] - near[2]) > 1000 else [])
                found[(key, (at - start) // DURATION)] = (
                    at, stop, stats[0][3], len(eyes), sum(s[7] is not None for s in here), round(stats[0][0], 9),
                    [(s[2], -s[1], s[3]) for s in stats[:top]], [(s[2], s[4], s[5]) for s in cues], round(len(eyes) / (1 + stats[0][0]), 9))
            at += DURATION
    return found


def told(rows):
    flat = lambda p: None if p is None else tuple(p)
    out = {}
    for r in rows:
        assert (r.row_index, r.segment) not in out
        out[(r.row_index, r.segment)] = (
            r.start_us, r.end_us, r.t_us, r.n_gaze, r.n_hand, round(r.best_d, 9), [(n.anchor_id, n.close_frames, n.nearest_us) for n in r.nearest],
            [(e.t_us, flat(e.gaze), flat(e.gaze_origin)) for e in r.eye_cues], round(r.score, 9))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    events = spark.createDataFrame(EVENTS, "scene string, row_index bigint, t_start bigint, t_end bigint")
    return events, spark.createDataFrame(ANCHORS, "scene string, anchor_id string, x double, y double, z double")


def test_segments_equal_a_plain_walk(spark, tables):
    events, anchors = tables
    samples = feed()
    got = told(tl.timeline_segments(events, spark.createDataFrame(samples, SCHEMA), anchors, KEYS, KEYS, DURATION, 300_000).collect())
    want = plain(samples)
    assert len(want) > 8 and got == want and any(len(v[7]) == 2 for v in want.values())
    none = tl.timeline_segments(events, spark.createDataFrame([], SCHEMA), anchors, KEYS, KEYS, DURATION, 300_000)
    assert none.count() == 0


def test_missing_windows_are_those_of_the_samples(spark):
    events = spark.createDataFrame([("s", 0, None, 5), ("s", 1, 2, None), ("s", 9, None, None)], "scene string, row_index bigint, t_start bigint, t_end bigint")
    samples = spark.createDataFrame([("s", 0, 3), ("s", 0, 8), ("s", 1, 1), ("s", 1, 7)], "scene string, row_index bigint, t_us bigint")
    assert {tuple(r) for r in tl.fill_windows(events, samples, KEYS).collect()} == {("s", 0, 3, 5), ("s", 1, 2, 7), ("s", 9, None, None)}


def run(spark, tables, folder, batches, delay):
    """Write one file per batch, replay them in order, return the emitted segments."""
    events, anchors = tables
    land = folder / "land"
    for i, rows in enumerate(batches):
        part = folder / f"part{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(part))
        land.mkdir(exist_ok=True)
        file = next(part.glob("*.json"))
        file.rename(land / f"{i}.json")
        __import__("os").utime(land / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(land))
    live = jobs.live_segments(events, stream, anchors, KEYS, KEYS, DURATION, 300_000, delay)
    out = str(folder / "out")
    q = live.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(folder / "mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    return told(spark.read.parquet(out).collect())


def test_replay_equals_batch(spark, tables, tmp_path):
    samples = feed()
    # rows out of order by up to the delay; the last segment of all stays open
    batches = [samples[:130], samples[130:300], samples[300:]]
    want = plain(samples)
    last = max(v[1] for v in want.values())
    got = run(spark, tables, tmp_path, batches, "5 seconds")
    assert got == {}
    tick = [("s", 0, 4_300_000, 10_000, None, None, None, (1.0, 1.0, 1.0))]
    samples.sort(key=lambda s: s[2])
    batches = [samples[:130], samples[130:300], samples[300:], tick]
    (tmp_path / "sorted").mkdir()
    got = run(spark, tables, tmp_path / "sorted", batches, "1 second")
    closed = {k: v for k, v in want.items() if v[1] < last - 1_000_000}
    assert len(closed) > 5 and {k: got[k] for k in closed} == closed and set(got) <= set(want)


def test_late_samples_are_dropped(spark, tables, tmp_path):
    eye = lambda t, i: ("s", 0, t, i, (1.0, 1.0, 1.0), None, None, None)
    early, far = [eye(200_000, 1), eye(300_000, 2)], [eye(4_000_000, 3), eye(4_100_000, 4)]
    # the segment is emitted by the third batch, which still counts its own rows; the fourth one's sample comes too late
    got = run(spark, tables, tmp_path, [early, far, [eye(250_000, 5)], [eye(260_000, 6)], [eye(4_200_000, 7)]], "1 second")
    assert set(got) == {(0, 0)} and got[(0, 0)][3] == 3
