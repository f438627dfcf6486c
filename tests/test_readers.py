"""Delimited files with headers of their own, split anywhere, against the csv module."""

import csv
import io
import random

import pytest

from groundmetrics.sources import readers as rd


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("190", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def write(path, sep, header, rows, bom=False, quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator="\n", quoting=quoting)
    w.writerow(header)
    w.writerows([[r.get(h, "") for h in header] for r in rows])
    path.write_text(("﻿" if bom else "") + out.getvalue(), encoding="utf-8")


def test_files_of_any_header_and_separator(spark, tmp_path, tiny_splits):
    r = random.Random(5)
    words = ["plain", "two words", 'say "hi"', "a,b", "x\ty", "semi;colon", "first\nsecond", 'q"\n\n"r, \ts', "5 in", "\n", '"', ""]
    data = [{"id": str(i), "name": r.choice(words), "note": r.choice(words), "v": str(i / 4)} for i in range(150)]
    write(tmp_path / "a.csv", ",", ["id", "name", "note", "v"], data[:60], bom=True)
    write(tmp_path / "b.tsv", "\t", ["v", "note", "id", "name"], data[60:100])
    write(tmp_path / "c.csv", ";", ["name", "id", "v"], data[100:130], quoting=csv.QUOTE_ALL)
    write(tmp_path / "d.csv", ",", ["id", "note", "extra"], data[130:])
    (tmp_path / "e.csv").write_text("")
    df = rd.read_delimited(spark, str(tmp_path), types={"v": "double"}, source=True)
    assert set(df.columns) == {"file_path", "block", "_id", "id", "name", "note", "v", "extra"}
    got = {x.id: (x.name or "", x.note or "", x.v) for x in df.collect()}
    assert df.count() == 150 and df.select("file_path", "block").distinct().count() > 12
    for i, d in enumerate(data):
        want = (d["name"] if i < 130 else "", d["note"] if i < 100 or i >= 130 else "", i / 4 if i < 130 else None)
        assert got[str(i)] == want, d


def test_stray_and_unclosed_quotes(spark, tmp_path, tiny_splits):
    lines = ["id,name"] + [f'{i},box 5" wide {i}' for i in range(30)] + ['30,"never closed'] + [f"{i},tail" for i in range(31, 60)]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "y.csv").write_text("id,name\n90\n91,b,c\n")
    got = {r.id: r.name for r in rd.read_delimited(spark, str(tmp_path)).collect()}
    assert set(got) == {str(i) for i in range(60)} | {"90", "91"}
    assert got["3"] == 'box 5" wide 3' and got["45"] == "tail" and got["90"] is None and got["91"] == "b"


def test_inventories_of_any_header(spark, tmp_path):
    (tmp_path / "one_anchor_table.tsv").write_text("object_name\tx_world\ty_world\tz_world\taliases\nbox\t1\t2\t3\tcrate; red box\ncup\t4\t5\t6\t\n")
    (tmp_path / "two_anchor_table.csv").write_text('z,y,anchor_id,x\n3,2,"big\nbox",1\n,2,gone,1\n9,8,cup,7\n')
    rows = rd.read_anchors(spark, str(tmp_path)).sort("scene", "anchor_seq").collect()
    assert [(r.scene, r.anchor_id, r.x, r.z, r.aliases) for r in rows] == [
        ("one", "box", 1.0, 3.0, ["crate", "red box"]), ("one", "cup", 4.0, 6.0, []), ("two", "big\nbox", 1.0, 3.0, []), ("two", "cup", 7.0, 9.0, [])]
