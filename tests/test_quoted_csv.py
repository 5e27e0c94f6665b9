"""Quoted CSV cut into blocks of any size, against the csv module."""

import csv
import random

import pytest
from pyspark.errors import AnalysisException

from souqlytics.sources.quoted import open_after, read_quoted

VALUES = ["", "plain", '5" screen', 'a "q" b', "two\nlines\n\nmore", "x,y", "é漢", "long " * 150, '"', '""\n"', "\n", ","]


@pytest.mark.parametrize("block", [64, 700, 1 << 20])
def test_blocks_do_not_show(spark, tmp_path, block):
    rng, want = random.Random(block), []
    for f in range(3):
        names = ["id", "title_fa", "Brand"] + (["more, \"x\"\n y"] if f == 2 else [])
        rng.shuffle(names)
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.DictWriter(out, names, lineterminator="\r\n" if f == 1 else "\n")
            writer.writeheader()
            for i in range(12):
                row = {n: rng.choice(VALUES) for n in names} | {"id": f"{f}-{i}"}
                writer.writerow(row)
                want.append((f, i, row))
    known = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        df = read_quoted(spark, str(tmp_path), "_at")
        got = {r["id"]: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", known)
    assert len(got) == len(want)
    for _, _, row in want:
        assert {n: got[row["id"]][n] or "" for n in row} == row
    # places follow the order in each file
    for f in range(3):
        ids = sorted((tuple(r["_at"]), int(i.split("-")[1])) for i, r in got.items() if i.startswith(f"{f}-"))
        assert [i for _, i in ids] == list(range(12))


def test_lines_alone_and_missing_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid,b\n1,x\n\n2,\"y\"\n3\n")
    got = read_quoted(spark, str(tmp_path), "_at", multi_line=False).drop("_at").collect()
    assert sorted(tuple(r) for r in got) == sorted([("1", "x"), ("2", "y"), ("3", None)], key=str)
    (tmp_path / "b.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError):
        read_quoted(spark, str(tmp_path), "_at")
    with pytest.raises(AnalysisException):
        read_quoted(spark, str(tmp_path / "none"), "_at")


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a""', True, False), ('"a"",b', True, False), ('x","y"', False, False),
    ('""', False, True), ('"', True, False), ('a,"b,c', True, False), ('a","b', True, True), ('"a"b"c,d', False, False),
])
def test_what_a_line_leaves_open(line, outside, inside):
    assert open_after(line, False) == outside
    assert open_after(line, True) == inside
