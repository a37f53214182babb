"""CSV files with line breaks in quotes, read by many tasks, and the numbers of their rows."""

import csv
import io
import os
import random

import pytest

from opsmetrics.sources import read_upload
from opsmetrics.sources.sheets import number_rows
from tests.conftest import rows

SPLIT = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in (SPLIT, COST)}
    spark.conf.set(COST, "0")
    yield lambda size: spark.conf.set(SPLIT, str(size))
    for k, v in before.items():
        spark.conf.set(k, v)


def sheet(seed, n=300, end="\n"):
    """Rows and their CSV text: quotes, separators, line breaks, empty values and empty lines."""
    rng = random.Random(seed)
    pieces = ["a", "bc", '"', ",", "\n", "\r\n", " ", "é", "漢", '""', "x" * 40, "\n\n"]
    data = [["".join(rng.choices(pieces, k=rng.randrange(0, 6))) for _ in range(3)] for _ in range(n)]
    for r in data:
        r[0] = f"k{r[0]}"
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["Clave", "Dos partes", "c3"])
    for i, r in enumerate(data):
        writer.writerow(r)
        if i % 17 == 0:
            out.write(end)
    return data, out.getvalue()


@pytest.mark.parametrize("seed, size, end", [(1, 700, "\n"), (2, 64, "\n"), (3, 1500, "\r\n"), (4, 1 << 20, "\n")])
def test_equal_to_the_multiline_reader(spark, tmpdir_path, small_splits, seed, size, end):
    wanted = []
    for name in ("b.csv", "a.csv", "c.csv"):
        data, text = sheet(seed * 10 + len(wanted) % 7, end=end)
        with open(f"{tmpdir_path}/{name}", "w", newline="", encoding="utf-8") as fh:
            fh.write(text.rstrip("\r\n") if name == "c.csv" else text)  # the last line may lack its end
        wanted.append((name, data))
    small_splits(size)
    got = read_upload(spark, tmpdir_path)
    whole = spark.read.csv(tmpdir_path, header=True, escape='"', multiLine=True)
    assert got.columns == ["Clave", "Dos partes", "c3", "_ordinal"]
    if end == "\n":  # Spark's reader turns CRLF inside values into LF if lines end with CRLF
        assert rows(got.drop("_ordinal")) == rows(whole)
    in_order = [tuple(v or None for v in r) for _, data in sorted(wanted) for r in data]
    out = sorted(got.collect(), key=lambda r: r["_ordinal"])
    assert [r["_ordinal"] for r in out] == list(range(len(in_order)))
    assert [tuple(r)[:3] for r in out] == in_order
    if size < 1 << 20:
        assert got.rdd.getNumPartitions() > 3


def test_a_value_longer_than_many_splits(spark, tmpdir_path, small_splits):
    long = "\n".join(f"line {i}" for i in range(2000))
    with open(f"{tmpdir_path}/s.csv", "w", newline="") as fh:
        fh.write(f'a,b\n1,"{long}"\n2,x\n3,"left open\nto the end\n')
    with open(f"{tmpdir_path}/t.csv", "w", newline="") as fh:
        fh.write("a,b\n4,y\n")
    small_splits(512)
    out = sorted(map(tuple, read_upload(spark, tmpdir_path).collect()), key=lambda r: r[2])
    assert [(r[0], r[2]) for r in out] == [("1", 0), ("2", 1), ("3", 2), ("4", 3)]
    assert out[0][1] == long and out[2][1].startswith("left open\nto the end")


def test_files_without_rows(spark, tmpdir_path):
    for name, text in (("a.csv", "x,y\n"), ("b.csv", "x,y\n1,2"), ("c.csv", "x,y\n\n\n")):
        with open(f"{tmpdir_path}/{name}", "w") as fh:
            fh.write(text)
    assert rows(read_upload(spark, tmpdir_path)) == [("1", "2", 0)]
    os.makedirs(f"{tmpdir_path}/other")
    with open(f"{tmpdir_path}/other/a.csv", "w") as fh:
        fh.write("x,y\n")
    empty = read_upload(spark, f"{tmpdir_path}/other")
    assert empty.columns == ["x", "y", "_ordinal"] and empty.count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_numbers_do_not_depend_on_the_splits(spark, tmpdir_path, small_splits, fmt):
    path = f"{tmpdir_path}/in"
    df = spark.range(0, 5000, 1, 3).selectExpr("cast(id as string) AS v", "repeat('x', cast(id % 40 as int)) AS w")
    df.write.option("header", "true").format(fmt).save(path)
    seen = []
    for size in (1 << 27, 9000, 2000):
        small_splits(size)
        got = read_upload(spark, path, fmt=fmt, multi_line=False) if fmt == "csv" else read_upload(spark, path, fmt=fmt)
        seen.append(sorted((r["_ordinal"], r["v"]) for r in got.collect()))
    assert seen[0] == seen[1] == seen[2] == [(i, str(i)) for i in range(5000)]
    assert number_rows(spark.read.format(fmt).option("header", "true").load(path)).count() == 5000
