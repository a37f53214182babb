"""Loads by commits, and the key index of the store."""

import os
import re

import pytest
from pyspark.sql import functions as F

from opsmetrics.operators import ingest
from opsmetrics.sources import OperationsStore
from tests.conftest import rows


def ops(spark, keys, owner="O"):
    return spark.createDataFrame([(k, owner) for k in keys], "file string, operativo string")


def stored(store):
    return rows(store.read(), "file", "operativo")


def test_two_interleaved_loads_store_a_key_once(spark, tmpdir_path):
    one, two = OperationsStore(spark, f"{tmpdir_path}/s"), OperationsStore(spark, f"{tmpdir_path}/s")
    first = one.begin(ops(spark, ["A", "B"], "ONE"))
    second = two.begin(ops(spark, ["B", "C"], "TWO"))
    assert stored(one) == []  # nothing is seen before a commit
    assert two.commit(second) == 2
    assert one.commit(first) == 1
    assert stored(one) == stored(two) == [("A", "ONE"), ("B", "TWO"), ("C", "TWO")]
    assert one.append(ops(spark, ["A", "B", "C"])) == 0 and one.snapshot().version == 2


def test_many_loads_from_one_version(spark, tmpdir_path):
    store = OperationsStore(spark, f"{tmpdir_path}/s")
    loads = [store.begin(ops(spark, [f"K{i}", f"K{i + 1}"], f"L{i}")) for i in range(4)]
    store.refresh_index(4)
    assert [store.commit(load) for load in loads] == [2, 1, 1, 1]
    assert [k for k, _ in stored(store)] == [f"K{i}" for i in range(5)]


def test_a_load_killed_half_way_leaves_no_row(spark, tmpdir_path):
    store = OperationsStore(spark, f"{tmpdir_path}/s")
    store.append(ops(spark, ["A"]))
    store.begin(ops(spark, ["B"]))  # never commits
    broken = ops(spark, ["C"]).withColumn("operativo", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        store.append(broken)
    draft = f"{tmpdir_path}/s/commits/.draft"
    with open(draft, "w") as fh:  # a commit file that was never put in place
        fh.write('{"version": 9, "load": "x"}')
    assert [k for k, _ in stored(store)] == ["A"] and store.snapshot().version == 1
    assert store.append(ops(spark, ["B", "C"])) == 2


def test_a_version_can_be_taken_once(spark, tmpdir_path):
    store = OperationsStore(spark, f"{tmpdir_path}/s")
    assert store._commit(1, load="a", rows=1) and not store._commit(1, load="b", rows=1)
    assert store.snapshot().loads == {"a": 1}
    assert sorted(f for f in os.listdir(f"{tmpdir_path}/s/commits") if not f.endswith(".crc")) == ["00000000000000000001.json"]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_index_and_no_index_agree(spark, tmpdir_path, limit):
    store = OperationsStore(spark, f"{tmpdir_path}/s", broadcast_bytes=limit)
    asked = spark.createDataFrame([(k,) for k in ["K1", "K7", "K7", "K250", "NEW", "", None, "LATE"]], "file string")
    known = [("K1",), ("K250",), ("K7",)]
    store.append(ops(spark, [f" k{i} " for i in range(300)]))  # matched by their normalised form
    assert rows(store.stored_keys(asked)) == known
    store.refresh_index(8)
    assert rows(store.stored_keys(asked)) == known
    store.append(ops(spark, ["LATE"]))
    assert rows(store.stored_keys(asked)) == [*known, ("LATE",)]
    store.refresh_index(5)
    assert store.snapshot().covers == 3 and rows(store.stored_keys(asked)) == [*known, ("LATE",)]
    assert rows(store.stored_keys(asked.where("false"))) == []


def joins_by_shuffle(*frames):
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan, plan


def test_many_keys_are_never_broadcast(spark, tmpdir_path):
    store = OperationsStore(spark, f"{tmpdir_path}/s", broadcast_bytes=0)
    store.append(ops(spark, [f"K{i}" for i in range(50)]))
    store.refresh_index(4)
    store.append(ops(spark, ["K1", "LATE"]))
    found = store.stored_keys(ops(spark, ["K1", "LATE", "NONE"]))
    upload = spark.createDataFrame([("k1", 1), ("new1", 2)], "File string, _ordinal bigint")
    split = ingest.analyze_upload(upload, store)
    assert rows(split.new, "file") == [("NEW1",)] and rows(split.existing, "file") == [("K1",)]
    assert rows(found) == [("K1",), ("LATE",)]
    joins_by_shuffle(found, split.new, split.existing)


def test_loads_of_many_keys_are_never_broadcast(spark, tmpdir_path):
    store = OperationsStore(spark, f"{tmpdir_path}/s", broadcast_bytes=0)
    staged, stage = [], store._stage
    store._stage = lambda frame, seen: staged.append(frame) or stage(frame, seen)
    one, two = store.begin(ops(spark, ["K2", "NEW"])), store.begin(ops(spark, ["K3", "NEW", "MORE"]))
    assert (store.commit(two), store.commit(one)) == (3, 1) and len(staged) == 3
    assert [k for k, _ in stored(store)] == ["K2", "K3", "MORE", "NEW"]
    joins_by_shuffle(*staged)


def test_a_load_of_many_keys_is_one_join(spark, tmpdir_path):
    store = OperationsStore(spark, f"{tmpdir_path}/s", broadcast_bytes=0)
    staged, stage = [], store._stage
    store._stage = lambda frame, seen: staged.append(frame) or stage(frame, seen)
    store.append(ops(spark, [" k1 ", "K2"]))
    assert not os.path.exists(f"{tmpdir_path}/s/staging")  # nothing to compare with
    store.refresh_index(4)
    store.append(ops(spark, ["LATE"]))
    assert store.append(ops(spark, ["K1", "K2", "LATE", "NEW"])) == 1
    plan = staged[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan, plan


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_odd_keys_and_dates_of_a_load(spark, tmpdir_path, limit):
    store = OperationsStore(spark, f"{tmpdir_path}/s", broadcast_bytes=limit)
    store.append(ops(spark, [" k1 ", "  ", "", None]))
    store.refresh_index(4)
    store.append(ops(spark, ["late", "\t"]))
    keys = ["K1", "LATE", "", None, "NEW", "BAD"]
    frame = spark.createDataFrame([(k, "bad-date" if k == "BAD" else "2024/02/03 10:30") for k in keys], "file string, fecha_file string")
    assert store.append(frame.withColumn("fecha_cierre", F.lit(None)).withColumn("other", F.lit(1))) == 4
    got = store.read().where("file is null or file in ('', 'NEW', 'BAD')").select("file", F.col("fecha_file").cast("string")).collect()
    day = "2024-02-03 10:30:00"
    want = [(None, None), ("", None), ("BAD", None), (None, day), ("", day), ("NEW", day)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert rows(store.read().select("fecha_cierre").distinct()) == [(None,)]


def test_the_upload_reads_its_buckets_and_shuffles_no_stored_key(spark, tmpdir_path):
    store = OperationsStore(spark, f"{tmpdir_path}/s")
    store.append(ops(spark, [f"K{i}" for i in range(500)]))
    store.refresh_index(16)
    base = store._base(store.snapshot())
    assert base.select("bucket").distinct().count() == 16
    found = store.stored_keys(ops(spark, ["K3", "NEW"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"keys/base=.*PartitionFilters: \[[^]]*dynamicpruning", plan), plan
    assert rows(found) == [("K3",)]
    done = found._jdf.queryExecution().executedPlan().toString()
    final = done[: done.index("Initial Plan")] if "Initial Plan" in done else done
    assert "SortMergeJoin" not in final and "ShuffledHashJoin" not in final


def test_upload_against_a_store_equals_that_against_a_table(spark, tmpdir_path):
    raw = spark.createDataFrame(
        [("a", 1, "x"), ("A ", 2, None), ("b", 3, "y"), ("c", 4, ""), ("nan", 5, "z"), (" d", 6, "w")], "File string, _ordinal bigint, Operativo string"
    )
    table = ops(spark, [" b ", "d"])
    store = OperationsStore(spark, f"{tmpdir_path}/s")
    store.append(table)
    store.refresh_index(3)
    one, two = ingest.analyze_upload(raw, table), ingest.analyze_upload(raw, store)
    for part in ("new", "existing", "duplicates", "quality", "counts"):
        assert rows(getattr(one, part)) == rows(getattr(two, part)), part
    assert rows(one.new, "file") == [("A",), ("C",)]
    assert store.append(two.new) == 2 and [k for k, _ in stored(store)] == [" b ", "A", "C", "d"]


def test_summary_takes_the_fields_of_the_first_copy(spark):
    data = [("A", None, "NO ESPECIFICADO"), ("A", 3, "X"), ("B", 2, "NO ESPECIFICADO"), ("B", 5, "Y"), ("C", 1, "NO ESPECIFICADO")]
    valid = spark.createDataFrame(data, "file string, _ordinal bigint, operativo string")
    stored_keys = spark.createDataFrame([("C",), ("C",), ("Z",)], "file string")
    got = ingest.upload_summary(valid, stored_keys, fields=["operativo"]).first()
    assert tuple(got) == (2, 1, 4, [1])
