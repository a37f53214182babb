"""Run in its own process: task attempts fail once and are retried from lineage;
results must equal an undisturbed run. Prints RETRY-OK on success."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark import TaskContext  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402

from opsmetrics import build_session  # noqa: E402
from opsmetrics.operators import allocation, ingest, sessions  # noqa: E402
from opsmetrics.plans import fixtures as fx  # noqa: E402

SF = sys.argv[1]


def flaky(df: DataFrame) -> DataFrame:
    """Pass rows through; the first attempt of every even partition fails."""

    def fn(batches):
        ctx = TaskContext.get()
        if ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
            raise RuntimeError("injected task failure")
        yield from batches

    return df.repartition(4).mapInPandas(fn, schema=df.schema)


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def main():
    spark = build_session("local[4,3]", shuffle_partitions=4)
    spark.sparkContext.setLogLevel("WARN")  # lost tasks are reported at WARN
    raw = fx.raw_upload(spark, SF)
    stored = fx.existing_ops(spark, SF)
    ops = fx.operations(spark, SF)
    events = fx.events_with_user(spark, SF)
    cols = ["file", "cliente", "tipo", "operativo", "comercial", "estado"]
    checks = {
        "ingest_new": (ingest.analyze_upload(raw, stored).new.select(*cols), ingest.analyze_upload(flaky(raw), stored).new.select(*cols)),
        "allocation": (allocation.allocation_guide(ops, sort=False), allocation.allocation_guide(flaky(ops), sort=False)),
        "sessions": (sessions.sessionize(events), sessions.sessionize(flaky(events))),
    }
    for name, (plain, retried) in checks.items():
        a, b = rows(plain), rows(retried)
        assert a == b, f"{name}: {len(a)} vs {len(b)} rows differ after retries"
    print("RETRY-OK")


if __name__ == "__main__":
    main()
