"""Stored operations that several loads can write to at once, with an index of their keys.

Layout below one folder:

* ``data/load=<id>``: the rows of one load, written once and never changed;
* ``commits/<version>.json``: one small file for each version. It names a load, or a
  new key index. The file with the next number can be created once only, so of
  two loads that started from the same version one finds its number taken;
* ``keys/base=<id>/bucket=<b>``: the distinct normalised keys of all loads up to a
  version, in folders by hash of the key.

Readers take committed loads only: a load that died half way leaves no row. A load
that finds its number taken splits its rows again, against the loads committed
meanwhile, and tries the next number.

An upload meets the index bucket by bucket: its keys are broadcast if their size,
which is counted first, allows it; the scan then reads the buckets that
occur in the upload (dynamic partition pruning) and no stored key is shuffled.
Beyond that size the keys are joined by shuffle, whatever size the optimizer
estimates: it takes a key for an even share of its row, but other columns may hold
next to nothing. Loads newer than the index are
read from their rows, so the answer is the same with an old index, or without one.

A load counts its keys while it is staged. If they are many, its rows meet all
stored keys in one join: no key is made distinct or joined before that.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import NamedTuple
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics import schema
from opsmetrics.sources.readers import coerce_dates, stored_key_values
from opsmetrics.sources.sinks import to_contract

_COMMIT = "version bigint, load string, rows bigint, base string, buckets int, covers bigint"


class Snapshot(NamedTuple):
    """What a version of the store holds."""

    version: int
    loads: dict[str, int]  # load id and the version that committed it
    base: str | None
    buckets: int
    covers: int  # the index has the keys of loads up to this version

    def newer_than(self, version: int) -> list[str]:
        return [load for load, at in self.loads.items() if at > version]


class Load(NamedTuple):
    """Rows written to the store, not committed yet."""

    load: str
    rows: int
    seen: int  # the version whose keys the rows were split against


def key_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class OperationsStore:
    """Operations below ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "file", broadcast_bytes: int = 64 << 20):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.broadcast_bytes = broadcast_bytes
        self._folder("commits")

    # ------------------------------------------------------------- versions ---
    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, name: str) -> None:
        target, fs = self._hadoop(f"{self.path}/{name}")
        fs.mkdirs(target)

    def _create_once(self, name: str, text: str) -> bool:
        """Create a file with this text, whole and only if there is none; False if there is one."""
        draft = f"{self.path}/commits/.{uuid.uuid4().hex}"
        source, fs = self._hadoop(draft)
        out = fs.create(source)
        out.write(text.encode())
        out.close()
        target, _ = self._hadoop(f"{self.path}/commits/{name}")
        try:
            if fs.getScheme() == "file":  # a rename replaces here, a link does not
                local = lambda p: unquote(urlparse(p.toUri().toString()).path)
                os.link(local(source), local(target))
                return True
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, options)
            return True
        except Exception:
            if fs.exists(target):
                return False
            raise
        finally:
            fs.delete(source, False)

    def snapshot(self) -> Snapshot:
        """The newest version. A row for each commit comes to the driver, never data."""
        commits = self.spark.read.schema(_COMMIT).json(f"{self.path}/commits").orderBy("version").collect()
        loads = {c.load: c.version for c in commits if c.load is not None}
        bases = [c for c in commits if c.base is not None]
        newest = max(bases, key=lambda c: c.covers, default=None)
        version = commits[-1].version if commits else 0
        if newest is None:
            return Snapshot(version, loads, None, 0, 0)
        return Snapshot(version, loads, newest.base, newest.buckets, newest.covers)

    def _commit(self, version: int, **entry) -> bool:
        return self._create_once(f"{version:020d}.json", json.dumps({"version": version, **entry}))

    # ----------------------------------------------------------------- rows ---
    def _rows(self, loads: list[str]) -> DataFrame:
        if not loads:
            return self.spark.createDataFrame([], schema.OPERATIONS)
        return self.spark.read.schema(schema.OPERATIONS).parquet(*(f"{self.path}/data/load={load}" for load in loads))

    def read(self, at: Snapshot | None = None) -> DataFrame:
        """All committed operations."""
        return self._rows(list((at or self.snapshot()).loads))

    # ----------------------------------------------------------------- keys ---
    def _base(self, at: Snapshot) -> DataFrame:
        return self.spark.read.schema(f"{self.key} string, bucket int").parquet(f"{self.path}/keys/base={at.base}")

    def _size(self) -> list[Column]:
        return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(self.key)), F.lit(0)).alias("size")]

    def _few(self, keys: DataFrame) -> bool:
        """Whether distinct keys are small enough to broadcast; counted, not estimated."""
        n, size = keys.agg(*self._size()).first()
        return 64 * n + size <= self.broadcast_bytes

    def _sized(self, keys: DataFrame) -> DataFrame:
        """The keys as one side of a join: broadcast if they are few, else never."""
        return F.broadcast(keys) if self._few(keys) else keys.hint("merge")

    def stored_keys(self, keys: DataFrame, at: Snapshot | None = None, few: bool | None = None) -> DataFrame:
        """Those of the (normalised) keys that are stored, each once.

        ``keys`` is read twice, once to find its size (unless ``few`` tells whether they can be
        broadcast): give it a written frame. Many keys also make a join with the result one by shuffle.
        """
        at = at or self.snapshot()
        # the comparison also tells the optimizer that this side is worth pruning by
        wanted = keys.select(self.key).where(F.col(self.key) > F.lit("")).distinct()
        few = self._few(wanted) if few is None else few
        hint = F.broadcast if few else (lambda df: df.hint("merge"))
        found = stored_key_values(self._rows(at.newer_than(at.covers)), self.key).join(hint(wanted), self.key, "left_semi")
        if at.base is not None:
            placed = wanted.withColumn("bucket", key_bucket(F.col(self.key), at.buckets))
            found = found.unionByName(
                self._base(at).join(hint(placed), ["bucket", self.key], "left_semi").select(self.key)
            )
        found = found.distinct()
        return found if few else hint(found)

    def refresh_index(self, buckets: int = 256) -> None:
        """Write the key index of the newest version, in ``buckets`` folders.

        ``buckets`` should leave some ten million keys to each: a folder is written
        by one task. Loads go on meanwhile; their keys are read from their rows.
        """
        at = self.snapshot()
        keys = stored_key_values(self._rows(at.newer_than(at.covers)), self.key)
        if at.base is not None:
            keys = keys.unionByName(self._base(at).select(self.key))
        base = uuid.uuid4().hex
        # equal keys meet in their bucket: one shuffle
        placed = keys.withColumn("bucket", key_bucket(F.col(self.key), buckets)).repartition(buckets, "bucket")
        placed.dropDuplicates(["bucket", self.key]).sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(
            f"{self.path}/keys/base={base}"
        )
        version = at.version + 1
        while not self._commit(version, base=base, buckets=buckets, covers=at.version):
            version += 1

    # ---------------------------------------------------------------- loads ---
    def _stage(self, rows: DataFrame, seen: int) -> Load:
        load, observation = uuid.uuid4().hex, Observation("rows")
        out = to_contract(coerce_dates(rows)).observe(observation, F.count(F.lit(1)).alias("rows"))
        out.write.parquet(f"{self.path}/data/load={load}")
        return Load(load, int(observation.get.get("rows", 0)), seen)

    def begin(self, rows: DataFrame) -> Load:
        """Write the rows whose key is not stored yet; readers do not see them before ``commit``.

        ``rows`` have one row for each normalised key (``ingest.upload_dedupe``).
        They are written first, so that they are computed once, unless nothing is stored yet.
        Dates that are still text are read with the defaults of ``coerce_dates``, those of new rows only.
        """
        at = self.snapshot()
        if not at.loads:
            return self._stage(rows, at.version)
        given, few = self._given(rows)
        at = self.snapshot()
        if few:
            stored = self.stored_keys(given, at, few)
        else:
            stored = stored_key_values(self._rows(at.newer_than(at.covers)), self.key)
            if at.base is not None:
                stored = stored.unionByName(self._base(at).select(self.key))
            stored = stored.where(F.col(self.key) > F.lit("")).hint("merge")
        return self._stage(given.join(stored, self.key, "left_anti"), at.version)

    def _given(self, rows: DataFrame) -> tuple[DataFrame, bool]:
        """The rows as they are, written, and whether their keys are few."""
        staged, observation = f"{self.path}/staging/{uuid.uuid4().hex}", Observation("keys")
        untyped = lambda f: f.name not in schema.DATE_COLUMNS or isinstance(f.dataType, T.NullType)
        named = [f for f in rows.schema.fields if f.name in schema.CONTRACT_COLUMNS]
        out = rows.select(*(F.col(f.name).cast("string").alias(f.name) if untyped(f) else f.name for f in named))
        out.observe(observation, *self._size()).write.parquet(staged)
        size = observation.get
        few = 64 * size.get("n", 0) + size.get("size", 0) <= self.broadcast_bytes
        return self.spark.read.schema(out.schema).parquet(staged), few

    def commit(self, load: Load) -> int:
        """Make the rows of a load visible, those whose key no other load stored meanwhile; how many they are."""
        while load.rows:
            if self._commit(load.seen + 1, load=load.load, rows=load.rows):
                return load.rows
            at = self.snapshot()
            newer = at.newer_than(load.seen)
            if newer:  # else only an index was written meanwhile
                between = stored_key_values(self._rows(newer), self.key)
                load = self._stage(self._rows([load.load]).join(self._sized(between), self.key, "left_anti"), at.version)
            else:
                load = load._replace(seen=at.version)
        return 0

    def append(self, rows: DataFrame) -> int:
        """Store the rows whose key is not stored yet; how many they are."""
        return self.commit(self.begin(rows))
