"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; long texts make wide rows.
BATCH_ROWS = 512


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where the session names none, a local run gets a temporary folder; a cluster run is refused,
    since executors and driver would not see the same files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_dir.get() if set_dir.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/foliospark-{name}-{uuid.uuid4().hex}"


#: Paths of the tables that ``materialize`` wrote and nobody has deleted yet.
_WRITTEN: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _WRITTEN.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path_ = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def forget(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "scratch_path_", None)
        if path:
            _delete(df.sparkSession, path)


def alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` gives, written; all other tables that were written for it are deleted then."""
    before = set(_WRITTEN)
    out = materialize(build(), name)
    for path in _WRITTEN - before - {out.scratch_path_}:
        _delete(out.sparkSession, path)
    return out


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, so that a worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with the columns that an operator needs for itself under other names, and what selects all columns under their own."""
    taken, moved = {c.lower() for c in df.columns} | set(names), {}
    for c in df.columns:
        if c.lower() in names:
            new = next(f"{c}_{k}" for k in range(len(taken) + 1) if f"{c}_{k}".lower() not in taken)
            taken.add(new.lower())
            moved[c] = new
    return df.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in df.columns]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; what holds maps, which Spark doesn't hash, is hashed as JSON."""
    return F.xxhash64(*(F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields))


class Shared:
    """A broadcast object of bounded size, sent by value: workers needn't have its class installed."""

    def __init__(self, spark: SparkSession, value: object):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self) -> dict:
        return {"_sent": self._sent, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._sent.value)
        return self._value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(df: DataFrame, key: str, rows: int, total: int | None = None, *order: str) -> DataFrame:
    """The ``rows`` rows with the least hash of ``key``, then by ``order``: a fixed sample, whatever the partitions.

    A sort for a few rows sends that many from each partition to one task, so most rows are filtered out by their
    hash first; where the filter leaves too few, which is all but impossible, it is left out.
    """
    total = df.count() if total is None else total
    few = df
    if total > 2 * rows:
        few = df.where(F.xxhash64(key) < F.lit(int(-(2**63) + 1.5 * rows / total * 2**64)))
        few = few if few.count() >= rows else df
    return few.orderBy(F.xxhash64(key), key, *order).limit(rows)


#: Bytes that count as a row where rows are dealt to ranges; longer rows count as several.
ROW_BYTES = 6144


def units(payload: Column) -> Column:
    """What a row weighs in ``weighted_ranges``: 1, or more if it is long."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(payload), F.lit(0)) / ROW_BYTES)).cast("bigint")


def weighted_ranges(df: DataFrame, column: str, weight: Column, target: int) -> list[tuple[int, int]]:
    """Upper bounds (inclusive) of consecutive ranges of an integer column, of about ``target`` weight each, and into how
    many parts a range is to be dealt: 1, or more if one value weighs over two targets.

    Bounds depend on the values alone, not on their partitions. Equal-width bins are weighed, about four a range; all
    bins that hold over two targets are weighed anew over their own width, in one pass a level, until one value fills
    them. What reaches the driver is a sum for each bin in use, so the caller's target bounds it.
    """
    keys = df.where(F.col(column).isNotNull()).select(F.col(column).alias("k"), weight.alias("w"))
    lo, hi, whole = keys.select(F.min("k"), F.max("k"), F.sum("w")).first()
    if not whole:
        return []
    known, todo = {}, [(lo, hi, whole)]
    while todo:
        starts = np.array([t[0] for t in todo], np.int64)
        ends = np.array([t[1] for t in todo], np.int64)
        parts = [max(2, -(-4 * n // target)) for _, _, n in todo]
        widths = np.array([max(1, -(-(b - a + 1) // p)) for (a, b, _), p in zip(todo, parts)], np.int64)
        sent = Shared(df.sparkSession, (starts, ends, widths))

        @F.pandas_udf("long")
        def bin_of(k: pd.Series) -> pd.Series:
            starts, ends, widths = sent.value
            k = k.to_numpy(np.int64)
            at = np.maximum(np.searchsorted(starts, k, "right") - 1, 0)
            first = starts[at] + (k - starts[at]) // widths[at] * widths[at]
            return pd.Series(np.where((k >= starts[at]) & (k <= ends[at]), first, -(2**63)))

        found = keys.select(bin_of("k").alias("first"), "w").where(F.col("first") != -(2**63)).groupBy("first").agg(F.sum("w")).collect()
        todo = []
        for first, held in sorted(map(tuple, found)):
            at = int(np.searchsorted(starts, first, "right")) - 1
            last = min(int(ends[at]), first + int(widths[at]) - 1)
            if held > 2 * target and last > first:
                todo.append((first, last, held))
            else:
                known[last] = held
    bounds, held, before = [], 0, None
    for last in sorted(known):
        if known[last] > 2 * target:  # one value
            if held:
                bounds.append((before, 1))
            bounds.append((last, -(-known[last] // target)))
            held = 0
            continue
        held, before = held + known[last], last
        if held >= target:
            bounds.append((last, 1))
            held = 0
    if held:
        bounds.append((hi, 1))
    return bounds


def id_ranges(df: DataFrame, column: str, target_rows: int) -> list[int]:
    """Upper bounds of ``weighted_ranges`` of about ``target_rows`` rows each."""
    return [upper for upper, _ in weighted_ranges(df, column, F.lit(1), target_rows)]


class Places:
    """Where the values of a column belong: the first part of their range, and its number of parts."""

    def __init__(self, spark: SparkSession, ranges: list[tuple[int, int]]):
        parts = np.array([n for _, n in ranges] or [1], np.int64)
        self.total = int(parts.sum())
        self._sent = Shared(spark, (np.array([u for u, _ in ranges], np.int64), np.cumsum(parts) - parts, parts))  # three numbers a range

    def of(self, keys: Column) -> Column:
        """A struct of ``base`` and ``parts``."""
        sent = self._sent

        @F.pandas_udf("base int, parts int")
        def place(keys: pd.Series) -> pd.DataFrame:
            upper, base, parts = sent.value
            at = np.minimum(np.searchsorted(upper, keys.to_numpy(np.int64)), len(base) - 1)
            return pd.DataFrame({"base": base[at].astype("int32"), "parts": parts[at].astype("int32")})

        return place(keys)
