"""Scan, filter, project, join, aggregate and sort.

Each is a thin declarative step, so Catalyst sees the whole chain: filters
and column lists reach the Parquet scan, grouped aggregates run partially
before their exchange, and sort plus limit becomes one top-k operator.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..functions.scalars import compare
from ..sources.files import shared_folder


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The listed columns of a Parquet table, in that order."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def _typed(df: DataFrame, name: str, kind: type, what: str) -> Column:
    found = df.schema[name].dataType
    if not isinstance(found, kind):
        raise TypeError(f"{name} is not {what}: {found.simpleString()}")
    return F.col(name)


def filter_int(df: DataFrame, column: str, kind: str, value: int) -> DataFrame:
    """Rows whose integer column compares true with a constant."""
    return df.filter(compare(kind, _typed(df, column, IntegralType, "an integer column"), F.lit(value)))


def filter_string(df: DataFrame, column: str, kind: str, value: str = "") -> DataFrame:
    """Rows by text: eq, ne, contains (an empty needle matches) or notempty."""
    c = _typed(df, column, StringType, "a string column")
    tests = {"eq": lambda: c == value, "ne": lambda: c != value, "contains": lambda: c.contains(value), "notempty": lambda: c != ""}
    if kind not in tests:
        raise ValueError(f"unknown string predicate: {kind}")
    return df.filter(tests[kind]())


def filter_expr(df: DataFrame, condition: Column) -> DataFrame:
    """WHERE, and HAVING when applied to an aggregate."""
    return df.filter(condition)


def project(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Exactly the named expressions; nothing passes through by itself."""
    return df.select(*(c.alias(name) for name, c in columns.items()))


def hash_join(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, suffix: str = "_probe") -> DataFrame:
    """Inner equi-join. All build columns, then all probe columns, both keys
    kept; a probe column whose name the build side has gets ``suffix``.

    No side is forced into a broadcast: Catalyst broadcasts one only if its
    size statistic is under ``spark.sql.autoBroadcastJoinThreshold``, and
    adaptive execution splits skewed partitions of a sort-merge join."""
    taken = set(build.columns)
    renamed = probe.select(*(F.col(c).alias(c + suffix if c in taken else c) for c in probe.columns))
    key = probe_key + suffix if probe_key in taken else probe_key
    return build.join(renamed, build[build_key] == renamed[key], "inner")


def aggregate(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Group columns, then aggregates. Without keys always one row."""
    named = [c.alias(name) for name, c in aggregates.items()]
    if not keys:
        return df.agg(*named)
    return df.groupBy(*keys).agg(*named) if named else df.select(*keys).distinct()


def sort(df: DataFrame, keys: Sequence[tuple[str, bool]], limit: int = 0, offset: int = 0) -> DataFrame:
    """Order by (column, ascending) keys; ``limit`` 0 means no limit.

    An offset without a limit sorts at once and keeps the order as a
    checkpoint, so that its first rows are skipped in parallel.
    Ties are arbitrary: append a unique key where the result must be fixed."""
    out = df.orderBy(*(F.col(c).asc() if up else F.col(c).desc() for c, up in keys))
    if limit:
        return out.offset(offset).limit(limit) if offset else out.limit(limit)
    return _skip(out, offset) if offset else out


def _skip(ordered: DataFrame, offset: int) -> DataFrame:
    """``ordered`` without its first ``offset`` rows. Plain OFFSET would bring
    all rows to one task; here one count per partition reaches the driver and
    tells at which row id the rest begins. The checkpoint fixes which rows a
    partition holds, whatever executor is lost later."""
    context = ordered.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(ordered.sparkSession))
    kept = ordered.checkpoint()
    sizes = sorted(tuple(r) for r in kept.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    part, left = 0, offset
    for part, n in sizes:
        if left < n:
            break
        left -= n
    else:
        return kept.limit(0)
    numbered = kept.select("*", F.monotonically_increasing_id().alias("__row"))  # partition << 33, plus the place in it
    return numbered.filter(F.col("__row") >= (part << 33) + left).drop("__row")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
