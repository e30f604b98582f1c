"""Helpers shared by the training-data operators.

Three rules hold everywhere in this subpackage:

* intermediate results that are read more than once are *written tables* in
  the shared folder named by ``spark.checkpoint.dir`` (``materialize``), so a
  lost executor costs a re-read and never a lost block;
* a side is broadcast only when its size has a proof (``lookup``: at most
  ``1 / share`` heavy keys can hold a ``share`` of the rows each);
* operators select the columns they need under private names first, so extra
  or clashing columns of the caller never reach a join.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A key with this share of the rows or more is "heavy"; there are at most
#: ``1 / HEAVY_SHARE`` of them whatever the input, so they may be broadcast.
HEAVY_SHARE = 0.001

#: Whether Spark deletes shuffle files at the end of the query that wrote them.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder the cluster shares. Only in local mode, where the driver is
    the one executor, does a temporary folder stand in for an unset one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.append(path)
    return path


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    try:
        sweep(spark) if spark is not None else None
    except Exception:  # the JVM may be gone already at interpreter exit
        return


def sweep(spark: SparkSession) -> None:
    """Delete every table written so far; for long sessions, once the results
    that read them are stored."""
    while _written:
        remove(spark, _written.pop())


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that later written tables replace."""
    for df in tables:
        path = getattr(df, "tm_path", None)
        if path in _written:
            _written.remove(path)
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. Its
    shuffle files go as soon as the table stands, not when the driver's memory
    happens to be collected."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before) if before is not None else spark.conf.unset(FILE_CLEANUP)
    out = spark.read.schema(schema).parquet(path)
    out.tm_path = path
    return out


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_or_empty(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def remainder(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the split of the contracts.
    A null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % modulus


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, spread: Column) -> DataFrame:
    """Left outer join of ``left`` with ``right`` (unique on the non-null
    long ``key``) that no hot key can unbalance.

    ``weight`` is a column of ``right``: how many rows of ``left`` carry the
    key; ``total`` the number of rows of ``left``. Keys with at least
    ``HEAVY_SHARE`` of the rows (at most ``1 / HEAVY_SHARE`` of them) are
    broadcast; the rest meet in a shuffle join, where the rows already
    answered are spread by ``spread`` instead of their hot key.
    """
    values = [c for c in right.columns if c != key]
    floor = max(2.0, total * HEAVY_SHARE)
    heavy = right.filter(F.col(weight) >= floor).select(F.col(key).alias("__hk"), F.struct(*values).alias("__hv"))
    light = right.filter(F.col(weight) < floor).select(F.col(key).alias("__lk"), F.struct(*values).alias("__lv"))
    out = left.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
    out = out.withColumn("__open", F.col("__hk").isNull())
    out = out.withColumn("__jk", F.when(F.col("__open"), F.col(key)).otherwise(spread))
    light = light.withColumn("__lopen", F.lit(True))
    out = out.join(light, (F.col("__jk") == F.col("__lk")) & (F.col("__open") == F.col("__lopen")), "left")
    picked = [F.coalesce(F.col("__hv")[v], F.col("__lv")[v]).alias(v) for v in values]
    return out.select(*left.columns, *picked)


#: Words of 64 bits in a membership bitmap: at least, at most (8 MB of bits).
BITMAP_LEAST, BITMAP_MOST = 1 << 14, 1 << 20


def bitmap(keys: DataFrame, key: str, name: str = "bits") -> tuple[DataFrame, int]:
    """A written membership bitmap over a long hash column and its number of
    words: 16 bits a key and ``BITMAP_MOST`` words at most, so that its
    broadcast is bounded. False positives are possible (and all that more keys
    cost), misses are not."""
    n = keys.count()
    words = min(BITMAP_MOST, max(BITMAP_LEAST, 1 << max(0, n // 4 - 1).bit_length()))
    slot = F.pmod(F.col(key), F.lit(words * 64))
    bits = keys.groupBy(F.floor(slot / 64).cast("int").alias("__bw")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("__bits"))
    return materialize(bits, name), words


def in_bitmap(df: DataFrame, bits: tuple[DataFrame, int], key: str, flag: str) -> DataFrame:
    """``df`` with boolean ``flag``: whether the bitmap may hold ``key``."""
    held, words = bits
    word = F.floor(F.pmod(F.col(key), F.lit(words * 64)) / 64).cast("int")
    out = df.join(F.broadcast(held), word == F.col("__bw"), "left")
    hit = F.expr(f"coalesce(shiftright(__bits, cast(pmod({key}, 64) as int)) & 1L, 0L) = 1L")
    return out.withColumn(flag, hit).drop("__bw", "__bits")


class Memo(dict):
    """Bounded cache of ``fn``: a hit costs one C-level dict access, and the
    table is emptied when it holds ``cap`` entries (``trim``), so a worker's
    memory does not grow with the vocabulary."""

    def __init__(self, fn, cap: int = 500_000):
        super().__init__()
        self.fn, self.cap = fn, cap

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.cap:
            self.clear()


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(frames: Iterable, rows: int = 512):
    """Slices of at most ``rows`` rows of each Arrow batch, so that Python
    holds few documents at a time."""
    for b in frames:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end by bytes as well as by rows: very long documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


_state: dict = {}


def worker_state(key: str, build):
    """``build()`` once per Python worker and ``key``; workers are reused
    between tasks, so caches of word features outlive a task. One state is
    held at a time."""
    if key not in _state:
        _state.clear()
        _state[key] = build()
    return _state[key]


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``.

    Only rows that a membership bitmap may hold are shuffled for the exact
    anti join; all others pass through in the scan, texts and all."""
    name = ids.columns[0]
    gone = ids.select(F.col(name).alias("__drop")).distinct()
    gone = materialize(gone.withColumn("__dk", F.xxhash64("__drop")), "drop-ids")
    bits = bitmap(gone, "__dk", "drop-bits")
    marked = in_bitmap(docs.withColumn("__tm_key", F.xxhash64(docs[id_col])), bits, "__tm_key", "__tm_maybe")
    sure = marked.filter("not __tm_maybe")
    asked = marked.filter("__tm_maybe")
    asked = asked.join(gone, asked[id_col].eqNullSafe(gone["__drop"]), "left_anti")
    return sure.unionByName(asked).select(*docs.columns)


def bounded_sample(rows: DataFrame, id_col: str, n_rows: int, limit: int, seed: str) -> DataFrame:
    """At most ``limit`` of ``n_rows`` rows in the order of a hash of the id.

    The hash first thins the rows to about twice the limit, so that what the
    partitions send to be merged does not grow with their number."""
    order = F.xxhash64(id_col, F.lit(seed))
    share = min(1.0, 2.0 * limit / max(1, n_rows))
    thin = F.pmod(F.xxhash64(order), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    return rows.filter(thin).orderBy(order, id_col).limit(limit)
