"""CSV, Parquet and TSV.

The data model has no nulls: an empty CSV field is 0, 0.0 or ''. A row with
the wrong number of fields or a field that is no number is an error.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .schema import write_schema

CSV = {"header": False, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Compression of Parquet files, by name.
CODECS = ("none", "snappy", "gzip", "lz4_raw", "zstd")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def load_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """A headerless CSV with quoted fields that may hold commas, doubled
    quotes and line feeds. Blank lines are skipped.

    Line feeds in fields make a file one task, as no place in its middle tells
    whether it is inside quotes; without them (``multi_line=False``) a file of
    any size is split."""
    loose = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
    raw = spark.read.options(**CSV).option("multiLine", multi_line).option("mode", "FAILFAST").option("enforceSchema", True).schema(loose).csv(path)
    zero = {f.name: F.lit("") if isinstance(f.dataType, StringType) else F.lit(0.0 if isinstance(f.dataType, DoubleType) else 0).cast(f.dataType) for f in schema.fields}
    return raw.select(*(F.coalesce(F.col(f"`{n}`"), z).alias(n) for n, z in zero.items()))


def save_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV).csv(path)


def save_parquet(df: DataFrame, path: str, row_group_bytes: int = 128 << 20, sort_by: list[str] | None = None, compression: str = "zstd") -> None:
    """Parquet with statistics per row group and page; sorting inside each
    file on the usual filter columns lets a scan skip row groups. Version-2
    pages: what a dictionary does not shorten is delta encoded."""
    if compression not in CODECS:
        raise ValueError(f"unknown compression: {compression}")
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    pages = "v1" if compression == "none" else "v2"  # Spark misreads uncompressed version-2 pages of text
    out.write.option("parquet.block.size", row_group_bytes).option("parquet.writer.version", pages).option("compression", compression).parquet(path)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def convert_csv(spark: SparkSession, csv_path: str, schema: StructType, out_path: str, multi_line: bool = True, sort_by: list[str] | None = None, compression: str = "zstd") -> int:
    """CSV to Parquet; the number of rows written."""
    save_parquet(load_csv(spark, csv_path, schema, multi_line), out_path, sort_by=sort_by, compression=compression)
    return load_parquet(spark, out_path).count()


def parquet_to_csv(spark: SparkSession, path: str, csv_path: str, schema_path: str | None = None) -> StructType:
    """The way back; returns the schema and writes it beside if asked to."""
    df = load_parquet(spark, path)
    save_csv(df, csv_path)
    if schema_path is not None:
        write_schema(spark, df.schema, schema_path)
    return df.schema


def as_text(df: DataFrame) -> DataFrame:
    """Every column as result text: doubles with 6 decimals."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
    return df.select(*(F.format_string("%.6f", F.col(c)).alias(c) if c in doubles else F.col(c).cast("string").alias(c) for c in df.columns))


def save_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated result text: no header, no quoting, no escaping."""
    as_text(df).select(F.concat_ws("\t", *(F.col(f"`{c}`") for c in df.columns)).alias("value")).write.text(path)
