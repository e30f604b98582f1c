"""Plans that write a test table with a sink and read it with a source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import scan
from ..sources import convert_csv, load_csv, load_parquet, parquet_to_csv, read_schema, save_csv, save_parquet, save_tsv, write_schema
from ..sources.files import CODECS, shared_folder
from ..sources.schema import parse_schema, schema_lines

#: Columns of ``documents`` that are never null in a file: '' stands for null.
SCHEMA = ["doc_id,int64", "text,string", "lang,string", "source,string", "n_chars,int64"]
SQL = "select cast(doc_id as bigint) as doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, cast(coalesce(n_chars, 0) as bigint) as n_chars from documents"


def place(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_folder(spark)}/tidemark/files-{uuid.uuid4().hex}"


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, StructType]:
    schema = parse_schema(SCHEMA)
    rows = scan(spark, f"{d}/documents.parquet", schema.fieldNames())
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)), schema


def csv_roundtrip(spark, d):
    rows, schema = _documents(spark, d)
    at = place(spark)
    save_csv(rows, f"{at}/csv")
    return load_csv(spark, f"{at}/csv", schema)


def csv_to_columnar(spark, d):
    rows, schema = _documents(spark, d)
    at = place(spark)
    save_csv(rows, f"{at}/csv")
    convert_csv(spark, f"{at}/csv", schema, f"{at}/parquet", sort_by=["doc_id"])
    return load_parquet(spark, f"{at}/parquet")


def columnar_to_csv(spark, d):
    rows, schema = _documents(spark, d)
    at = place(spark)
    save_parquet(rows.na.fill("").na.fill(0), f"{at}/parquet")
    parquet_to_csv(spark, f"{at}/parquet", f"{at}/csv", f"{at}/schema")
    return load_csv(spark, f"{at}/csv", read_schema(spark, f"{at}/schema"))


def tsv_result(spark, d):
    at = place(spark)
    save_tsv(scan(spark, f"{d}/nation.parquet", ["n_nationkey", "n_name", "n_regionkey"]), f"{at}/tsv")
    return spark.read.text(f"{at}/tsv").select(F.col("value").alias("line"))


def schema_roundtrip(spark, d):
    at = place(spark)
    write_schema(spark, parse_schema(SCHEMA), f"{at}/schema")
    lines = [(k, *x.split(",")) for k, x in enumerate(schema_lines(read_schema(spark, f"{at}/schema")))]
    return spark.createDataFrame(lines, "place long, name string, type string")


def codecs(spark, d):
    at, out = place(spark), None
    rows = scan(spark, f"{d}/nation.parquet", ["n_nationkey", "n_name"])
    for codec in CODECS:
        save_parquet(rows, f"{at}/{codec}", compression=codec)
        read = load_parquet(spark, f"{at}/{codec}").withColumn("codec", F.lit(codec))
        out = read if out is None else out.unionByName(read)
    return out


_NAMES = ", ".join(f"({k}, '{x.split(',')[0]}', '{x.split(',')[1]}')" for k, x in enumerate(SCHEMA))
_CODECS = ", ".join(f"('{c}')" for c in CODECS)

PLANS = {
    "csv_roundtrip": (csv_roundtrip, SQL),
    "csv_to_columnar": (csv_to_columnar, SQL),
    "columnar_to_csv": (columnar_to_csv, SQL),
    "tsv_result": (tsv_result, "select concat_ws(chr(9), cast(n_nationkey as varchar), n_name, cast(n_regionkey as varchar)) as line from nation"),
    "schema_roundtrip": (schema_roundtrip, f"select cast(place as bigint) as place, name, type from (values {_NAMES}) as t(place, name, type)"),
    "parquet_codecs": (codecs, f"select n_nationkey, n_name, codec from nation, (values {_CODECS}) as t(codec)"),
}
