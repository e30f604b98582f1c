"""Schema CSV: one ``name,type`` line per column, without a header."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType, DoubleType, LongType, StringType, StructField, StructType

#: Type names of the schema file.
TYPES: dict[str, DataType] = {"int64": LongType(), "float64": DoubleType(), "string": StringType()}


def type_of(name: str) -> DataType:
    if name not in TYPES:
        raise ValueError(f"unknown type: {name}")
    return TYPES[name]


def parse_schema(lines: list[str]) -> StructType:
    """Blank lines are skipped; a line without a comma is an error."""
    fields = []
    for line in lines:
        if not line:
            continue
        name, comma, kind = line.partition(",")
        if not comma:
            raise ValueError(f"no comma in schema line: {line}")
        fields.append(StructField(name, type_of(kind), False))
    return StructType(fields)


def read_schema(spark: SparkSession, path: str) -> StructType:
    """Read through Spark, so any store it knows will do. A schema file is a
    line per column: small by nature."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return parse_schema(text.split("\n"))


def schema_lines(schema: StructType) -> list[str]:
    names = {t: n for n, t in TYPES.items()}
    return [f"{f.name},{names[f.dataType]}" for f in schema.fields]


def write_schema(spark: SparkSession, schema: StructType, path: str) -> None:
    rows = [(line,) for line in schema_lines(schema)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)
