"""Files in and out: schema CSV, CSV, Parquet, TSV results."""

from .files import convert_csv, load_csv, load_parquet, parquet_to_csv, save_csv, save_parquet, save_tsv
from .schema import TYPES, read_schema, type_of, write_schema

__all__ = ["TYPES", "convert_csv", "load_csv", "load_parquet", "parquet_to_csv", "read_schema", "save_csv", "save_parquet", "save_tsv", "type_of", "write_schema"]
