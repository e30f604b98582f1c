"""The engine's operators are batch operators over finite files.

They are built from stateless ``DataFrame`` steps and aggregates, so scans,
filters, projections and grouped aggregates also accept a streaming frame;
``minute_counts`` shows the one grouping that makes sense on unbounded input.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_counts(events: DataFrame, time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows per minute, on batch or streaming input; state older than the
    watermark is dropped."""
    stamped = events.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    out = stamped.groupBy(F.window("__t", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_seconds("w.start").alias("minute"), "n")
