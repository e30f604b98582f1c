"""The wide table of page hits.

``hits`` derives the columns that the workload reads from the ``events``
table. The column texts are valid in Spark SQL and DuckDB alike; only the
three base columns (k, sec, day) differ, so the same text defines the view
for the engine and for its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = {
    "WatchID": "cast(event_id as bigint)",
    "Title": "case when k % 7 = 0 then concat('Google ', event_type) else concat('Page ', cast(user_id % 50 as varchar(20))) end",
    "EventTime": "sec",
    "EventDate": "day",
    "CounterID": "cast(case when k % 2 = 0 then 62 else 7 end as bigint)",
    "ClientIP": "cast(event_id % 97 as bigint)",
    "RegionID": "cast(user_id % 10 as bigint)",
    "UserID": "cast(user_id as bigint)",
    "URL": "case when k % 11 = 0 then '' when k % 10 = 0 then concat('http://www.google.com/', cast(k % 3 as varchar(20))) "
    "when k % 5 = 0 then concat('http://google.com/', cast(k % 3 as varchar(20))) "
    "else concat('http://site', cast(user_id % 12 as varchar(20)), '.example/') end",
    "Referer": "case when k % 6 = 0 then '' else concat('http://ref', cast(user_id % 9 as varchar(20)), '.example/') end",
    "IsRefresh": "cast(case when k % 9 = 0 then 1 else 0 end as bigint)",
    "ResolutionWidth": "cast(1000 + (k % 50) * 16 as bigint)",
    "MobilePhone": "cast(k % 5 as bigint)",
    "MobilePhoneModel": "case when k % 3 = 0 then '' else concat('model', cast(k % 8 as varchar(20))) end",
    "TraficSourceID": "cast(k % 8 - 1 as bigint)",
    "SearchEngineID": "cast(k % 4 as bigint)",
    "SearchPhrase": "case when event_type = 'signup' then '' else concat(event_type, '-', cast(k % 7 as varchar(20))) end",
    "AdvEngineID": "cast(case when k % 3 = 0 then k % 20 else 0 end as bigint)",
    "WindowClientWidth": "cast((event_id % 5) * 100 as bigint)",
    "WindowClientHeight": "cast((event_id % 4) * 100 as bigint)",
    "IsLink": "cast(case when event_id % 3 = 0 then 1 else 0 end as bigint)",
    "IsDownload": "cast(case when event_id % 10 = 0 then 1 else 0 end as bigint)",
    "DontCountHits": "cast(case when event_id % 7 = 0 then 1 else 0 end as bigint)",
    "RefererHash": "cast(user_id % 4 as bigint)",
    "URLHash": "cast(user_id % 3 as bigint)",
}

#: ``with`` clause that defines ``hits`` in DuckDB.
ORACLE_HITS = (
    "with base as (select *, cast(json_extract_string(props, '$.k') as bigint) as k, "
    "epoch_us(ts) // 1000000 as sec, epoch_us(ts) // 86400000000 as day from events), hits as (select "
    + ", ".join(f"{text} as {name}" for name, text in COLUMNS.items())
    + " from base)"
)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = events.select(
        "event_id",
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        # wall-clock seconds of a zone-less timestamp: no session zone involved
        F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', ts)").cast("long").alias("sec"),
        F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
    )
    return base.select(*(F.expr(text).alias(name) for name, text in COLUMNS.items()))
