"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import workload
from .hits import hits
from .oracle import workload_sql
from .primitives import PLANS as PRIMITIVES
from .roundtrips import PLANS as ROUNDTRIPS

PLANS = PRIMITIVES | ROUNDTRIPS

#: The workload's parameters scaled to the test tables (January 2024, small
#: counts); ``workload.Params()`` holds the definition's own.
SCALED = workload.Params(
    user_id=42,
    month_from=19725,
    month_to=19745,
    days_from=19730,
    days_to=19740,
    referer_hash=2,
    url_hash=1,
    min_count=20,
    offset_pages=3,
    offset_small=5,
    offset_large=4,
)


def _workload(number: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: workload.build(number, hits(spark, sf_dir), SCALED)


QUERIES = {name: f for name, (f, _) in PLANS.items()} | {f"cb_q{i:02d}": _workload(i) for i in range(43)}
ORACLE = {name: sql for name, (_, sql) in PLANS.items()} | {f"cb_q{i:02d}": sql for i, sql in enumerate(workload_sql(SCALED))}
