"""The 43 click-stream queries as ``DataFrame -> DataFrame`` plans.

Every plan is one declarative chain: filters reach the scan, only the columns
used are read, grouped aggregates run partially before their exchange, and
order plus limit is one top-k operator (offset included). Each top-k ends its
order with the group keys, so that ties at the limit have a fixed result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import avg, case_when, count_distinct, count_star, date_trunc_minute, extract_minute, in_ints, len_str, like, lit_i, max_, min_, sum_


@dataclass(frozen=True)
class Params:
    """Fixed values of the workload's definition."""

    user_id: int = 435090932899640449
    counter_id: int = 62
    month_from: int = 15887  # 2013-07-01, days since 1970
    month_to: int = 15917  # 2013-07-31
    days_from: int = 15900  # 2013-07-14
    days_to: int = 15901  # 2013-07-15
    referer_hash: int = 3594120000172545465
    url_hash: int = 2868770270353813622
    min_count: int = 100_000
    offset_pages: int = 1000
    offset_small: int = 100
    offset_large: int = 10_000


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _top(df: DataFrame, keys: list[str], aggregates: dict[str, Column], by: str = "c", limit: int = 10, offset: int = 0) -> DataFrame:
    grouped = df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    ordered = grouped.orderBy(F.col(by).desc(), *keys)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def _first(df: DataFrame, *order: str, limit: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def _phrased(h: DataFrame) -> DataFrame:
    return h.filter(F.col("SearchPhrase") != "")


def _window(h: DataFrame, p: Params, *more: Column, days: bool = False) -> DataFrame:
    low, high = (p.days_from, p.days_to) if days else (p.month_from, p.month_to)
    return h.filter(_all(F.col("CounterID") == p.counter_id, F.col("EventDate") >= low, F.col("EventDate") <= high, F.col("IsRefresh") == 0, *more))


def q00(h, p):
    return h.agg(count_star().alias("c"))


def q01(h, p):
    return h.filter(F.col("AdvEngineID") != 0).agg(count_star().alias("c"))


def q02(h, p):
    return h.agg(sum_("AdvEngineID").alias("s"), count_star().alias("c"), avg("ResolutionWidth").alias("a"))


def q03(h, p):
    return h.agg(avg("UserID").alias("a"))


def q04(h, p):
    return h.agg(count_distinct("UserID").alias("u"))


def q05(h, p):
    return h.agg(count_distinct("SearchPhrase").alias("u"))


def q06(h, p):
    return h.agg(min_("EventDate").alias("lo"), max_("EventDate").alias("hi"))


def q07(h, p):
    kept = h.filter(F.col("AdvEngineID") != 0)
    return kept.groupBy("AdvEngineID").agg(count_star().alias("c")).orderBy(F.col("c").desc(), "AdvEngineID")


def q08(h, p):
    return _top(h, ["RegionID"], {"u": count_distinct("UserID")}, "u")


def q09(h, p):
    return _top(h, ["RegionID"], {"s": sum_("AdvEngineID"), "c": count_star(), "a": avg("ResolutionWidth"), "u": count_distinct("UserID")})


def q10(h, p):
    return _top(h.filter(F.col("MobilePhoneModel") != ""), ["MobilePhoneModel"], {"u": count_distinct("UserID")}, "u")


def q11(h, p):
    return _top(h.filter(F.col("MobilePhoneModel") != ""), ["MobilePhone", "MobilePhoneModel"], {"u": count_distinct("UserID")}, "u")


def q12(h, p):
    return _top(_phrased(h), ["SearchPhrase"], {"c": count_star()})


def q13(h, p):
    return _top(_phrased(h), ["SearchPhrase"], {"u": count_distinct("UserID")}, "u")


def q14(h, p):
    return _top(_phrased(h), ["SearchEngineID", "SearchPhrase"], {"c": count_star()})


def q15(h, p):
    return _top(h, ["UserID"], {"c": count_star()})


def q16(h, p):
    return _top(h, ["UserID", "SearchPhrase"], {"c": count_star()})


def q17(h, p):
    return q16(h, p)


def q18(h, p):
    minutes = h.select("UserID", extract_minute(F.col("EventTime")).alias("m"), "SearchPhrase")
    return _top(minutes, ["UserID", "m", "SearchPhrase"], {"c": count_star()})


def q19(h, p):
    return h.filter(F.col("UserID") == p.user_id).select("UserID")


def q20(h, p):
    return h.filter(like(F.col("URL"), "%google%")).agg(count_star().alias("c"))


def q21(h, p):
    kept = _phrased(h).filter(like(F.col("URL"), "%google%"))
    return _top(kept, ["SearchPhrase"], {"url": min_("URL", ""), "c": count_star()})


def q22(h, p):
    kept = _phrased(h).filter(like(F.col("Title"), "%Google%") & ~like(F.col("URL"), "%.google.%"))
    return _top(kept, ["SearchPhrase"], {"url": min_("URL", ""), "title": min_("Title", ""), "c": count_star(), "u": count_distinct("UserID")})


def q23(h, p):
    return _first(h.filter(like(F.col("URL"), "%google%")), "EventTime", "WatchID")


def q24(h, p):
    return _first(_phrased(h).select("SearchPhrase", "EventTime", "WatchID"), "EventTime", "WatchID").select("SearchPhrase")


def q25(h, p):
    return _first(_phrased(h).select("SearchPhrase"), "SearchPhrase")


def q26(h, p):
    return _first(_phrased(h).select("SearchPhrase", "EventTime"), "EventTime", "SearchPhrase").select("SearchPhrase")


def _long_groups(h: DataFrame, text: str, keys: list[str], extra: dict[str, Column], p: Params) -> DataFrame:
    kept = h.filter(F.col(text) != "")
    grouped = kept.groupBy(*keys).agg(avg(len_str(F.col(text))).alias("l"), count_star().alias("c"), *(c.alias(n) for n, c in extra.items()))
    return grouped.filter(F.col("c") > p.min_count).orderBy(F.col("l").desc(), *keys).limit(25)


def q27(h, p):
    return _long_groups(h, "URL", ["CounterID"], {}, p)


def q28(h, p):
    return _long_groups(h, "Referer", ["Referer"], {"m": min_("Referer", "")}, p)


def q29(h, p):
    # the sum of x + i over n rows is the sum of x, and i times n
    base = h.agg(sum_("ResolutionWidth").alias("s"), count_star().alias("n"))
    return base.select(*((F.col("s") + F.col("n") * lit_i(i)).alias(f"s{i}") for i in range(90)))


def _client_totals() -> dict[str, Column]:
    return {"c": count_star(), "r": sum_("IsRefresh"), "a": avg("ResolutionWidth")}


def q30(h, p):
    return _top(_phrased(h), ["SearchEngineID", "ClientIP"], _client_totals())


def q31(h, p):
    return _top(_phrased(h), ["WatchID", "ClientIP"], _client_totals())


def q32(h, p):
    return _top(h, ["WatchID", "ClientIP"], _client_totals())


def q33(h, p):
    return _top(h, ["URL"], {"c": count_star()})


def q34(h, p):
    return _top(h.select(lit_i(1).alias("one"), "URL"), ["one", "URL"], {"c": count_star()})


def q35(h, p):
    shifted = h.select("ClientIP", *((F.col("ClientIP") - lit_i(i)).alias(f"ip{i}") for i in (1, 2, 3)))
    return _top(shifted, ["ClientIP", "ip1", "ip2", "ip3"], {"c": count_star()})


def q36(h, p):
    return _top(_window(h, p, F.col("DontCountHits") == 0, F.col("URL") != ""), ["URL"], {"c": count_star()})


def q37(h, p):
    return _top(_window(h, p, F.col("DontCountHits") == 0, F.col("Title") != ""), ["Title"], {"c": count_star()})


def q38(h, p):
    return _top(_window(h, p, F.col("IsLink") != 0, F.col("IsDownload") == 0), ["URL"], {"c": count_star()}, offset=p.offset_pages)


def q39(h, p):
    direct = (F.col("SearchEngineID") == 0) & (F.col("AdvEngineID") == 0)
    flow = _window(h, p).select("TraficSourceID", "SearchEngineID", "AdvEngineID", case_when(direct, F.col("Referer"), F.lit("")).alias("src"), F.col("URL").alias("dst"))
    return _top(flow, ["TraficSourceID", "SearchEngineID", "AdvEngineID", "src", "dst"], {"c": count_star()}, offset=p.offset_pages)


def q40(h, p):
    kept = _window(h, p, in_ints(F.col("TraficSourceID"), (-1, 6)), F.col("RefererHash") == p.referer_hash)
    return _top(kept, ["URLHash", "EventDate"], {"c": count_star()}, offset=p.offset_small)


def q41(h, p):
    kept = _window(h, p, F.col("DontCountHits") == 0, F.col("URLHash") == p.url_hash)
    return _top(kept, ["WindowClientWidth", "WindowClientHeight"], {"c": count_star()}, offset=p.offset_large)


def q42(h, p):
    minutes = _window(h, p, F.col("DontCountHits") == 0, days=True).select(date_trunc_minute(F.col("EventTime")).alias("m"))
    return minutes.groupBy("m").agg(count_star().alias("c")).orderBy("m").offset(p.offset_pages).limit(10)


QUERIES = [globals()[f"q{i:02d}"] for i in range(43)]


def build(number: int, h: DataFrame, params: Params | None = None) -> DataFrame:
    """Plan of query ``number`` (0 to 42) over a hits table."""
    if not 0 <= number < len(QUERIES):
        raise ValueError(f"no such query: {number}")
    return QUERIES[number](h, params or Params())
