"""One small plan per operator and function, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import aggregate, filter_expr, filter_int, filter_string, hash_join, project, scan, sort
from .hits import ORACLE_HITS, hits

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, tuple[Plan, str]] = {}

LINE = ("l_orderkey", "l_linenumber", "l_partkey")
LINE_SQL = ", ".join(LINE)


def plan(name: str, sql: str):
    def add(f: Plan) -> Plan:
        PLANS[name] = (f, sql)
        return f

    return add


def _t(spark, d, name, *columns) -> DataFrame:
    return scan(spark, f"{d}/{name}.parquet", list(columns) or None)


@plan("scan_project", "select l_orderkey, l_partkey, l_shipdate, l_orderkey + 1 as next_key from lineitem")
def _(spark, d):
    rows = _t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_shipdate")
    return project(rows, {c: fn.col(c) for c in rows.columns} | {"next_key": fn.add(fn.col("l_orderkey"), fn.lit_i(1))})


for _kind, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    PLANS[f"filter_int_{_kind}"] = (
        lambda spark, d, k=_kind: filter_int(_t(spark, d, "lineitem", *LINE), "l_partkey", k, 77),
        f"select {LINE_SQL} from lineitem where l_partkey {_sign} 77",
    )

for _kind, _value, _where in (
    ("eq", "view-3", "SearchPhrase = 'view-3'"),
    ("ne", "view-3", "SearchPhrase <> 'view-3'"),
    ("contains", "ick-", "contains(SearchPhrase, 'ick-')"),
    ("notempty", "", "SearchPhrase <> ''"),
):
    PLANS[f"filter_str_{_kind}"] = (
        lambda spark, d, k=_kind, v=_value: filter_string(hits(spark, d).select("WatchID", "SearchPhrase"), "SearchPhrase", k, v),
        f"{ORACLE_HITS} select WatchID, SearchPhrase from hits where {_where}",
    )


def _sides():
    return fn.col("l_partkey") > 100, fn.col("l_returnflag") == "R"


for _kind, _test, _where in (
    ("and", fn.and_, "l_partkey > 100 and l_returnflag = 'R'"),
    ("or", fn.or_, "l_partkey > 100 or l_returnflag = 'R'"),
    ("not", lambda a, b: fn.not_(fn.and_(a, b)), "not (l_partkey > 100 and l_returnflag = 'R')"),
):
    PLANS[f"filter_expr_{_kind}"] = (
        lambda spark, d, t=_test: filter_expr(_t(spark, d, "lineitem", *LINE, "l_returnflag"), t(*_sides())),
        f"select {LINE_SQL}, l_returnflag from lineitem where {_where}",
    )


@plan("hash_join_inner", "select n_nationkey, n_name, c_custkey, c_nationkey from nation join customer on n_nationkey = c_nationkey")
def _(spark, d):
    return hash_join(_t(spark, d, "nation", "n_nationkey", "n_name"), _t(spark, d, "customer", "c_custkey", "c_nationkey"), "n_nationkey", "c_nationkey")


@plan(
    "hash_join_dups",
    "select o_orderkey, o_custkey, l_orderkey, l_linenumber, l_quantity from orders join lineitem on o_orderkey = l_orderkey",
)
def _(spark, d):
    return hash_join(_t(spark, d, "orders", "o_orderkey", "o_custkey"), _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), "o_orderkey", "l_orderkey")


def _six() -> dict:
    return {
        "n": fn.count_star(),
        "n_url": fn.count("URL"),
        "s": fn.sum_("AdvEngineID"),
        "a": fn.avg("ResolutionWidth"),
        "lo": fn.min_("EventTime"),
        "hi": fn.max_("EventTime"),
    }


SIX = (
    "count(*) as n, count(URL) as n_url, cast(coalesce(sum(AdvEngineID), 0) as bigint) as s, coalesce(avg(ResolutionWidth), 0) as a, "
    "coalesce(min(EventTime), 0) as lo, coalesce(max(EventTime), 0) as hi"
)


@plan("global_agg", f"{ORACLE_HITS} select {SIX} from hits")
def _(spark, d):
    return aggregate(hits(spark, d), [], _six())


@plan("global_agg_empty", f"{ORACLE_HITS} select {SIX} from hits where UserID < 0")
def _(spark, d):
    return aggregate(filter_int(hits(spark, d), "UserID", "lt", 0), [], _six())


@plan("group_agg", f"{ORACLE_HITS} select RegionID, {SIX} from hits group by RegionID")
def _(spark, d):
    return aggregate(hits(spark, d), ["RegionID"], _six())


@plan("group_agg_string_min", f"{ORACLE_HITS} select RegionID, min(URL) as lo, max(URL) as hi from hits group by RegionID")
def _(spark, d):
    return aggregate(hits(spark, d), ["RegionID"], {"lo": fn.min_("URL", ""), "hi": fn.max_("URL", "")})


@plan("group_only", f"{ORACLE_HITS} select distinct RegionID, SearchEngineID from hits")
def _(spark, d):
    return aggregate(hits(spark, d), ["RegionID", "SearchEngineID"], {})


@plan("distinct_global", f"{ORACLE_HITS} select count(distinct UserID) as u, count(distinct SearchPhrase) as p from hits")
def _(spark, d):
    return aggregate(hits(spark, d), [], {"u": fn.count_distinct("UserID"), "p": fn.count_distinct("SearchPhrase")})


@plan("distinct_by_group", f"{ORACLE_HITS} select RegionID, count(distinct UserID) as u from hits group by RegionID")
def _(spark, d):
    return aggregate(hits(spark, d), ["RegionID"], {"u": fn.count_distinct("UserID")})


@plan(
    "group_agg_double",
    "select l_returnflag, round(sum(l_extendedprice), 2) as s, min(l_extendedprice) as lo, max(l_extendedprice) as hi, "
    "round(avg(l_extendedprice), 4) as a from lineitem group by l_returnflag",
)
def _(spark, d):
    price = "l_extendedprice"
    return aggregate(
        _t(spark, d, "lineitem", "l_returnflag", price),
        ["l_returnflag"],
        {"s": F.round(fn.sum_(price, 0.0), 2), "lo": fn.min_(price, 0.0), "hi": fn.max_(price, 0.0), "a": F.round(fn.avg(price), 4)},
    )


@plan("having", f"{ORACLE_HITS} select SearchPhrase, count(*) as c from hits group by SearchPhrase having count(*) > 20")
def _(spark, d):
    return filter_expr(aggregate(hits(spark, d), ["SearchPhrase"], {"c": fn.count_star()}), F.col("c") > 20)


ORDERS = ("o_orderkey", "o_orderpriority", "o_totalprice")


@plan("sort_multi", f"select {', '.join(ORDERS)} from orders order by o_orderpriority, o_totalprice desc, o_orderkey")
def _(spark, d):
    return sort(_t(spark, d, "orders", *ORDERS), [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", True)])


@plan("top_k", f"select {', '.join(ORDERS)} from orders order by o_totalprice desc, o_orderkey limit 25")
def _(spark, d):
    return sort(_t(spark, d, "orders", *ORDERS), [("o_totalprice", False), ("o_orderkey", True)], 25)


@plan("top_k_offset", f"select {', '.join(ORDERS)} from orders order by o_totalprice desc, o_orderkey limit 25 offset 40")
def _(spark, d):
    return sort(_t(spark, d, "orders", *ORDERS), [("o_totalprice", False), ("o_orderkey", True)], 25, 40)


@plan("sort_offset_only", f"select {', '.join(ORDERS)} from orders order by o_orderkey offset 100")
def _(spark, d):
    return sort(_t(spark, d, "orders", *ORDERS), [("o_orderkey", True)], 0, 100)


SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


@plan(
    "cmp_int_string",
    "select l_orderkey, l_linenumber, "
    + ", ".join(f"cast(l_partkey {s} l_suppkey as bigint) as i_{k}, cast(l_returnflag {s} 'N' as bigint) as s_{k}" for k, s in SIGNS.items())
    + " from lineitem",
)
def _(spark, d):
    rows = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    out = {"l_orderkey": fn.col("l_orderkey"), "l_linenumber": fn.col("l_linenumber")}
    for k in SIGNS:
        out[f"i_{k}"] = fn.compare(k, fn.col("l_partkey"), fn.col("l_suppkey")).cast("long")
        out[f"s_{k}"] = fn.compare(k, fn.col("l_returnflag"), fn.lit_s("N")).cast("long")
    return project(rows, out)


for _kind, _pattern in (("contains", "%/en/%"), ("prefix", "https://%"), ("suffix", "%ref=x"), ("general", "%/f_/%")):
    PLANS[f"like_{_kind}"] = (
        lambda spark, d, p=_pattern: filter_expr(_t(spark, d, "pages", "page_id", "url"), fn.like(fn.col("url"), p)),
        f"select page_id, url from pages where url like '{_pattern}'",
    )


@plan("like_equal", "select n_nationkey, n_name from nation where n_name like (select min(n_name) from nation)")
def _(spark, d):
    first = _t(spark, d, "nation", "n_name").agg(F.min("n_name")).first()[0]
    return filter_expr(_t(spark, d, "nation", "n_nationkey", "n_name"), fn.like(fn.col("n_name"), first))


@plan("byte_length", "select doc_id, strlen(text) as n_bytes from documents")
def _(spark, d):
    return project(_t(spark, d, "documents", "doc_id", "text"), {"doc_id": fn.col("doc_id"), "n_bytes": fn.len_str(fn.col("text"))})


def _keys(spark, d):
    return _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _row():
    return {c: fn.col(c) for c in ("l_orderkey", "l_linenumber")}


def _a():
    return fn.col("l_partkey")


def _b():
    return fn.col("l_suppkey")


ROW_SQL = "l_orderkey, l_linenumber"


@plan("arith_add_sub_mul", f"select {ROW_SQL}, l_partkey + l_suppkey as a, l_partkey - l_suppkey as s, l_partkey * l_suppkey as m from lineitem")
def _(spark, d):
    return project(_keys(spark, d), _row() | {"a": fn.add(_a(), _b()), "s": fn.sub(_a(), _b()), "m": fn.mul(_a(), _b())})


@plan("div_zero", f"select {ROW_SQL}, coalesce((l_suppkey - l_partkey) // nullif(l_suppkey % 3, 0), 0) as q from lineitem")
def _(spark, d):
    return project(_keys(spark, d), _row() | {"q": fn.div(_b() - _a(), _b() % 3)})


@plan("mod_zero", f"select {ROW_SQL}, coalesce((l_suppkey - l_partkey) % nullif(l_suppkey % 3, 0), 0) as r from lineitem")
def _(spark, d):
    return project(_keys(spark, d), _row() | {"r": fn.mod(_b() - _a(), _b() % 3)})


@plan("in_list", f"{ORACLE_HITS} select WatchID, TraficSourceID from hits where TraficSourceID in (-1, 3, 6)")
def _(spark, d):
    return filter_expr(hits(spark, d).select("WatchID", "TraficSourceID"), fn.in_ints(fn.col("TraficSourceID"), [-1, 3, 6]))


@plan(
    "case_when",
    f"{ORACLE_HITS} select WatchID, case when SearchEngineID = 0 then Referer else '' end as s, case when IsLink = 1 then ClientIP else -1 end as i from hits",
)
def _(spark, d):
    return project(
        hits(spark, d),
        {
            "WatchID": fn.col("WatchID"),
            "s": fn.case_when(fn.col("SearchEngineID") == 0, fn.col("Referer"), fn.lit_s("")),
            "i": fn.case_when(fn.col("IsLink") == 1, fn.col("ClientIP"), fn.lit_i(-1)),
        },
    )


@plan("extract_minute", f"{ORACLE_HITS} select WatchID, (EventTime // 60) % 60 as m, ((-EventTime) // 60) % 60 as neg from hits")
def _(spark, d):
    t = fn.col("EventTime")
    return project(hits(spark, d), {"WatchID": fn.col("WatchID"), "m": fn.extract_minute(t), "neg": fn.extract_minute(-t)})


@plan("trunc_minute", f"{ORACLE_HITS} select WatchID, EventTime - EventTime % 60 as m, (-EventTime) - (-EventTime) % 60 as neg from hits")
def _(spark, d):
    t = fn.col("EventTime")
    return project(hits(spark, d), {"WatchID": fn.col("WatchID"), "m": fn.date_trunc_minute(t), "neg": fn.date_trunc_minute(-t)})


def _spread_sql(name: str) -> str:
    steps = (16, 281470681808895), (8, 71777214294589695), (4, 1085102592571150095), (2, 3689348814741910323), (1, 6148914691236517205)
    out = f"(({name}) & 4294967295)"
    for shift, mask in steps:
        out = f"(({out} | ({out} << {shift})) & {mask})"
    return out


@plan("z_order_2d", f"select {ROW_SQL}, {_spread_sql('l_partkey')} | ({_spread_sql('l_suppkey')} << 1) as z from lineitem")
def _(spark, d):
    return project(_keys(spark, d), _row() | {"z": fn.z_order_2d(_a(), _b())})


@plan("json_get", "select event_id, coalesce(json_extract_string(props, '$.k'), '') as k, coalesce(json_extract_string(props, '$.none'), '') as missing from events")
def _(spark, d):
    props = fn.col("props")
    return project(_t(spark, d, "events", "event_id", "props"), {"event_id": fn.col("event_id"), "k": fn.json_get(props, "k"), "missing": fn.json_get(props, "none")})


@plan("json_get_int", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(json_extract_string(props, '$.k') as bigint) as textual from events")
def _(spark, d):
    props = fn.col("props")
    return project(
        _t(spark, d, "events", "event_id", "props"),
        {"event_id": fn.col("event_id"), "k": fn.json_get_int(props, "k"), "textual": fn.json_get_int(props, "k", textual=True)},
    )


def _list():
    return F.when(_a() % 5 == 0, "[]").otherwise(F.concat(F.lit("["), (_a() % 50).cast("string"), F.lit(","), (_b() % 50).cast("string"), F.lit("]")))


LIST_SQL = "(case when l_partkey % 5 = 0 then '[]' else concat('[', l_partkey % 50, ',', l_suppkey % 50, ']') end)"


@plan(
    "array_length",
    f"select {ROW_SQL}, cast(case when length({LIST_SQL}) > 2 then length({LIST_SQL}) - length(replace({LIST_SQL}, ',', '')) + 1 else 0 end as bigint) as n from lineitem",
)
def _(spark, d):
    return project(_keys(spark, d), _row() | {"n": fn.array_length(_list())})


@plan("array_contains", f"select {ROW_SQL}, cast(regexp_matches({LIST_SQL}, '[\\[,]42[,\\]]') as bigint) as has from lineitem")
def _(spark, d):
    return project(_keys(spark, d), _row() | {"has": fn.array_contains_int(_list(), 42)})


@plan(
    "haversine",
    "with p as (select c_custkey, (c_custkey % 90) * 1.0e0 as lat, (c_custkey % 180) * 1.0e0 as lng from customer) select c_custkey, "
    "round(2 * 6371.0e0 * atan2(sqrt(a), sqrt(1 - a)), 6) as km from (select c_custkey, "
    "pow(sin(radians(10.5e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10.5e0)) * pow(sin(radians(20.25e0 - lng) / 2), 2) as a from p)",
)
def _(spark, d):
    k = fn.col("c_custkey")
    km = fn.haversine((k % 90).cast("double"), (k % 180).cast("double"), F.lit(10.5), F.lit(20.25))
    return project(_t(spark, d, "customer", "c_custkey"), {"c_custkey": k, "km": F.round(km, 6)})


def _price():
    return F.concat(F.when(_b() % 2 == 0, "-").otherwise(""), (_a() % 100).cast("string"), F.lit("."), F.lpad((_b() % 1000).cast("string"), 3, "0"))


PRICE_SQL = "concat(case when l_suppkey % 2 = 0 then '-' else '' end, l_partkey % 100, '.', lpad(cast(l_suppkey % 1000 as varchar), 3, '0'))"
CENTS_SQL = f"(case when {PRICE_SQL} like '-%' then -1 else 1 end * (l_partkey % 100 * 100 + (l_suppkey % 1000) // 10))"


@plan("parse_decimal", f"select {ROW_SQL}, cast({CENTS_SQL} as bigint) as cents from lineitem")
def _(spark, d):
    return project(_keys(spark, d), _row() | {"cents": fn.parse_decimal(_price(), 2)})


@plan(
    "format_decimal",
    f"select {ROW_SQL}, concat(case when v < 0 then '-' else '' end, abs(v) // 100, '.', lpad(cast(abs(v) % 100 as varchar), 2, '0')) as t from (select *, l_suppkey - l_partkey as v from lineitem)",
)
def _(spark, d):
    return project(_keys(spark, d), _row() | {"t": fn.format_decimal(_b() - _a(), 2)})


@plan("decimal_mul", f"select {ROW_SQL}, (l_suppkey - l_partkey) * l_partkey // 100 as m from lineitem")
def _(spark, d):
    return project(_keys(spark, d), _row() | {"m": fn.decimal_mul(_b() - _a(), _a(), 2)})
