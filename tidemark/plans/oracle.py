"""DuckDB SQL of the workload, with the same parameters."""

from __future__ import annotations

from .hits import COLUMNS, ORACLE_HITS
from .workload import Params

TOTALS = "count(*) as c, cast(sum(IsRefresh) as bigint) as r, avg(ResolutionWidth) as a"


def _top(keys: str, aggregates: str, where: str = "", by: str = "c", limit: int = 10, offset: int = 0, source: str = "hits", having: str = "") -> str:
    return (
        f"select {keys}, {aggregates} from {source}"
        + (f" where {where}" if where else "")
        + f" group by {keys}"
        + (f" having {having}" if having else "")
        + f" order by {by} desc, {keys} limit {limit}"
        + (f" offset {offset}" if offset else "")
    )


def workload_sql(p: Params) -> list[str]:
    phrase, google = "SearchPhrase <> ''", "URL like '%google%'"
    users = "count(distinct UserID) as u"
    month = f"CounterID = {p.counter_id} and EventDate between {p.month_from} and {p.month_to} and IsRefresh = 0"
    days = f"CounterID = {p.counter_id} and EventDate between {p.days_from} and {p.days_to} and IsRefresh = 0"
    shown = ", ".join(COLUMNS)
    flow = f"(select TraficSourceID, SearchEngineID, AdvEngineID, case when SearchEngineID = 0 and AdvEngineID = 0 then Referer else '' end as src, URL as dst from hits where {month})"
    queries = [
        "select count(*) as c from hits",
        "select count(*) as c from hits where AdvEngineID <> 0",
        "select cast(sum(AdvEngineID) as bigint) as s, count(*) as c, avg(ResolutionWidth) as a from hits",
        "select avg(UserID) as a from hits",
        "select count(distinct UserID) as u from hits",
        "select count(distinct SearchPhrase) as u from hits",
        "select min(EventDate) as lo, max(EventDate) as hi from hits",
        "select AdvEngineID, count(*) as c from hits where AdvEngineID <> 0 group by 1 order by c desc, 1",
        _top("RegionID", users, by="u"),
        _top("RegionID", f"cast(sum(AdvEngineID) as bigint) as s, count(*) as c, avg(ResolutionWidth) as a, {users}"),
        _top("MobilePhoneModel", users, "MobilePhoneModel <> ''", by="u"),
        _top("MobilePhone, MobilePhoneModel", users, "MobilePhoneModel <> ''", by="u"),
        _top("SearchPhrase", "count(*) as c", phrase),
        _top("SearchPhrase", users, phrase, by="u"),
        _top("SearchEngineID, SearchPhrase", "count(*) as c", phrase),
        _top("UserID", "count(*) as c"),
        _top("UserID, SearchPhrase", "count(*) as c"),
        _top("UserID, SearchPhrase", "count(*) as c"),
        _top("UserID, m, SearchPhrase", "count(*) as c", source="(select UserID, (EventTime // 60) % 60 as m, SearchPhrase from hits)"),
        f"select UserID from hits where UserID = {p.user_id}",
        f"select count(*) as c from hits where {google}",
        _top("SearchPhrase", "min(URL) as url, count(*) as c", f"{google} and {phrase}"),
        _top("SearchPhrase", f"min(URL) as url, min(Title) as title, count(*) as c, {users}", f"Title like '%Google%' and not URL like '%.google.%' and {phrase}"),
        f"select {shown} from hits where {google} order by EventTime, WatchID limit 10",
        f"select SearchPhrase from hits where {phrase} order by EventTime, WatchID limit 10",
        f"select SearchPhrase from hits where {phrase} order by SearchPhrase limit 10",
        f"select SearchPhrase from hits where {phrase} order by EventTime, SearchPhrase limit 10",
        _top("CounterID", "avg(strlen(URL)) as l, count(*) as c", "URL <> ''", "l", 25, having=f"count(*) > {p.min_count}"),
        _top("Referer", "avg(strlen(Referer)) as l, count(*) as c, min(Referer) as m", "Referer <> ''", "l", 25, having=f"count(*) > {p.min_count}"),
        "select " + ", ".join(f"cast(sum(ResolutionWidth + {i}) as bigint) as s{i}" for i in range(90)) + " from hits",
        _top("SearchEngineID, ClientIP", TOTALS, phrase),
        _top("WatchID, ClientIP", TOTALS, phrase),
        _top("WatchID, ClientIP", TOTALS),
        _top("URL", "count(*) as c"),
        _top("one, URL", "count(*) as c", source="(select cast(1 as bigint) as one, URL from hits)"),
        _top("ClientIP, ip1, ip2, ip3", "count(*) as c", source="(select ClientIP, ClientIP - 1 as ip1, ClientIP - 2 as ip2, ClientIP - 3 as ip3 from hits)"),
        _top("URL", "count(*) as c", f"{month} and DontCountHits = 0 and URL <> ''"),
        _top("Title", "count(*) as c", f"{month} and DontCountHits = 0 and Title <> ''"),
        _top("URL", "count(*) as c", f"{month} and IsLink <> 0 and IsDownload = 0", offset=p.offset_pages),
        _top("TraficSourceID, SearchEngineID, AdvEngineID, src, dst", "count(*) as c", source=flow, offset=p.offset_pages),
        _top("URLHash, EventDate", "count(*) as c", f"{month} and TraficSourceID in (-1, 6) and RefererHash = {p.referer_hash}", offset=p.offset_small),
        _top("WindowClientWidth, WindowClientHeight", "count(*) as c", f"{month} and DontCountHits = 0 and URLHash = {p.url_hash}", offset=p.offset_large),
        f"select EventTime - EventTime % 60 as m, count(*) as c from hits where {days} and DontCountHits = 0 group by 1 order by 1 limit 10 offset {p.offset_pages}",
    ]
    return [f"{ORACLE_HITS} {q}" for q in queries]
