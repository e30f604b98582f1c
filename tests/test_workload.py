"""Every engine query against DuckDB on the same files."""

import math

import pytest

from tidemark.plans import workload
from tidemark.plans.hits import COLUMNS, hits
from tidemark.plans.registry import ORACLE, QUERIES, SCALED


def _cell(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x


def _table(pdf):
    names = sorted(pdf.columns)
    return names, sorted(([_cell(v) for v in r] for r in pdf[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert _table(got) == _table(duck.sql(ORACLE[name]).df())


def test_parameters():
    p = workload.Params()
    assert (p.user_id, p.counter_id, p.month_from, p.month_to) == (435090932899640449, 62, 15887, 15917)
    assert (p.days_from, p.days_to, p.min_count, p.referer_hash, p.url_hash) == (15900, 15901, 100_000, 3594120000172545465, 2868770270353813622)


def test_unknown_query(spark, sf_dir):
    with pytest.raises(ValueError, match="no such query"):
        workload.build(43, hits(spark, sf_dir))


def test_definition_constants_run(spark, sf_dir):
    h = hits(spark, sf_dir)
    assert h.columns == list(COLUMNS)
    for number in (19, 27, 36, 40, 42):
        assert workload.build(number, h).collect() == []


def test_scan_reads_only_needed_columns(spark, sf_dir):
    from tidemark.operators import explain

    plan = explain(workload.build(15, hits(spark, sf_dir), SCALED))
    assert "ReadSchema: struct<user_id:bigint>" in plan
    assert "TakeOrderedAndProject" in plan
