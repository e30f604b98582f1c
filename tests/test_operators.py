import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import aggregate, explain, filter_expr, filter_int, filter_string, hash_join, project, sort


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_join_keeps_both_keys_and_build_columns_first(spark):
    users = spark.createDataFrame([(1, "alice"), (2, "bob"), (3, "eve")], "user_id long, name string")
    orders = spark.createDataFrame([(100, 1, 50), (101, 2, 30), (102, 1, 20), (103, 99, 77), (104, 3, 5)], "order_id long, user_id long, amount long")
    out = hash_join(users, orders, "user_id", "user_id")
    assert out.columns == ["user_id", "name", "order_id", "user_id_probe", "amount"]
    got = {(r[0], r[1], r[2], r[4]) for r in out.collect()}
    assert got == {(1, "alice", 100, 50), (2, "bob", 101, 30), (1, "alice", 102, 20), (3, "eve", 104, 5)}


def test_join_multiplies_duplicates_and_handles_empty_build(spark):
    a = spark.createDataFrame([(1,), (1,)], "k long")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k2 long, v string")
    assert hash_join(a, b, "k", "k2").count() == 4
    assert _rows(hash_join(a.limit(0), b, "k", "k2")) == []


def test_filters(spark):
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, "b")], "i long, s string")
    for kind, want in {"eq": [2], "ne": [1, 3], "lt": [1], "le": [1, 2], "gt": [3], "ge": [2, 3]}.items():
        assert [r[0] for r in filter_int(df, "i", kind, 2).collect()] == want
    assert [r[0] for r in filter_string(df, "s", "contains", "").collect()] == [1, 2, 3]
    assert [r[0] for r in filter_string(df, "s", "contains", "b").collect()] == [1, 3]
    assert [r[0] for r in filter_string(df, "s", "notempty").collect()] == [1, 3]
    with pytest.raises(TypeError):
        filter_int(df, "s", "eq", 1)
    with pytest.raises(TypeError):
        filter_string(df, "i", "eq", "1")


def test_aggregate_shapes(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (1, 3.0, "b"), (2, 4.0, "a")], "k long, x double, s string")
    got = aggregate(df, ["k"], {"s": fn.sum_("x", 0.0), "lo": fn.min_("x", 0.0), "m": fn.min_("s", "")})
    assert sorted(_rows(got)) == [(1, 5.0, 2.0, "a"), (2, 4.0, 4.0, "a")]
    assert sorted(_rows(aggregate(df, ["s"], {}))) == [("a",), ("b",)]
    empty = df.limit(0)
    assert _rows(aggregate(empty, [], {"n": fn.count_star(), "t": fn.sum_("k")})) == [(0, 0)]
    grouped = aggregate(empty, ["k"], {"n": fn.count_star()})
    assert _rows(grouped) == []
    assert grouped.columns == ["k", "n"]
    assert _rows(filter_expr(grouped, F.col("n") > 1)) == []


def test_sum_of_text_is_an_error(spark):
    with pytest.raises(Exception):  # noqa: B017
        aggregate(spark.createDataFrame([("a",)], "s string"), [], {"t": fn.sum_("s")}).collect()


def test_negative_zero_groups_with_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert aggregate(df, ["x"], {"n": fn.count_star()}).count() == 1


def test_sort_limit_offset(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(10)], "a long, b long")
    keys = [("a", False), ("b", True)]
    every = _rows(sort(df, keys))
    assert every == sorted(every, key=lambda r: (-r[0], r[1]))
    assert _rows(sort(df, keys, 4)) == every[:4]
    assert _rows(sort(df, keys, 4, 3)) == every[3:7]
    assert _rows(sort(df, keys, 0, 8)) == every[8:]
    assert _rows(sort(df, keys, 5, 99)) == []
    assert "TakeOrderedAndProject" in explain(sort(df, keys, 4, 3))


def test_offset_without_limit_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 16).selectExpr("id * 7919 % 5000 as a", "id % 3 as b")
    for offset in (1, 1249, 1250, 2501, 4999, 5000, 9999):
        rest = sort(df, [("a", False)], 0, offset)
        assert [r["a"] for r in rest.collect()] == list(range(4999 - offset, -1, -1))
        assert rest.columns == ["a", "b"]
        assert "SinglePartition" not in explain(rest) or offset >= 5000
    assert sort(df.filter("a < 0"), [("a", True)], 0, 3).collect() == []


def test_project_passes_nothing_through(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    out = project(df, {"s": fn.add(F.col("a"), F.col("b")), "one": fn.lit_i(1)})
    assert out.columns == ["s", "one"]
    assert _rows(out) == [(3, 1)]
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        project(df, {"x": F.col("missing")})


def test_partial_aggregation_before_the_exchange(spark):
    plan = explain(aggregate(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], {"n": fn.count_star()}))
    assert "partial_count" in plan


def test_minute_counts(spark):
    from tidemark.streaming import minute_counts

    df = spark.sql("select timestamp_seconds(x) as ts from values (0), (59), (60), (130) as t(x)")
    assert sorted(_rows(minute_counts(df))) == [(0, 2), (60, 1), (120, 1)]
