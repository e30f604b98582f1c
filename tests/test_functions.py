import math

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn


def _values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("v")).collect()]


def test_z_order(spark):
    rows = [(0, 0), (1, 0), (0, 1), (1, 1), (-1, -1), (0xFFFFFFFF, 0)]
    got = _values(spark, rows, "a long, b long", fn.z_order_2d(F.col("a"), F.col("b")))
    assert got == [0, 1, 2, 3, -1, 0x5555555555555555]


PEOPLE = [('{"name":"alice","age":30,"city":"NY"}',), ('{"name":"bob","age":25}',), ('{"name":"eve","age":99,"city":"LA"}',)]


@pytest.mark.parametrize("textual", [False, True])
def test_json(spark, textual):
    s = F.col("s")
    assert _values(spark, PEOPLE, "s string", fn.json_get(s, "name", textual)) == ["alice", "bob", "eve"]
    assert _values(spark, PEOPLE, "s string", fn.json_get(s, "city", textual)) == ["NY", "", "LA"]
    assert _values(spark, PEOPLE, "s string", fn.json_get_int(s, "age", textual)) == [30, 25, 99]


def test_textual_json_reads_what_is_not_json(spark):
    rows = [('{"o":{"k": "in"}}',), ('{"k" :  12x}',), ("k:1",), ('{"k":"open',), ('{"k":null}',), ('{"k":-7}',)]
    assert _values(spark, rows, "s string", fn.json_get(F.col("s"), "k", True)) == ["in", "12x", "", "", "null", "-7"]
    assert _values(spark, rows, "s string", fn.json_get_int(F.col("s"), "k", True)) == [0, 12, 0, 0, 0, -7]


def test_arrays(spark):
    rows = [("[1,2,3]",), ("[42]",), ("[]",), ("[1,2,3,42,5]",), ("x",), ("[1, 42]",), ("[142]",)]
    assert _values(spark, rows, "s string", fn.array_length(F.col("s"))) == [3, 1, 0, 5, 0, 2, 1]
    assert _values(spark, rows, "s string", fn.array_contains_int(F.col("s"), 42)) == [0, 1, 0, 1, 0, 0, 0]


def test_haversine(spark):
    km = _values(spark, [(55.7558, 37.6173, 59.9343, 30.3351)], "a double, b double, c double, d double", fn.haversine(*map(F.col, "abcd")))[0]
    assert abs(km - 633) < 5


def test_decimals(spark):
    texts = ["1.23", "10", "-0.5", "0.099", "", "abc", "1.5x", "+2."]
    assert _values(spark, [(t,) for t in texts], "s string", fn.parse_decimal(F.col("s"), 2)) == [123, 1000, -50, 9, 0, 0, 150, 200]
    assert _values(spark, [("12.9",)], "s string", fn.parse_decimal(F.col("s"), 0)) == [12]
    assert _values(spark, [(v,) for v in (123, 1000, -50, 9)], "v long", fn.format_decimal(F.col("v"), 2)) == ["1.23", "10.00", "-0.50", "0.09"]
    assert _values(spark, [(-7,)], "v long", fn.format_decimal(F.col("v"), 0)) == ["-7"]
    assert _values(spark, [(123, 1000), (-615, 1)], "a long, b long", fn.decimal_mul(F.col("a"), F.col("b"), 2)) == [1230, -6]


def test_integer_division_by_zero_is_zero(spark):
    rows = [(7, 2), (-7, 2), (7, 0), (-7, -2)]
    assert _values(spark, rows, "a long, b long", fn.div(F.col("a"), F.col("b"))) == [3, -3, 0, 3]
    assert _values(spark, rows, "a long, b long", fn.mod(F.col("a"), F.col("b"))) == [1, -1, 0, -1]


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        _values(spark, [(2**63 - 1,)], "a long", fn.add(F.col("a"), fn.lit_i(1)))


def test_minutes(spark):
    rows = [(61,), (-61,), (3600,), (0,)]
    assert _values(spark, rows, "t long", fn.extract_minute(F.col("t"))) == [1, -1, 0, 0]
    assert _values(spark, rows, "t long", fn.date_trunc_minute(F.col("t"))) == [60, -60, 3600, 0]


def test_length_is_in_bytes(spark):
    assert _values(spark, [("é",), ("",), ("ab",)], "s string", fn.len_str(F.col("s"))) == [2, 0, 2]


def test_like_has_no_escape(spark):
    rows = [("a\\b",), ("a_b",), ("axb",), ("a\nb",)]
    assert _values(spark, rows, "s string", fn.like(F.col("s"), "a\\b")) == [True, False, False, False]
    assert _values(spark, rows, "s string", fn.like(F.col("s"), "a_b")) == [True, True, True, True]
    assert _values(spark, rows, "s string", fn.like(F.col("s"), "%xb")) == [False, False, True, False]


def test_compare_case_in_logic(spark):
    rows = [(1, "a"), (2, "b"), (3, "é")]
    schema = "i long, s string"
    assert _values(spark, rows, schema, fn.compare("ge", F.col("s"), fn.lit_s("b"))) == [False, True, True]
    assert _values(spark, rows, schema, fn.in_ints(F.col("i"), [1, 3])) == [True, False, True]
    assert _values(spark, rows, schema, fn.case_when(F.col("i") == 2, F.col("s"), fn.lit_s(""))) == ["", "b", ""]
    either = fn.or_(F.col("i") == 1, fn.and_(F.col("i") > 1, fn.not_(F.col("s") == "b")))
    assert _values(spark, rows, schema, either) == [True, False, True]
    with pytest.raises(ValueError, match="unknown comparison"):
        fn.compare("xx", F.col("i"), F.col("i"))


def test_aggregates(spark):
    ints = spark.createDataFrame([(v,) for v in (3, 1, 4, 1, 5)], "v long")
    row = ints.agg(fn.sum_("v"), fn.min_("v"), fn.max_("v"), fn.count("v"), fn.avg("v"), fn.count_star()).first()
    assert tuple(row) == (14, 1, 5, 5, 2.8, 5)
    floats = spark.createDataFrame([(1.5,), (2.5,)], "v double")
    row = floats.agg(fn.sum_("v", 0.0), fn.min_("v", 0.0), fn.max_("v", 0.0), fn.avg("v")).first()
    assert tuple(row) == (4.0, 1.5, 2.5, 2.0)
    texts = spark.createDataFrame([(t,) for t in "abacb"], "v string")
    assert texts.agg(fn.count_distinct("v")).first()[0] == 3


def test_empty_aggregates_are_zero(spark):
    empty = spark.createDataFrame([], "v long, s string")
    row = empty.agg(fn.sum_("v"), fn.min_("v"), fn.max_("v"), fn.avg("v"), fn.count("v"), fn.count_star(), fn.count_distinct("v"), fn.min_("s", "")).first()
    assert tuple(row) == (0, 0, 0, 0.0, 0, 0, 0, "")


def test_close_doubles_stay_distinct(spark):
    near = spark.createDataFrame([(1.0,), (1.0 + 1e-9,), (0.0,), (-0.0,)], "v double")
    assert near.agg(fn.count_distinct("v")).first()[0] == 3
    assert math.isclose(near.agg(fn.max_("v", 0.0)).first()[0], 1.0, abs_tol=1e-8)
