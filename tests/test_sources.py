import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.sources import convert_csv, load_csv, load_parquet, parquet_to_csv, read_schema, save_csv, save_parquet, save_tsv, type_of, write_schema
from tidemark.sources.schema import parse_schema


def _schema(**kinds):
    return StructType([StructField(n, type_of(k), False) for n, k in kinds.items()])


def _file(tmp_path, text, name="in.csv"):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def _parts(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def _rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("text", "kinds", "rows"),
    [
        ("1,2,first,4\n5,1,second,2\n8,17,third,2\n", {"a": "int64", "b": "int64", "name123": "string", "d": "int64"}, [(1, 2, "first", 4), (5, 1, "second", 2), (8, 17, "third", 2)]),
        ('1,"hello, world",100\n2,"say ""hi""",200\n3,simple,300\n', {"id": "int64", "text": "string", "value": "int64"}, [(1, "hello, world", 100), (2, 'say "hi"', 200), (3, "simple", 300)]),
        ('1,"two\nlines"\n', {"id": "int64", "text": "string"}, [(1, "two\nlines")]),
        (',,\n1,1.5,"x"\n', {"i": "int64", "f": "float64", "s": "string"}, [(0, 0.0, ""), (1, 1.5, "x")]),
        ("", {"a": "int64"}, []),
    ],
)
def test_load_csv(spark, tmp_path, text, kinds, rows):
    df = load_csv(spark, _file(tmp_path, text), _schema(**kinds))
    assert _rows(df) == rows
    assert df.columns == list(kinds)


@pytest.mark.parametrize("text", ["1,2\n1\n", "1,2,3\n", "1,x\n", "1,99999999999999999999\n", "12abc,1\n"])
def test_bad_rows_are_errors(spark, tmp_path, text):
    with pytest.raises(Exception):  # noqa: B017
        load_csv(spark, _file(tmp_path, text), _schema(a="int64", b="int64")).collect()


def test_csv_writer_quotes_only_where_needed(spark, tmp_path):
    rows = [("plain", "hello, world"), ('say "hi"', "two\nlines"), ("", "x")]
    save_csv(spark.createDataFrame(rows, "a string, b string").coalesce(1), str(tmp_path / "out"))
    assert _parts(tmp_path / "out") == 'plain,"hello, world"\n"say ""hi""","two\nlines"\n,x\n'
    assert _rows(load_csv(spark, str(tmp_path / "out"), _schema(a="string", b="string"))) == rows


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("1,hello\n2,world\n3,test\n", {"id": "int64", "name": "string"}),
        ('1,"hello, world"\n2,"say ""hi"""\n', {"id": "int64", "text": "string"}),
        ("1,2,first,4\n5,6,second,8\n", {"a": "int64", "b": "int64", "name": "string", "d": "int64"}),
    ],
)
def test_round_trip_csv_parquet_csv(spark, tmp_path, text, kinds):
    convert_csv(spark, _file(tmp_path, text), _schema(**kinds), str(tmp_path / "t"))
    schema = parquet_to_csv(spark, str(tmp_path / "t"), str(tmp_path / "back"))
    assert _parts(tmp_path / "back") == text
    assert [(f.name, f.dataType) for f in schema.fields] == [(f.name, f.dataType) for f in _schema(**kinds).fields]


def test_empty_input_converts_to_empty_table(spark, tmp_path):
    convert_csv(spark, _file(tmp_path, ""), _schema(a="int64"), str(tmp_path / "t"))
    assert load_parquet(spark, str(tmp_path / "t")).count() == 0


def test_schema_file(spark, tmp_path):
    assert read_schema(spark, _file(tmp_path, "a,int64\n\nb,string\n")) == _schema(a="int64", b="string")
    write_schema(spark, _schema(x="int64", y="string", z="float64"), str(tmp_path / "s"))
    assert _parts(tmp_path / "s") == "x,int64\ny,string\nz,float64\n"
    assert read_schema(spark, str(tmp_path / "s")) == _schema(x="int64", y="string", z="float64")


def test_type_names():
    assert (type_of("int64"), type_of("float64"), type_of("string")) == (LongType(), DoubleType(), StringType())
    with pytest.raises(ValueError, match="unknown type"):
        type_of("unknown")
    with pytest.raises(ValueError, match="comma"):
        parse_schema(["a int64"])
    with pytest.raises(ValueError, match="unknown type"):
        parse_schema(["a,int64\r"])


def test_tsv_result_text(spark, tmp_path):
    save_tsv(spark.createDataFrame([(1, 2.5, "a b")], "i long, f double, s string").coalesce(1), str(tmp_path / "o"))
    assert _parts(tmp_path / "o") == "1\t2.500000\ta b\n"


def test_scan_pushes_filters_and_columns(spark, tmp_path):
    from tidemark.operators import explain, filter_int, scan

    save_parquet(spark.range(1000).selectExpr("id a", "id % 7 b", "cast(id as string) c"), str(tmp_path / "t"), sort_by=["a"])
    plan = explain(filter_int(scan(spark, str(tmp_path / "t"), ["a", "b"]), "a", "eq", 5))
    assert "PushedFilters: [IsNotNull(a), EqualTo(a,5)]" in plan
    assert "ReadSchema: struct<a:bigint,b:bigint>" in plan
