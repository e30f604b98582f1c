import pytest

from tidemark.__main__ import main
from tidemark.plans.hits import hits
from tidemark.plans.roundtrips import PLANS, place
from tidemark.sources import save_csv, save_parquet, write_schema


@pytest.mark.parametrize("name", PLANS)
def test_files_give_the_table_back(spark, duck, sf_dir, name):
    plan, sql = PLANS[name]
    got = plan(spark, sf_dir)
    want = duck.sql(f"select {', '.join(got.columns)} from ({sql})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_unknown_codec(spark):
    with pytest.raises(ValueError):
        save_parquet(spark.range(1), "unused", compression="zip")


def test_command_line(spark, sf_dir, capsys):
    at, table = place(spark), hits(spark, sf_dir)
    save_csv(table, f"{at}/csv")
    write_schema(spark, table.schema, f"{at}/schema")
    assert main(["convert", f"{at}/csv", f"{at}/schema", f"{at}/hits", "--sort-by", "CounterID", "EventDate"]) == 0
    assert capsys.readouterr().out.strip() == f"{table.count()} rows"
    assert main(["query", "0", f"{at}/hits"]) == 0
    assert capsys.readouterr().out.strip() == str(table.count())
    assert main(["explain", "1", f"{at}/hits"]) == 0
    assert "PushedFilters" in capsys.readouterr().out
    assert main(["query", "7", f"{at}/hits", "--out", f"{at}/out"]) == 0
    assert spark.read.text(f"{at}/out").count() > 0


def test_keys_with_dots(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import json_get

    row = spark.createDataFrame([('{"a.b":"x","a":{"b":"nested"},"it\'s":"q"}',)], "t string")
    assert tuple(row.select(json_get(F.col("t"), "a.b"), json_get(F.col("t"), "it's"), json_get(F.col("t"), "none")).first()) == ("x", "q", "")
