from pyspark.sql import functions as F

from tidemark.llm import decontaminate as dc
from tidemark.operators import explain

ITEM = "A train leaves Rome and travels 120 km in 3 hours, then 120 km more before it reaches Milan tonight."


def _bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc long, words string")


def test_reparameterised_question(spark, docs_of):
    same = "x y. A train leaves Paris and travels 240 km in 5 hours, then 240 km more before it reaches London tonight. z"
    broken = same.replace("then 240", "then 999")
    docs = docs_of([(1, same), (2, broken), (3, ITEM.upper()), (4, "a train leaves rome and travels fast"), (5, None), (6, "")])
    got = {r["doc_id"]: r for r in dc.contaminated(docs, _bench(spark, [(1, ITEM, 0, "")])).collect()}
    assert 1 in got and got[1]["n_changed"] > 0
    assert 2 not in got  # one slot of the item stands for two values
    assert not {4, 5, 6} & set(got)


def test_items_of_one_template_keep_their_slots(spark, docs_of):
    item = "a farmer sold us {} apples and then gave {} pears to every child that came"
    bench = _bench(spark, [(1, item.format(3, 3), 0, ""), (2, item.format(3, 5), 0, ""), (3, item.format(3, 5), 0, "")])
    docs = docs_of([(1, "x. " + item.format(3, 5) + " z"), (2, "x. " + item.format(4, 4) + " z")])
    got = sorted((r["doc_id"], r["item_id"], r["n_changed"]) for r in dc.contaminated(docs, bench).collect())
    assert (1, 2, 0) in got and not {(1, 1), (1, 3)} & {g[:2] for g in got}
    assert {g[:2] for g in got if g[0] == 2} >= {(2, 1)}


def test_verbatim_copies_whatever_surrounds_them(spark, docs_of):
    short, dense = "What is the capital city of modern France", "Anna 12 Berta 14 Clara 16 Doris 18 Emma 20"
    names = "the letters of Emma Stone and Mary Ann reached Peter Gray in Old Rome"
    bench = _bench(spark, [(1, short, 0, ""), (2, dense, 0, ""), (3, names, 0, "")])
    near = "Anna 12 Berta 14 Clara 16 Doris 18 Emma 21"
    docs = docs_of([(1, "Question: " + short), (2, f"see {dense} here"), (3, names.lower()), (4, names.upper()), (5, names.replace(" ", "\n")), (6, near), (7, "nothing of it")])
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 3)}


def test_exact_passage_and_repeats(spark, docs_of, odd_docs):
    text = "thble er onand thes inan orer the whand of inth eron thst an erha"
    docs = docs_of([(1, f"Some start. {text} and end"), (1, f"Some start. {text} and end"), (2, text.upper().replace(" ", " | ")), (None, text), (3, text[:30])])
    got = dc.contaminated(docs, _bench(spark, [(9, text, 0, ""), (4, text, 0, ""), (5, "too short", 0, ""), (6, None, 0, "")])).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == [(1, 4), (2, 4), (None, 4)]
    out = dc.drop_contaminated(docs, _bench(spark, [(4, text, 0, "")]))
    assert [r["doc_id"] for r in out.collect()] == [3]
    assert out.columns == docs.columns


def test_odd_rows_and_empty_tables(spark, odd_docs, empty_docs):
    bench = _bench(spark, [(1, ITEM, 0, "")])
    assert dc.contaminated(odd_docs, bench).collect() == []
    assert dc.contaminated(empty_docs, bench).collect() == []
    assert dc.contaminated(odd_docs, bench.limit(0)).collect() == []
    assert dc.drop_contaminated(odd_docs, bench).count() == odd_docs.count()


def test_slots_align_with_the_template(spark, docs_of):
    docs = docs_of([(1, "In New York City we paid 1,200.50 dollars... and 3.5km, ok 7"), (2, "a1b2 c\x01\x02d 5 m"), (3, None)])
    m = dc.marked(F.col("text"))
    assert all(r[0] == r[1] for r in docs.select(F.size(dc.template(m)), F.size(dc.values(m))).collect())
    words = docs.filter("doc_id = 1").select(dc.template(m)).first()[0]
    assert words == ["in", "\x02", "\x02", "\x02", "we", "paid", "\x01", "\x03", "and", "\x01", "km", "ok", "\x01"] or "\x01" in words


def test_plan_is_native(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plan = explain(dc.contaminated(docs, bench))
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_slots_are_consistent_both_ways(spark, docs_of):
    item = "a farmer sold us {} apples and then gave {} pears to every child that came"
    bench = _bench(spark, [(1, item.format(3, 5), 0, "")])
    docs = docs_of([(1, item.format(8, 9)), (2, item.format(8, 8))])
    got = {r["doc_id"]: (r["n_slots"], r["n_changed"]) for r in dc.contaminated(docs, bench).collect()}
    assert got == {1: (2, 2)}  # in the second, 8 would stand for 3 and for 5


def test_coverage_and_slots_hold_on_one_alignment(spark, docs_of):
    """Two halves of an item far apart are no copy; a word put in is one."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(30)]
    bench = _bench(spark, [(1, " ".join(words), 0, "")])
    gap = " ".join(f"g{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100))
    docs = docs_of([(1, " ".join([*words[:18], gap, *words[12:]])), (2, " ".join([*words[:15], "inserted", *words[15:]]))])
    got = {r["doc_id"]: r["n_windows"] for r in dc.contaminated(docs, bench).collect()}
    assert got == {2: 16}


def test_items_under_a_window_are_whole_texts(spark, docs_of):
    bench = _bench(spark, [(1, "Who is Ada?", 0, ""), (2, "Yes", 0, "")])
    docs = docs_of([(1, "who is ada"), (2, "and who is ada then, yes"), (3, "YES!"), (4, "no")])
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()} == {(1, 1), (3, 2)}


def test_the_shuffle_join_gives_the_same(spark, sf_dir, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(map(tuple, dc.contaminated(docs, bench).collect()))
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(dc, "GATE_LEAST", 1)
    monkeypatch.setattr(dc, "GATE_MOST", 4)  # nearly every place is hashed
    assert sorted(map(tuple, dc.contaminated(docs, bench).collect())) == want


def test_sql(spark, duck, sf_dir):
    got = dc.op5_decontaminate(spark, sf_dir)
    want = duck.sql(f"select {', '.join(got.columns)} from ({dc.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
