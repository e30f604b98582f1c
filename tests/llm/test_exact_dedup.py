import hashlib

from tidemark.llm import exact_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    top = {t: max(ids, key=lambda x: (x is not None, x)) for t, ids in groups.items()}
    out = []
    for i, t in rows:
        n = (t or "").translate(FOLD)
        out.append((i, top[n], len(groups[n]), i == top[n], hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_digest_matches_brute_force(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = exact_dedup.digest(odd_docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)


def test_sql(spark, duck, sf_dir):
    got = exact_dedup.op2_exact_dedup(spark, sf_dir)
    want = duck.sql(f"select {', '.join(got.columns)} from ({exact_dedup.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_drop_keeps_one_row_and_all_columns(odd_docs):
    out = exact_dedup.drop_exact_copies(odd_docs)
    assert out.columns == odd_docs.columns
    rows = [(r["text"] or "").translate(FOLD) for r in out.collect()]
    every = {(r["text"] or "").translate(FOLD) for r in odd_docs.collect()}
    assert sorted(rows) == sorted(every)


def test_one_huge_group(docs_of):
    docs = docs_of([(k, "Same TEXT" if k % 3 else f"other {k}") for k in range(3000)])
    out = exact_dedup.exact_groups(docs)
    assert out.filter("kept").count() == 1001
    assert {tuple(r) for r in out.filter("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(2999, 2000)}


def test_empty(empty_docs):
    assert exact_dedup.digest(empty_docs).collect() == []
    assert exact_dedup.drop_exact_copies(empty_docs).collect() == []
