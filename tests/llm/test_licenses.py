import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licenses

SCANNER = licenses.Scanner()
CUT = [licenses.words_of(t.encode()) for _, t in licenses.TEMPLATES]
GRAMS = {tuple(t[i:j]) for t in CUT for i in range(len(t)) for j in range(i + 1, min(len(t), i + 40) + 1)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, len(CUT) - 1), st.integers(0, 60), st.integers(1, 9), st.booleans()), max_size=10))
def test_matching_statistics(parts):
    words = []
    for k, at, n, gap in parts:
        words += CUT[k][at : at + n] + [b"qqq"] * gap
    want = []
    for end in range(len(words)):
        n = 0
        while n <= end and n < 40 and tuple(words[end - n : end + 1]) in GRAMS:
            n += 1
        want.append(n)
    ids = [SCANNER.index.get(w, -1) for w in words]
    assert [n for _, n in SCANNER.automaton.statistics(ids)] == want
    maximal = [(e, want[e]) for e in range(len(words)) if want[e] >= licenses.LEAST and (e + 1 == len(words) or want[e + 1] <= want[e])]
    assert [(e, n) for e, n, _ in SCANNER.matches(words)] == maximal


def test_words_follow_the_contract():
    text = "CC-BY été A1_b\x7fc \x00x"
    want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    assert [w.decode() for w in licenses.words_of(text.encode())] == want


def test_places_overlap_and_labels():
    words = licenses.words_of(b"CC BY cc by. General public license; all rights all rights reserved")
    assert SCANNER.places(words) == [(0, "cc-by"), (2, "cc-by"), (4, "gpl"), (9, "reserved")]


def test_chained_span_over_an_edit():
    notice = dict((k, v) for k, v in licenses.TEMPLATES if k == "isc")["isc"].replace("this software for any", "this fine software for nearly any")
    spans = SCANNER.spans(licenses.words_of(f"intro words {notice} outro".encode()))
    assert [s[2] for s in spans] == ["isc"]
    assert spans[0][0] == 2 and spans[0][3] > 0.6


def test_table(spark, odd_docs, empty_docs):
    rows = licenses.scan(odd_docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert tuple(by[1])[1:8] == (0, 0, None, None, "", "", 0.0)
    assert (by[3]["n_base"], by[3]["base_labels"], by[3]["labels"], by[3]["score"]) == (1, "reserved", "reserved", 1.0)
    assert by[3]["first_word"] == by[3]["last_word"] == 13
    assert by[6]["n_words"] == 40_000
    assert licenses.scan(empty_docs).collect() == []


def test_base_columns_match_sql(spark, duck, sf_dir):
    got = licenses.op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base").collect()
    want = duck.sql(
        r"""
        with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents)
        select doc_id, len(w), len(list_filter(range(1, len(w) + 1), lambda i: (w[i] = 'cc' and w[i + 1] = 'by')
               or (w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license') or (w[i] = 'all' and w[i + 1] = 'rights' and w[i + 2] = 'reserved')))
        from w"""
    ).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def _plain_row(text):
    """The query's columns by the definitions alone: phrases by slices, matches
    by looking every run of words up, chains by their rule."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for i in range(len(words)) for p, label in licenses.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    longest = []
    for end in range(len(words)):
        n = longest[-1] + 1 if longest else 1  # a longest suffix grows by one word at most
        while n and tuple(words[end - n + 1 : end + 1]) not in EVERY:
            n -= 1
        longest.append(n)
    chains = {}
    for end, n in enumerate(longest):
        if n < licenses.LEAST or (end + 1 < len(words) and longest[end + 1] > n):
            continue
        for k, first in EVERY[tuple(words[end - n + 1 : end + 1])].items():
            mine = chains.setdefault(k, [])
            if mine and 0 < end - n + 1 - mine[-1][0] <= licenses.GAP and first > mine[-1][1]:
                mine[-1] = (end, first + n - 1, mine[-1][2] + n)
            else:
                mine.append((end, first + n - 1, n))
    cover = [(licenses.TEMPLATES[k][0], min(1.0, n / len(CUT[k]))) for k, chain in chains.items() for *_, n in chain if n >= licenses.COVER * len(CUT[k])]
    base = sorted({label for _, label in places})
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    score = 1.0 if places else max((c for _, c in cover), default=0.0)
    return (len(words), len(places), *ends, ",".join(base), ",".join(sorted({*base, *(label for label, _ in cover)})), score)


EVERY = {}
for _k, _t in enumerate(CUT):
    for _i in range(len(_t)):
        for _j in range(_i + 1, len(_t) + 1):
            EVERY.setdefault(tuple(w.decode() for w in _t[_i:_j]), {}).setdefault(_k, _i)


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.op10_license_scan(spark, sf_dir).collect()}
    assert got == {k: _plain_row(t) for k, t in texts.items()}


def test_notices_equal_brute_force(docs_of):
    """Whole, edited, cut, repeated and mixed notices; ties of two templates."""
    texts = []
    for k, (_, notice) in enumerate(licenses.TEMPLATES):
        cut = notice.split()
        texts += [notice, f"a {notice} b {notice}", " ".join(w for i, w in enumerate(cut) if i % 11 != 7), " ".join(cut[: len(cut) // 2]), f"{notice} {licenses.TEMPLATES[k - 1][1]}"]
    got = {r["doc_id"]: tuple(r)[1:8] for r in licenses.scan(docs_of(list(enumerate(texts)))).collect()}
    assert got == {k: _plain_row(t) for k, t in enumerate(texts)}
