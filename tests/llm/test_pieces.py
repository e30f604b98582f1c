import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces

CODER = pieces.PieceCoder(pieces.default_model())
V = CODER.v
TEXT = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abtheion ▁\n日é"))) | st.text(alphabet="thean ")


def _brute_score(chunk):
    """Best score over all segmentations, by plain dynamic programming over
    every substring."""
    best = [0.0] + [-1e300] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for at in range(end):
            s = V.scores.get(chunk[at:end], V.unknown if end - at == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[at] + s)
    return best[-1]


def _score(ids):
    total, skip = 0.0, 0
    for i in ids:
        if i in V.byte_of:
            b = V.byte_of[i]
            if b & 0xC0 != 0x80:  # the first byte of a character
                total += V.unknown
        else:
            total += V.scores[V.pieces[i]]
    return total - skip


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_round_trip_is_exact(text):
    assert CODER.decode(CODER.encode(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="thesandiong▁é日", max_size=60))
def test_viterbi_is_optimal_and_streaming_agrees(chunk):
    ids = pieces.viterbi(V, chunk)
    assert abs(_score(ids) - _brute_score(chunk)) < 1e-6
    stream = pieces.StreamingViterbi(V)
    for k in range(0, len(chunk), 3):
        stream.push(chunk[k : k + 3])
    assert stream.finish() == ids


@pytest.mark.parametrize("run", ["theation日", "a", " ", "-", "ab", "日"])
def test_window_is_bounded_and_time_linear(run):
    """Runs whose paths never meet keep one number per character, no window."""
    text = run.replace(" ", pieces.MARK) * (200_000 // len(run))
    stream = pieces.StreamingViterbi(V)
    begun = time.process_time()
    for k in range(0, len(text), 50_000):
        stream.push(text[k : k + 50_000])
        assert len(stream.text) < V.longest and len(stream.best) <= V.longest
    ids = stream.finish()
    assert time.process_time() - begun < 20
    assert stream.peak < V.longest
    assert len(stream.step) == 1
    assert CODER.decode(np.array(ids, "<u4").tobytes()).decode() in (text.replace(pieces.MARK, " "), text.replace(pieces.MARK, " ")[1:])


def test_paths_that_meet_are_committed():
    stream = pieces.StreamingViterbi(V)
    stream.push("theation日" * 20_000)
    assert len(stream.step) < 2 * pieces.SLICE
    assert stream.ids == pieces.viterbi(V, "theation日" * 20_000)[: len(stream.ids)]


def test_whole_texts_equal_a_plain_search():
    """Every document of the table, over whole texts: the best score of all
    segmentations, by dynamic programming over the escaped text."""
    import duckdb

    texts = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where length(text) < 700 limit 25").fetchall()
    for (text,) in texts:
        got = np.frombuffer(CODER.encode(text), "<u4").tolist()
        assert abs(_score(got) - _brute_score(pieces.MARK + text.replace(" ", pieces.MARK))) < 1e-4



@pytest.mark.parametrize("text", ["", " ", "\n", "  a  b ", "▁", "a▁ b", "\t\x00", "x" * 5000])
def test_edges(text):
    assert CODER.decode(CODER.encode(text)) == text.encode()


def test_tables(spark, odd_docs, empty_docs):
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.filter("doc_id != 4").collect()}
    rows = {r["doc_id"]: r for r in pieces.summary(odd_docs).collect()}
    assert len(rows) == odd_docs.select("doc_id").distinct().count()
    for i, t in texts.items():
        packed = CODER.encode(t)
        assert (rows[i]["n_ids"], rows[i]["ids_crc32"], rows[i]["exact"]) == (len(packed) // 4, zlib.crc32(packed), True)
    ids = pieces.encode(odd_docs)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(ids).collect()}
    assert all(back[i] == t for i, t in texts.items())
    checked = {r["doc_id"]: r for r in pieces.encode_checked(odd_docs).collect()}
    assert all(r["exact"] and r["n_ids"] == len(r["ids"]) for r in checked.values())
    assert np.frombuffer(CODER.encode(texts[3]), "<u4").tolist() == checked[3]["ids"]
    assert pieces.summary(empty_docs).collect() == []
