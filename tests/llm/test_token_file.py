import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import token_file

WHOLE = Tokenizer.from_file(token_file.default_vocabulary())
CODER = token_file.WordEncoder(token_file.default_vocabulary())


def _ids(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAéÉßÿ'sStTlLdD019 \n\t.,<|>ΣİǅǺ​\x1c\x85"))))
def test_word_cache_equals_the_library(text):
    assert np.frombuffer(CODER.encode(text.encode()), "<u4").tolist() == _ids(text)


def test_added_tokens_in_the_text_equal_the_library():
    library = Tokenizer.from_file(token_file.default_vocabulary())
    marks = ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|")
    for text in [f for m in marks for f in (m, f"end here {m} next", f"a{m}b", f"{m}{m} é{m}日本", f"it's{m}'s\n{m}")]:
        assert np.frombuffer(CODER.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def _brute(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*_ids(t or ""), 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_round_trip(spark, odd_docs, tmp_path):
    path = f"file://{tmp_path}/t"
    token_file.write_tokens(odd_docs, path)
    rows = token_file.read_tokens(spark, path).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids")
    got = rows.mapInArrow(token_file._digest, "doc_id long, start long, n_tokens long, ids_crc32 long").orderBy("start").collect()
    assert [tuple(r) for r in got] == _brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_encodings_page_index_and_selective_read(spark, docs_of, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from tidemark.operators import explain

    token_file.write_tokens(docs_of([(k, f"text number {k}") for k in range(500)]), f"file://{tmp_path}/t")
    group = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/t/part-*"))[0]).metadata.row_group(0)
    by_name = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
    assert any("DICTIONARY" in e for e in by_name["ids.list.element"].encodings)
    assert by_name["doc_id"].has_offset_index and by_name["doc_id"].has_column_index
    meta = token_file.read_metadata(spark, f"file://{tmp_path}/t").filter("doc_id = 77")
    assert meta.count() == 1
    plan = explain(meta)
    assert "ids" not in plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "EqualTo(doc_id,77)" in plan


def test_empty(spark, empty_docs, tmp_path):
    token_file.write_tokens(empty_docs, f"file://{tmp_path}/t")
    assert token_file.read_tokens(spark, f"file://{tmp_path}/t").collect() == []
