import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row long, score double, words string, key long"


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    full = [(i, t, lang, "s", None if t is None else len(t), None, 7, 0.5, "w", 3) for i, t, lang in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture
def docs_of(spark):
    return lambda rows: frame(spark, [(*r, None)[:3] for r in rows])


@pytest.fixture
def odd_docs(spark):
    """Nulls, empties, repeats, ties, case variants and a very long text."""
    long_text = " ".join(f"word{k % 977}x{k % 31}" for k in range(40_000))
    rows = [
        (1, None, None),
        (2, "", "en"),
        (3, "The cat sat on the mat and looked at the very small dog. All rights reserved.", "en"),
        (4, "THE CAT sat on the mat and looked at the very small dog. all rights reserved.", "en"),
        (4, "the cat sat on the mat and looked at the very small dog. all rights reserved.", "en"),
        (5, "É é \x00 \t\n 日本語 😀 ▁ mark", "fr"),
        (None, "the cat sat on the mat and looked at the very small dog. all rights reserved.", "en"),
        (6, long_text, "de"),
        (7, "a" * 30_000, None),
        (8, " \n\t ", "es"),
    ]
    return frame(spark, rows)


@pytest.fixture
def empty_docs(spark):
    return frame(spark, [])
