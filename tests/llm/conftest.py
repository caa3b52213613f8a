import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMA_EXTRA = DOC + ", n_lines string, __x string, sig string, node string"


def make_docs(spark, texts, langs=None, ids=None):
    rows = [((i if ids is None else ids[i]), t, None if langs is None else langs[i], f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture
def docs_of(spark):
    return lambda texts, **kw: make_docs(spark, texts, **kw)


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns whose names the operators use too."""
    long = "\n".join(f"long line number {i} with enough words to be a key of its own" for i in range(3000))
    rows = [
        (1, "hello world this is a text", "en", "a", 5, "x", "x", "x", "x"),
        (1, "hello world this is a text", "en", "a", 5, "x", "x", "x", "x"),
        (2, None, None, None, None, None, None, None, None),
        (None, "orphan text without an id", None, "b", None, None, None, None, None),
        (3, "", "en", "a", 0, "", "", "", ""),
        (4, long, "de", "b", len(long), "y", "y", "y", "y"),
        (5, "\n\n \t", "en", "b", 4, "z", "z", "z", "z"),
        (6, "ünïcödé \U0001f600 text", "fr", "c", 10, "z", "z", "z", "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA_EXTRA)
