"""How many Python workers a task of a pipeline stage holds at once."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import decontam, langid, linededup


@pytest.fixture
def docs(spark, docs_of):
    line = "a line of more than forty letters that many documents repeat"
    texts = [f"text {i} has its own words and a few common ones {i * 7} {i * 11}\n{line}" for i in range(12)]
    return docs_of([*texts, *texts[:2]], langs=["en"] * 14)


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([("a", "one two three four five six seven eight nine ten eleven twelve thirteen"), ("b", "text 3 has its own words")], "item_id string, text string")


def python_chains(df):
    """Python operators of the plan that feed another one in the same task."""
    found = []

    def walk(node, above):
        name = node.nodeName()
        python = "Arrow" in name or "Python" in name
        if python and above:
            found.append(name)
        above = python or above and name in ("Project", "Filter", "Union")
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), above)

    walk(df._jdf.queryExecution().optimizedPlan(), False)
    return found


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES if f is not corpus_pipeline.decontamination and f is not corpus_pipeline.mix_sources], ids=lambda f: f.__name__)
def test_a_task_of_a_stage_holds_one_worker(spark, docs, stage):
    assert python_chains(stage(spark, docs, "")) == []


@pytest.mark.parametrize("shard_words", [10**9, 15])
def test_a_task_of_decontamination_holds_one_worker(docs, bench, monkeypatch, shard_words):
    monkeypatch.setattr(decontam.find_contamination, "__defaults__", (13, shard_words, *decontam.find_contamination.__defaults__[2:]))
    kept = decontam.decontaminate(docs, bench)
    assert python_chains(kept) == []
    assert kept.count() == 13  # text 3 holds the whole of item b


def test_a_task_that_drops_many_keys_holds_one_worker(docs):
    assert python_chains(linededup.dedup_lines(docs, most_keys=0)) == []


def test_languages_are_learned_without_rows_from_the_driver(spark, docs, monkeypatch):
    """Rows of Python objects are pickled anew by Python workers of another kind, which stay."""

    def made(*args, **kw):
        raise AssertionError("a frame of Python objects was made")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", made)
    assert list(langid.learn(docs.select("text", "lang", F.xxhash64("doc_id").alias("__order")))) == ["en"]


def test_shares_of_hashes(spark):
    """The share of a language's rows to learn from, as plain Python has it."""
    sizes = [1, 2, 3, 6, 7, 8, 100, 12_345, 999_999_937, 1 << 40]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", langid.highest_hash(F.col("n"), 7).alias("most")).collect()
    assert {r.n: r.most for r in got} == {n: min((1 << 63) - 1, int((min(1.0, 7 / n) * 2 - 1) * (1 << 63))) for n in sizes}
