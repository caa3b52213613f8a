"""Components of a path and a hub, and what Spark estimates of their size after the rounds."""

from cohortlens.llm import common


def test_size_estimates_do_not_grow_with_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "EDGES_A_TASK", 20)
    path = [(i * 7 % 23, (i + 1) * 7 % 23) for i in range(22)]
    edges = spark.createDataFrame([*path, *[(1000, 1001 + i) for i in range(9)]], "a long, b long")
    found = common.connected_components(edges)
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(23)} | {(i, 1000) for i in range(1000, 1010)}
    assert "E+" not in found._jdf.queryExecution().optimizedPlan().stats().simpleString()
