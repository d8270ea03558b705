"""Queries of a join with the vector index stay in tasks, and it finds what brute force finds."""

import numpy as np

from memspan.operators import vectorindex as V


def test_join_is_brute_force(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:340] = x[5]  # copies tie, and more than are wanted
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = V.VectorIndex.build(frame, path=str(tmp_path / "i"), cells=12)
    asked = spark.createDataFrame([*((i, v) for i, v in rows if i % 3 == 0), (2000, [0.0] * 8), (2001, None), (2002, [1.0])], "id long, embedding array<float>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 12)
    want = {i: sorted(range(900), key=lambda j: (-near[i, j], j))[:7] for i in range(0, 900, 3)}

    def found(k=7, **more):
        out = {}
        for r in sorted(index.nearest_join(asked, k, **more).collect(), key=lambda r: (-round(r.score, 12), r.id)):
            out.setdefault(r["query"], []).append(r.id)
        return out

    assert found() == want
    monkeypatch.setattr(V, "GROUP_ROWS", 30)
    monkeypatch.setattr(V, "BLOCK", 16)
    assert found(probes=1) == want
    assert all(len(v) == 900 for v in found(901).values())


def test_indexed_query_sends_no_queries_to_the_driver(spark, sf, monkeypatch):
    import __spark_entry__ as entry
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*args, **more):
        raise AssertionError("rows went through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    assert entry.queries()["knn_indexed"](spark, sf).count()
