"""Every query against its SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import same
from memspan.operators import graph
from memspan.plans import catalogue

ORACLE = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf, duck, name):
    same(catalogue.queries()[name](spark, sf).toPandas(), duck.sql(ORACLE[name]).df())


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables_are_joined(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 10_000)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/events.parquet").withColumn("event_id", F.col("event_id") + 5_000).write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{sf}/conversations.parquet").write.parquet(f"{tmp_path}/conversations.parquet")
    made = catalogue.queries()
    sets = {r.doc_id: {f"n{r.doc_id % 50}", f"q{r.doc_id % 7}", r.lang} for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b])}
    assert any(b >= 10_000 for _, b, _ in want)
    got = made["keyword_jaccard_edges"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    points = made["open_run_asof"](spark, str(tmp_path))
    assert points.count() == spark.read.parquet(f"{tmp_path}/events.parquet").count() and points.agg(F.min("id")).head()[0] >= 5_000


def test_alike_tokens_of_sets_of_any_size(spark):
    rng = np.random.default_rng(2)
    rows = [(i, sorted({"hot", *(f"t{x}" for x in rng.integers(0, 12, int(rng.integers(0, 5))))} - ({"hot"} if i % 5 == 0 else set()))) for i in range(150)]
    items = spark.createDataFrame(rows, "id long, k array<string>")
    for least in (0.2, 0.4, 0.5, 1.0):
        want = {(a, b, len({*x} & {*y}) / len({*x} | {*y})) for a, x in rows for b, y in rows if a < b and (x or y) and len({*x} & {*y}) / len({*x} | {*y}) >= least}
        assert {tuple(r) for r in graph.shared_tokens(items, "k", least).collect()} == want
