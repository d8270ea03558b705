"""Hybrid search ranks vectors and expands along edges, and every neighbour of a memory hit counts."""

from pyspark.sql import functions as F

from memspan.operators import retrieval as R
from memspan.plans import catalogue
from memspan.plans.lens import Lens

RESULTS = "id string, session_id string, title string, obs_type string, importance int, score double"
EDGES = "src long, dst long, relation string, via string, edge_score double"


def memory(spark, n):
    return spark.range(1, n + 1).select("id", F.lit("t").alias("title"), F.lit("c").alias("content"), F.lit("fact").alias("category"), F.lit(0.5).alias("strength"), F.lit(1).cast("long").alias("retrieval_count"), F.lit(1000).cast("long").alias("created_s"), F.lit(True).alias("is_latest"))


def test_a_neighbour_may_have_the_number_of_another_tables_hit(spark):
    results = spark.createDataFrame([("memory:1", None, "t", "memory:fact", 5, 0.9), ("observation:7", "3", "t", "error", 5, 0.8), ("run:8", "3", "t", "run:task:success", 5, 0.7)], RESULTS)
    edges = spark.createDataFrame([(1, 7, "similar_to", "keyword", 0.9), (1, 8, "elaborates", "keyword", 0.9), (7, 6, "similar_to", "keyword", 0.9)], EDGES)
    assert sorted(r.id for r in R.expand(results, edges, memory(spark, 9), 1000).collect()) == ["memory:1", "memory:7", "memory:8", "observation:7", "run:8"]


def test_every_memory_hit_is_expanded(spark):
    results = spark.createDataFrame([(f"memory:{i}", None, "t", "memory:fact", 5, 1 / i) for i in range(1, 151)], RESULTS)
    edges = spark.createDataFrame([(i, i + 200, "similar_to", "keyword", 0.9) for i in range(1, 151)], EDGES)
    assert R.expand(results, edges, memory(spark, 400), 1000).count() == 300


def test_search_hybrid_ranks_vectors_and_expands(spark, sf, monkeypatch):
    given, search = {}, R.search_hybrid
    monkeypatch.setattr(R, "search_hybrid", lambda *args, **more: given.update(more) or search(*args, **more))
    made = catalogue.queries()["search_hybrid"](spark, sf)
    assert made.count() > 0
    t = Lens(spark, sf)
    for name, rows in (("obs_vectors", t.observation), ("memory_vectors", t.memory.where("is_latest"))):
        assert given[name].count() == 20 == given[name].join(rows, "id", "left_semi").count()
    assert given["edges"].count() == t.edge.count()


def test_search_hybrid_finds_neighbours(spark, sf, monkeypatch):
    expand = R.expand
    # Edges so good that neighbours come first.
    monkeypatch.setattr(R, "expand", lambda results, edges, *more: expand(results, edges.withColumn("edge_score", F.lit(1000.0)), *more))
    found = catalogue.queries()["search_hybrid"](spark, sf).collect()
    assert len(found) <= 20 and {r.id: r.obs_type for r in found}["memory:50"].endswith("@elaborates:embedding")
