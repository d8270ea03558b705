"""Results that an expansion or a rerank uses several times are found once."""

from pyspark.sql import functions as F

from memspan.operators import retrieval

SCHEMA = "id string, session_id string, title string, obs_type string, importance int, score double"
MEMORY = "id long, title string, content string, category string, strength double, retrieval_count long, created_s long, is_latest boolean"


def frames(spark):
    told = F.udf(lambda x: x, "double")
    results = spark.createDataFrame([(f"memory:{i}", None, "t", "memory:fact", 5, i / 10) for i in range(1, 4)], SCHEMA).withColumn("score", told("score"))
    memory = spark.createDataFrame([(i, f"t{i}", "c", "fact", 0.5, 1, 1000, True) for i in range(1, 9)], MEMORY)
    return results, memory


def searched(df):
    return "EvalPython" in df._jdf.queryExecution().executedPlan().toString()


def test_graph_expand_search_finds_its_seeds_once(spark):
    results, memory = frames(spark)
    edges = spark.createDataFrame([(1, 7, "similar_to", "keyword", 0.9), (3, 2, "elaborates", "keyword", 0.9)], "src long, dst long, relation string, via string, edge_score double")
    made = retrieval.expand(results, edges, memory, 1000)
    assert searched(results) and not searched(made)
    assert sorted(r.id for r in made.collect()) == ["memory:1", "memory:2", "memory:3", "memory:7"]


def test_listwise_rerank_finds_its_rows_once(spark):
    results, memory = frames(spark)
    made = retrieval.listwise(results, memory, "q", lambda prompt: '{"order": [2, 1, 0]}')
    assert searched(results) and not searched(made)
    assert [r.id for r in made.orderBy(F.desc("score")).collect()] == ["memory:1", "memory:2", "memory:3"]
