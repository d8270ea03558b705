"""The adjacency store against searches over all edges."""

import random

import pytest
from pyspark.sql import functions as F

from memspan.engine import Engine
from memspan.operators import graph
from memspan.operators.adjacency import Adjacency
from memspan.sources import schemas

COLUMNS = "src string, dst string, relation string, via string, edge_score double, created_s long"


def made_edges(spark, seed, nodes=60, hub=400):
    """A random graph with many ties and a node that a third of the edges touch."""
    rnd = random.Random(seed)
    rows = [(f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}", rnd.choice("ab"), rnd.choice(["x", None]), rnd.randrange(4) / 4, rnd.randrange(9)) for _ in range(300)]
    rows += [("hub", f"m{i}", rnd.choice("ab"), "x", rnd.choice([0.25, 0.5, 0.5, 1.0]), 1) for i in range(hub)]
    rows += [(f"n{i}", "hub", "a", "x", 0.5, 2) for i in range(9)] + [("n1", "hub", "b", None, 0.5, 2), ("n1", "n2", "a", "x", None, 1), (None, "n1", "a", "x", 1.0, 1)]
    return spark.createDataFrame(rows, COLUMNS).persist()


@pytest.fixture(scope="module")
def edges(spark):
    return made_edges(spark, 1)


@pytest.fixture(scope="module")
def store(edges):
    return Adjacency.build(edges, buckets=8, level=4)


def known(edges):
    """The edges that a search can follow; others have no place in the store."""
    return edges.where("src is not null and dst is not null and edge_score is not null")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.mark.parametrize("direction", ["out", "in", "both"])
@pytest.mark.parametrize("limit", [None, 1, 7, 100])
def test_expand_is_that_of_all_edges(spark, edges, store, direction, limit):
    for seeds, hops, relations, least in ((ids(spark, "n1", "n2"), 2, None, 0.0), (ids(spark, "hub"), 2, ["b"], 0.5), (ids(spark, "gone"), 1, None, 0.0)):
        want = graph.expand(known(edges), seeds, hops, relations, least, direction, limit)
        assert rows_of(store.expand(seeds, hops, relations, least, direction, limit)) == rows_of(want)


def test_levels_hold_the_best_entries_first(store):
    rows = store._all().where("node = 'hub' and outward").orderBy(F.desc("edge_score"), "other", "relation", "via").collect()
    assert len(rows) == 400 and {r["n"] for r in rows} == {400}
    assert [r["level"] for r in rows] == [0] * 4 + [1] * 28 + [2] * 224 + [3] * 144
    assert store._all().where("node in ('m1', 'gone') and level > 0").isEmpty()


def test_growth_counts_best_scores(spark, edges):
    more = spark.createDataFrame([("hub", "m7", "a", "x", 0.99, 5), ("n1", "new", "a", None, 0.7, 5), ("hub", "m8", "b", "x", 0.1, 0)], COLUMNS)
    whole = graph.upsert(known(edges).unionByName(more))
    grown = Adjacency.build(edges, buckets=8, level=4).grown(more)
    assert len(grown.paths) == 2 and rows_of(grown.edges()) == rows_of(whole)
    for limit in (None, 5):
        assert rows_of(grown.expand(ids(spark, "hub", "n1"), 2, max_results=limit)) == rows_of(graph.expand(whole, ids(spark, "hub", "n1"), 2, max_results=limit))
    for _ in range(7):
        grown = grown.grown(more)
    assert len(grown.paths) == 1 and rows_of(grown.edges()) == rows_of(whole)


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_fetched_edges_are_told_once(spark, edges, store, direction):
    some = ids(spark, "n1", "n2", "n3", "hub")
    want = graph.upsert(graph.fetched(known(edges), some, direction, ["a"], 0.25))
    assert rows_of(store.fetched(some, direction, ["a"], 0.25)) == rows_of(want)


def files_read(df):
    """Files that a plan opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, files = [plan], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        found = node.metrics().get("numFiles")
        files += found.get().value() if found.isDefined() else 0
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return files


def test_a_hop_opens_the_buckets_of_its_frontier(spark, store):
    one = store.entries(ids(spark, "hub"), level=0)
    assert files_read(one) == 1 and one.count() == 4
    assert files_read(store._all()) > 8
    told = one._jdf.queryExecution().toString()
    assert "PushedFilters: [" in told and "EqualTo(node,hub)" in told.replace(" ", "") or "In(node,[hub])" in told.replace(" ", "")


def test_many_nodes_are_joined(spark, edges, store):
    many = spark.range(600).select(F.concat(F.lit("m"), "id").alias("id"))
    assert store.entries(many, "in").count() == 400
    assert rows_of(store.expand(many, 1, direction="in")) == rows_of(graph.expand(known(edges), many, 1, direction="in"))


def test_a_search_from_a_hub_reads_what_it_returns(spark):
    """Of 200,000 edges of a node a search for 100 reads the best 1024, ties and all."""
    edges = spark.range(200_000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("r").alias("relation"), (F.col("id") % 3 / 2).alias("edge_score"))
    store = Adjacency.build(edges, buckets=4)
    asked = []
    whole = store.entries
    store.entries = lambda found, direction, level: asked.append(whole(found, direction, level).count()) or whole(found, direction, level)
    got = store.expand(spark.createDataFrame([(-1,)], "id long"), 2, max_results=100)
    assert [r["node"] for r in got.orderBy("node").collect()] == [2 + 3 * i for i in range(100)]
    assert asked == [1024]


def test_empty_edges(spark, edges):
    store = Adjacency.build(edges.limit(0), buckets=4)
    assert store.expand(ids(spark, "n1"), 2, max_results=3).isEmpty() and store.fetched(ids(spark, "n1")).isEmpty()
    assert rows_of(store.grown(edges).expand(ids(spark, "n1"), 1)) == rows_of(graph.expand(known(edges), ids(spark, "n1"), 1))


def test_engine_traces_by_its_store(spark):
    told = [("memory:1", "run:2", "generated_by", "x", 0.5, 1), ("run:2", "session:3", "part_of", "x", 1.0, 1)]
    edge = schemas.conformed(spark.createDataFrame(told, COLUMNS), "edge")
    first = Engine.empty(spark, 100)
    engine = first.after({"edge": edge})
    want = rows_of(engine.trace("memory:1"))
    assert engine.adjacency() is engine.adjacency() and rows_of(engine.trace("memory:1")) == want
    more = schemas.conformed(spark.createDataFrame([("session:3", "run:9", "has", "x", 0.5, 1)], COLUMNS), "edge")
    later = engine.after(engine._grown({"edge": more}))
    assert len(later.adjacency().paths) == 2
    assert {r["node"] for r in later.trace("run:2").collect()} == {"run:2", "memory:1", "session:3", "run:9"}
    assert len(later.after({"edge": edge}).adjacency().paths) == 1
