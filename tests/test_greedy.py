"""Greedy clusters in rounds, and joins of sets by counted meetings, against sequential and brute-force ways."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspan.operators import graph, maintain


def sequential(pairs, smallest):
    near, taken, out = {}, set(), set()
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    for seed in sorted(near):
        group = [seed, *(p for p in near[seed] if p not in taken)]
        if seed not in taken and len(group) >= smallest:
            taken.update(group)
            out |= {(seed, p) for p in group}
    return out


@pytest.mark.parametrize("kind", ["sparse", "dense", "path", "star"])
def test_rounds_give_the_sequential_clusters(spark, kind):
    rng = np.random.default_rng(3)
    drawn = {"sparse": lambda: rng.integers(0, 200, (260, 2)), "dense": lambda: rng.integers(0, 40, (400, 2)), "path": lambda: np.stack([np.arange(12), np.arange(12) + 1], 1), "star": lambda: np.stack([np.full(30, 15), np.arange(30)], 1)}[kind]()
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in drawn if a != b})
    df = spark.createDataFrame(pairs, "src long, dst long")
    for smallest in (2, 3):
        want = sequential(pairs, smallest)
        assert {tuple(r) for r in maintain.in_one_task(df, smallest).collect()} == want
        assert {tuple(r) for r in maintain.in_rounds(df, smallest).collect()} == want
    assert maintain.in_rounds(df.limit(0), 3).count() == 0


def test_clusters_of_all_memories(spark):
    rows = [(i, 1000 - i // 3, [f"a{i % 5}", f"b{i % 5}", f"c{i % 4}"]) for i in range(160)]
    memory = spark.createDataFrame(rows, "id long, created_s long, keywords array<string>")
    few = {tuple(r) for r in maintain.clusters(memory, newest=None, least=0.5).collect()}
    assert few and few == {tuple(r) for r in maintain.clusters(memory, newest=None, least=0.5, task_pairs=0).collect()}
    assert len({c for _, c in few}) == len(few) and max(i for _, i in few) > 100
    assert {tuple(r) for r in maintain.clusters(memory, newest=30, least=0.5, task_pairs=0).collect()} == {tuple(r) for r in maintain.clusters(memory, newest=30, least=0.5).collect()}
    numbers = maintain.numbered(memory.repartition(7), [F.desc("created_s"), F.col("id")], "n").orderBy(F.desc("created_s"), "id").collect()
    assert [r.n for r in numbers] == list(range(1, 161))


def brute(rows, least):
    return {(a, b, round(len(x & y) / len(x | y), 6)) for a, s, x in rows for b, t, y in rows if a < b and s == t and x & y and len(x & y) >= least * len(x | y)}


@pytest.mark.parametrize("grid", [4, 1000])
def test_sets_join_on_a_token_that_all_hold(spark, grid):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, {"hot", *(f"t{int(x)}" for x in rng.integers(0, 30, int(rng.integers(0, 6))))} if i % 9 else set()) for i in range(120)]
    items = spark.createDataFrame([(i, s, [*sorted(x), None]) for i, s, x in rows], "id long, s long, k array<string>")
    for least in (0.0, 0.4, 0.75, 1.0):
        found = graph.shared_tokens(items, "k", least, "s", grid_rows=grid)
        got = [(r.src, r.dst, round(r.jaccard, 6)) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, least)
    capped = {(r.src, r.dst) for r in graph.shared_tokens(items, "k", 0.0, "s", most_df=20, grid_rows=grid).collect()}
    df = {(s, t): sum(s == z and t in x for _, z, x in rows) for _, s, y in rows for t in y}
    assert capped == {(a, b) for a, s, x in rows for b, t, y in rows if a < b and s == t and any(df[s, w] <= 20 for w in x & y)}


def test_each_pair_of_a_token_meets_once(spark):
    rows = spark.createDataFrame([(i, 0, "t", 1, 0) for i in range(50)], "id long, scope int, token string, size int, pos int")
    met = graph.meetings(rows, 7).groupBy("src", "dst").count().collect()
    assert len(met) == 50 * 49 // 2 and {r["count"] for r in met} == {1}
    plan = graph.meetings(rows, 7)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", plan)


def test_new_rows_meet_stored_ones(spark):
    stored = spark.createDataFrame([(1, "p", ["a", "b"]), (2, "p", ["c"]), (3, "q", ["a"])], "id long, s string, k array<string>")
    new = spark.createDataFrame([(10, "p", ["a", "c", "d"]), (11, "p", ["d"])], "id long, s string, k array<string>")
    got = {(r.src, r.dst): round(r.jaccard, 4) for r in graph.tokens_shared_with(new, stored, "k", "s").collect()}
    assert got == {(10, 1): 0.25, (10, 2): 0.3333, (10, 11): 0.3333}
