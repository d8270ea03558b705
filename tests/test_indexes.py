"""Text and vector indexes: changes, merges, and searches that read a part."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memspan.engine import Engine
from memspan.operators import retrieval as R
from memspan.operators import textindex as T
from memspan.operators.vectorindex import Model, VectorIndex
from memspan.sources import schemas

WORDS = [f"w{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(200)]


def made_text(rnd):
    return " ".join(["common"] * rnd.randint(0, 3) + rnd.choices(WORDS, weights=[1 / (i + 1) for i in range(200)], k=rnd.randint(2, 15)))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    rows = [(i, made_text(rnd), made_text(rnd) if i % 7 else None) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, t string, u string").persist()


@pytest.fixture(scope="module")
def index(docs):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(T, "FREQUENT", 64)
        yield T.TextIndex.build(docs, "id", ["t", "u"], blocks=40)


def scored(df):
    return {r.id: round(r.score, 8) for r in df.collect()}


def best_of(df, limit):
    return [(r.id, round(r.score, 8)) for r in df.orderBy(F.desc("score"), "id").limit(limit).collect()]


@pytest.mark.parametrize("query", ["common", "common waa wjt", "wjs wjt", "nothing at all", ""])
def test_top_is_that_of_the_full_sum(spark, index, query):
    report = {}
    got = best_of(index.top("t", query, 10, read_all=0, report=report), 10)
    assert got == best_of(index.bm25("t", query), 10)
    assert got == best_of(index.top("t", query, 10), 10)
    scope = spark.range(0, 3000, 3)
    assert best_of(index.top("t", query, 10, scope, read_all=0), 10) == best_of(R.scoped(index.bm25("t", query), scope), 10)


def test_top_reads_a_part_of_a_frequent_term(index):
    rare = index.terms.where("field = 't'").orderBy("df", "term").head()["term"]
    report = {}
    index.top("t", f"common {rare}", 3, read_all=0, report=report).collect()
    assert report["postings"] > 2000 and report["read"] < report["postings"] / 2


def test_changes_are_small_segments_and_scores_those_of_a_whole_index(spark, docs, index):
    gone = docs.where("id % 300 = 0")
    back = docs.where("id % 600 = 0").withColumn("t", F.concat("t", F.lit(" fresh word")))
    new = back.unionByName(spark.createDataFrame([(9000, "brand new common", None)], docs.schema))
    changed = index.changed(gone, new)
    assert [s.number for s in changed.segments] == [1, 2] and changed.segments[1].size < 300 < index.segments[0].size
    whole = T.TextIndex.build(docs.where("id % 300 <> 0").unionByName(new), "id", ["t", "u"])
    for query in ("common", "fresh", "brand waa", "word common wab"):
        for field in ("t", "u"):
            want = scored(whole.bm25(field, query))
            assert scored(changed.bm25(field, query)) == want
            assert scored(changed.bm25(field, query, every=True)) == scored(whole.bm25(field, query, every=True))
        assert [s for _, s in best_of(changed.top("t", query, 5, read_all=0), 5)] == [s for _, s in best_of(whole.top("t", query, 5), 5)]
        assert {r.id for r in changed.matching(["t", "u"], query).collect()} == {r.id for r in whole.matching(["t", "u"], query).collect()}
    # The index before the change is as it was, and what was written can be opened.
    assert 0 in scored(index.bm25("t", docs.where("id = 0").head().t)) and scored(index.bm25("t", "fresh")) == {}
    again = T.TextIndex.open(spark, changed.path)
    assert again.segments == changed.segments and scored(again.bm25("t", "fresh common")) == scored(changed.bm25("t", "fresh common"))
    only = changed.changed(docs.where("id = 7"), None)
    assert 7 not in scored(only.bm25("t", docs.where("id = 7").head().t))


def test_segments_of_one_size_are_merged(spark, monkeypatch):
    monkeypatch.setattr(T, "FAN", 3)
    made = lambda lo, hi, word: spark.createDataFrame([(i, f"common {word} n{i}") for i in range(lo, hi)], "id long, t string")
    index = T.TextIndex.build(made(0, 4, "one"), "id", ["t"], blocks=2)
    assert T.Segment("a", 1, 1000).tier == T.Segment("a", 1, 5).tier < T.Segment("a", 1, 5000).tier
    index = index.changed(made(0, 1, "one"), made(0, 1, "two")).changed(None, made(4, 6, "three"))
    assert [s.number for s in index.segments] == [3] and not index.segments[0].hides
    whole = T.TextIndex.build(made(1, 4, "one").unionByName(made(0, 1, "two")).unionByName(made(4, 6, "three")), "id", ["t"], blocks=2)
    for query in ("common", "two", "one three"):
        assert scored(index.bm25("t", query)) == scored(whole.bm25("t", query))
    index.vacuum()
    assert scored(index.bm25("t", "one")) == scored(whole.bm25("t", "one"))
    assert T.TextIndex.open(spark, index.path).segments == index.segments


@pytest.mark.parametrize("slices", [1, 3])
def test_listwise_rerank_index_deals_postings_once(spark, docs, monkeypatch, slices):
    """Postings are not stored beside the index, nor looked at before they are dealt: what is counted is read from what was laid out."""
    stored, kept = [], T.written
    monkeypatch.setattr(T, "written", lambda df, path=None: stored.append(set(df.columns)) or kept(df, path))
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda *a: 1 / 0)
    monkeypatch.setattr(T, "FREQUENT", 64)
    monkeypatch.setattr(T, "SLICE_BLOCKS", -(-40 // slices), raising=False)
    monkeypatch.setattr(T, "BATCH_POSTINGS", 50, raising=False)
    made = T.TextIndex.build(docs, "id", ["t", "u"], blocks=40)
    assert stored == [{"field", "term", "df", "tf"}]
    got = {(r.field, r.term, r.id): (r.tf, r.dl) for r in made.postings.collect()}
    want = {(f, t, r.id): (T.terms(r[f]).count(t), len(T.terms(r[f]))) for r in docs.collect() for f in ("t", "u") if r[f] for t in T.terms(r[f])}
    assert got == want
    assert made.terms.where("field = 't' and term = 'common'").head()["df"] == sum(1 for f, t, _ in want if (f, t) == ("t", "common"))
    assert {(r.field, r.term) for r in made._read("maxima").collect()} == {(f, t) for f, t in {(f, t) for f, t, _ in want} if sum(1 for a, b, _ in want if (a, b) == (f, t)) >= 64}


def test_engine_goes_on_with_its_indexes(spark):
    row = "id long, project string, title string, content string, category string, strength double, is_latest boolean, retrieval_count long, created_s long"
    memory = schemas.conformed(spark.createDataFrame([(i, "p", f"title {i}", f"text of number {i}", "fact", 1.0, True, 0, 5) for i in range(4)], row), "memory").persist()
    engine = Engine.empty(spark, 10).after({"memory": memory})
    assert {r.id for r in engine.memories("text").collect()} == {0, 1, 2, 3}
    first = engine.index("memory")
    # Deleted, changed and added rows, told or found out.
    less = engine.after({k: v.persist() for k, v in engine.delete(spark.createDataFrame([(2,)], "id long")).items()})
    assert less.index("memory").segments[0] == first.segments[0] and len(less.index("memory").segments) == 2
    assert {r.id for r in less.memories("text").collect()} == {0, 1, 3}
    changed = memory.withColumn("content", F.when(F.col("id") == 1, "quite other words").otherwise(F.col("content")))
    assert {r.id for r in engine.after({"memory": changed}).memories("text number").collect()} == {0, 2, 3}
    assert engine.after(engine.bump(spark.createDataFrame([(1,)], "id long"))).index("memory") is first
    assert engine.after({"fact": engine["fact"]}).index("memory") is first


# Vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(30, 16)), 100, axis=0) + 0.4 * rng.normal(size=(3000, 16))
    rows = pd.DataFrame({"id": range(3000), "embedding": [v.astype("float32").tolist() for v in x], "project": [f"p{i % 3}" for i in range(3000)]})
    return spark.createDataFrame(rows, "id long, embedding array<float>, project string").persist()


@pytest.fixture(scope="module")
def cells(vectors):
    return VectorIndex.build(vectors, keep=["project"], cells=24).tuned()


def test_recall_is_measured_and_reached(cells):
    assert cells.recall >= 0.95 and cells.probes < 24
    assert cells.audit(k=20, probes=1) <= cells.recall


def test_exact_search_is_that_of_the_scan(spark, vectors, cells):
    some = [list(r.embedding) for r in vectors.where("id % 971 = 5").collect()]
    for query in (*some, [1.0] + [0.0] * 15):
        assert best_of(cells.search(query, 15, exact=True, probes=2), 15) == best_of(R.nearest(vectors, query, 15, "id"), 15)
    mine = vectors.where("project = 'p1'")
    assert best_of(cells.search(some[0], 15, exact=True, where=F.col("project") == "p1"), 15) == best_of(R.nearest(mine, some[0], 15, "id"), 15)
    few = vectors.where("id % 100 = 1").select("id")
    assert best_of(cells.search(some[0], 15, exact=True, scope=few), 15) == best_of(R.nearest(vectors.join(few, "id", "left_semi"), some[0], 15, "id"), 15)


def test_a_search_reads_the_probed_cells_alone(vectors, cells):
    query = list(vectors.head().embedding)
    plan = cells.search(query, 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    cut = re.findall(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(([\d,]+)\)|PartitionFilters: \[[^\]]*cell#\d+ = (\d+)", plan)
    assert cut and all(len((a or b).split(",")) <= 2 for a, b in cut)
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(cells.live(["v"], [3])) < files(cells.live(["v"])) / 4
    coded = [x for x in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "code" in x]
    assert coded and all("v:array" not in x for x in coded)


def test_added_and_deleted_vectors(spark, vectors, cells):
    query = list(vectors.where("id = 10").head().embedding)
    gone = vectors.where("id in (10, 11)")
    new = gone.where("id = 11").withColumn("embedding", F.lit(query).cast("array<float>")).unionByName(spark.createDataFrame([(7000, query, "p0"), (7001, None, "p0"), (7002, [0.0] * 16, "p0"), (7003, [1.0], "p0"), (7004, [float("nan")] * 16, "p0")], vectors.schema))
    index = cells.changed(gone, new)
    found = best_of(index.search(query, 3, exact=True), 3)
    assert [i for i, s in found if s > 0.999999] == [11, 7000] and 10 not in dict(found)
    assert 10 in dict(best_of(cells.search(query, 3, exact=True), 3)) or cells.generation == index.generation
    whole = vectors.where("id not in (10, 11)").unionByName(new.where("size(embedding) = 16 and id <= 7000"))
    assert best_of(index.search(query, 20, exact=True), 20) == best_of(R.nearest(whole, query, 20, "id"), 20)
    compact = index.compact()
    assert compact.live([]).count() == 3000 and best_of(compact.search(query, 20, exact=True), 20) == best_of(index.search(query, 20, exact=True), 20)
    opened = VectorIndex.open(spark, index.path, index.kinds, index.keep)
    assert opened.generation == index.generation and best_of(opened.search(query, 5, exact=True), 5) == best_of(index.search(query, 5, exact=True), 5)


def test_an_index_of_nothing(spark, vectors):
    none = VectorIndex.build(vectors.limit(0), keep=["project"])
    assert none.search([1.0] * 16, 5).count() == 0 and none.tuned().recall == 1.0
    grown = none.changed(None, vectors.where("id < 50"))
    assert best_of(grown.search([1.0] * 16, 5, exact=True), 5) == best_of(R.nearest(vectors.where("id < 50"), [1.0] * 16, 5, "id"), 5)
    with pytest.raises(ValueError, match="at most"):
        grown.search_block([[1.0] * 16] * 300, 5)


def test_codes_bound_cosines():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = Model.fit(x[:300], 6)
    cell, code, err, far = model.coded(x)
    for q in x[:20]:
        products, table = model.asked(q)
        told = products[cell] + table[np.arange(code.shape[1]), code].sum(axis=1)
        assert np.all(np.abs(told - x @ q) <= err) and np.all(x @ q <= products[cell] + far)


def test_remember_uses_the_index(spark):
    engine = Engine.empty(spark, 10)
    kind = "id long, project string, category string, title string, content string, keywords array<string>, files array<string>, session_id long"
    told = ["parsers keep spans of tokens", "databases store rows in pages", "violins sound in the hall", "glaciers melt in summer"]
    rows = lambda lo, hi: spark.createDataFrame([(i, "p", "fact", told[i % 4], f"{told[i % 4]} number {i}", [], [], None) for i in range(lo, hi)], kind)
    engine = engine.after({k: v.persist() for k, v in engine.remember(rows(0, 24)).items()})
    index = engine.vectors("memory")
    assert index.recall >= 0.95
    plain = Engine(spark, engine.tables, 10)
    pairs = lambda e: {(r.src, r.dst): round(r.edge_score, 5) for r in e.remember(rows(24, 28))["edge"].where("via = 'embedding'").collect()}
    assert pairs(engine) == pairs(plain)
    after = engine.after(engine.remember(rows(24, 28)))
    assert after._vectors["memory"].generation == 1 and after._vectors["memory"].live([]).count() == 28
    hits = after.search(f"{told[0]} number 24", "semantic") if "embedding" in after["observation"].columns else None
    assert hits is not None and hits.count() == 0
    assert best_of(after._near("memory", list(after.get("memory", 24).head().embedding), 3), 1)[0][0] == 24
