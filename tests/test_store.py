"""The store writes what changes alone, all of a step or nothing; streams into it; SQL functions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from memspan.functions import registered, scores
from memspan.operators import graph, lifecycle
from memspan.operators import retrieval as R
from memspan.sources import schemas
from memspan.sources.store import BUCKETS, Commit, Store, bucket_of
from memspan.streaming import ingest
from test_ingest import EVENT, EVENTS, NOW

EDGE = schemas.SCHEMAS["edge"]


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def files_of(df):
    return {f for f in df.inputFiles()}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(f"memory:{i}", f"memory:{i * 7 % 50}", "similar_to", "keyword", i / 100, i) for i in range(100)], EDGE).persist()


def upserted(old, new):
    return graph.upsert(old.unionByName(new))


def test_a_write_reads_the_buckets_of_its_keys(spark, edges, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.save({"edge": edges})
    assert rows_of(store.read("edge")) == rows_of(edges)
    new = spark.createDataFrame([("memory:3", "memory:21", "similar_to", "keyword", 0.9, 1000)], EDGE)
    (bucket,) = store.touched("edge", new)
    assert len(files_of(store.read("edge", [bucket]))) < len(files_of(store.read("edge"))) / 4
    before = {v for t, b, v in store.live if t == "edge" and b != bucket}
    for _ in range(2):  # a repeated write changes nothing
        change = Commit()
        assert store.merge(change, "edge", new, upserted) == {bucket}
        store.commit(change)
        assert rows_of(store.read("edge")) == rows_of(upserted(edges, new))
    assert {v for t, b, v in store.live if t == "edge" and b != bucket} == before
    again = Store(spark, f"{tmp_path}/s")
    assert again.live == store.live and rows_of(again.read("edge")) == rows_of(store.read("edge"))
    store.vacuum()
    assert rows_of(Store(spark, f"{tmp_path}/s").read("edge")) == rows_of(upserted(edges, new))


def test_counts_and_marks_are_merged(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", buckets=4)
    told = [("file", f"f{i}", "p", 1, i, i) for i in range(20)]
    known = spark.createDataFrame(told, schemas.SCHEMAS["entity"])
    memory = schemas.conformed(spark.createDataFrame([(i, 0) for i in range(20)], "id long, retrieval_count long"), "memory")
    store.save({"entity": known, "memory": memory})
    fresh = spark.createDataFrame([("file", "f3", "p", 2, 1, 99), ("file", "new", "p", 1, 5, 5)], schemas.SCHEMAS["entity"])
    hits = spark.createDataFrame([(4,), (5,)], "id long")
    change = Commit()
    store.merge(change, "entity", fresh, lifecycle.entities_merged)
    store.merge(change, "memory", hits, lambda old, new: R.bump(old, new, 7))
    assert store.read("entity").where("name = 'new'").count() == 0  # not before the commit
    store.commit(change, "jobs", 3)
    assert rows_of(store.read("entity")) == rows_of(lifecycle.entities_merged(known, fresh))
    assert {r.id for r in store.read("memory").where("retrieval_count = 1 and last_s = 7").collect()} == {4, 5} and store.read("memory").count() == 20
    assert store.done("jobs", 3) and store.done("jobs", 2) and not store.done("jobs", 4) and not store.done("others", 0)


def test_writers_do_not_overwrite_each_other(spark, edges, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.save({"edge": edges})
    other = Store(spark, f"{tmp_path}/s")
    store.save({"edge": edges.limit(3)})
    with pytest.raises(RuntimeError, match="another writer"):
        other.save({"edge": edges.limit(5)})
    assert Store(spark, f"{tmp_path}/s").read("edge").count() == 3
    store.save({"edge": edges.limit(0)})
    assert store.read("edge").count() == 0


def test_buckets_of_many_versions_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("memspan.sources.store.MOST_VERSIONS", 2)
    store = Store(spark, f"{tmp_path}/s")
    for i in range(5):
        change = Commit()
        store.append(change, "summary", schemas.conformed(spark.createDataFrame([(i, "t")], "id long, title string"), "summary"))
        store.commit(change)
    assert store.read("summary").count() == 5 and len(store.live) <= 3


def test_buckets_are_those_of_days_and_keys(spark):
    rows = spark.createDataFrame([(0, 86_400_000_000), (1, 86_399_999_999), (2, None)], "id long, ts_us long")
    assert [r.b for r in rows.orderBy("id").select(bucket_of("seen").alias("b")).collect()] == [1, 0, -1]
    assert rows.select(bucket_of("memory").alias("b")).where(f"b < 0 or b >= {BUCKETS}").count() == 0
    assert rows.select(bucket_of("plan").alias("b")).distinct().count() == 1


# Streams


def seeded(spark, path):
    store = Store(spark, path, buckets=4)
    memory = spark.createDataFrame([(1, "p", ["src/z.rs"], 0.5, True)], "id long, project string, files array<string>, strength double, is_latest boolean")
    store.save({"memory": schemas.conformed(memory, "memory")})
    return store


TOLD = ("observation", "run", "session", "commits", "summary", "dedup", "memory", "edge", "seen")


def test_a_stream_gives_what_one_batch_gives(spark, tmp_path):
    once = seeded(spark, f"{tmp_path}/once")
    ingest.take_in(once, spark.createDataFrame(EVENTS, EVENT), NOW)
    want = {name: rows_of(once.read(name)) for name in TOLD}

    source = f"{tmp_path}/events"
    parts = [EVENTS[:5], EVENTS[4:10], EVENTS[10:]]
    store = seeded(spark, f"{tmp_path}/stream")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(EVENT).json(source)
        query = ingest.ingest(stream, store, f"{tmp_path}/checkpoint", lambda: NOW, available_now=True)
        query.awaitTermination()
        assert query.exception() is None and store.done(ingest.SOURCE, i)
    assert {name: rows_of(store.read(name)) for name in TOLD} == want
    # A batch that was committed is skipped, whatever it holds, and ids are known without a number.
    ingest.take_in(store, spark.createDataFrame([(77, 9, "p", NOW * 1_000_000, "Stop", "{}")], EVENT), NOW, batch=1)
    ingest.take_in(store, spark.createDataFrame(EVENTS[3:9], EVENT), NOW)
    assert {name: rows_of(store.read(name)) for name in TOLD} == want


# SQL functions


def test_functions_in_sql(spark):
    registered.register(spark)
    told = spark.sql("select cosine_sim(array(1D, 0D), array(1D, 1D)) as c, jaccard(array('a', 'b'), array('b')) as j, jaccard(array(), array()) as n, recency_boost(2D, 30D, 25) as r, strengthened(0.9D) as s, token_estimate('ä23456789') as t").head()
    plain = spark.range(1).select(scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), scores.recency_access(F.lit(2.0), F.lit(30.0), F.lit(25)).alias("r")).head()
    assert (told.c, told.r) == (pytest.approx(plain.c), pytest.approx(plain.r)) and (told.j, told.n, told.s, told.t) == (0.5, 0.0, 1.0, 2)
    plan = spark.range(5).selectExpr("jaccard(array(cast(id as string)), array('3')) as j", "recency_boost(1D, cast(id as double), id) as r")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|UDF", plan)


def test_table_functions_in_sql(spark):
    registered.register(spark)
    spark.createDataFrame([(1, '<fact confidence="0.9"> A </fact><fact confidence="x">B</fact><fact confidence="1"> </fact>'), (2, None), (3, '<procedure name="n" trigger="t"><step>one</step><step> two </step></procedure>')], "id long, reply string").createOrReplaceTempView("replies_told")
    facts = spark.sql("select id, f.* from replies_told, lateral reply_facts(reply) f").collect()
    assert sorted(map(tuple, facts)) == [(1, "A", 0.9), (1, "B", 0.5)]
    steps = spark.sql("select id, s.* from replies_told, lateral reply_steps(reply) s").collect()
    assert sorted(map(tuple, steps)) == [(3, "n", "t", 0, "one"), (3, "n", "t", 1, "two")]
    assert json.dumps([]) == "[]"
