"""Ingest takes each event once, however events are split or repeated; dedup by a time to live."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspan.engine import Engine
from memspan.operators import lifecycle, models
from memspan.sources import schemas

NOW = 1_717_200_000
EVENT = "id long, session_id long, project string, ts_us long, hook string, data string"


# Dedup


def brute_kept(rows, ttl):
    """Greedy, one event after the other; events without time stay."""
    last, kept = {}, {i for _, t, i in rows if t is None}
    for k, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= ttl:
            last[k] = t
            kept.add(i)
    return kept


def kept_of(spark, rows, ttl, **more):
    events = spark.createDataFrame([(*r, "x") for r in rows], "key string, ts_us long, id long, _part string")
    found = lifecycle.ttl_dedup(events, "key", "ts_us", "id", ttl, **more)
    assert found.columns == events.columns
    return {r.id for r in found.collect()}


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_ttl_dedup_of_gapless_and_odd_keys(spark, chunk):
    rng = np.random.default_rng(8)
    hot = np.cumsum(rng.integers(0, 60, 900))  # no stretch of 100 without an event
    rows = [("hot", int(t), i) for i, t in enumerate(hot)]
    rows += [(f"k{int(k)}", int(t), 1000 + i) for i, (k, t) in enumerate(zip(rng.integers(0, 20, 300), rng.integers(-3000, 30_000, 300), strict=True))]
    rows += [(None, 5, 2000), ("", 5, 2001), (None, 50, 2002), ("", 250, 2003), ("hot", None, 2004), (None, None, 2005), ("same", 7, 2007), ("same", 7, 2006), ("edge", 0, 2008), ("edge", 100, 2009), ("edge", 99, 2010)]
    assert kept_of(spark, rows, 100, chunk_rows=chunk) == brute_kept(rows, 100)
    assert kept_of(spark, [], 100, chunk_rows=chunk) == set()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=80), st.integers(1, 12))
def test_ways_join_to_the_greedy_path(times, size):
    """Chunks of whole stretches: what enters each is what a sequential pass brings there."""
    ttl, times = 20, sorted(times)
    chunks, taken = {}, 0
    for stretch in sorted({t // ttl for t in times}):
        some = [t for t in times if t // ttl == stretch]
        chunks.setdefault(taken // size, []).extend(some)
        taken += len(some)
    ways = pd.concat([lifecycle._ways_through(ttl)(pd.DataFrame({"_key": "k", "_part": 1, "_chunk": c, "_t": some})) for c, some in chunks.items()])
    found = lifecycle._entries(ttl)(ways)
    got = dict(zip(found["_chunk"], found["_least"], strict=True))
    bound = None
    for c, some in chunks.items():
        assert (None if pd.isna(got[c]) else int(got[c])) == bound
        for t in some:
            if bound is None or t >= bound:
                bound = t + ttl


def test_ttl_dedup_goes_on(spark):
    rows = [("a", 0, 1), ("a", 90, 2), ("a", 130, 3), ("b", 10, 4), ("a", 240, 5), (None, 3, 6), (None, 104, 7), ("b", 500, 8)]
    last = spark.createDataFrame([], schemas.SCHEMAS["dedup"])
    kept = set()
    for some in (rows[:2], rows[2:5], rows[5:]):
        events = spark.createDataFrame(some, "key string, ts_us long, id long")
        found = lifecycle.ttl_dedup(events, "key", "ts_us", "id", 100, last=last).persist()
        kept |= {r.id for r in found.collect()}
        last = spark.createDataFrame(lifecycle.last_kept(found, "key", "ts_us", last).collect(), schemas.SCHEMAS["dedup"])
    assert kept == brute_kept(rows, 100)
    assert {tuple(r) for r in last.collect()} == {("a", 240), ("b", 500), (None, 104)}
    # Events that come late: within the window of what was kept they are repeats, else they count among themselves.
    late = [("a", 141, 11), ("a", 140, 12), ("a", 30, 13), ("a", 50, 14), ("b", 499, 15), ("c", 1, 16)]
    events = spark.createDataFrame(late, "key string, ts_us long, id long")
    assert {r.id for r in lifecycle.ttl_dedup(events, "key", "ts_us", "id", 100, last=last).collect()} == {12, 13, 16}


def test_no_task_holds_a_hot_key(spark):
    events = spark.range(4000).select(F.lit("k").alias("key"), (F.col("id") * 7).alias("ts_us"), "id")
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        kept = lifecycle.ttl_dedup(events, "key", "ts_us", "id", 100, chunk_rows=200).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(coalesced)
    assert {r.id for r in kept} == brute_kept([("k", i * 7, i) for i in range(4000)], 100)
    assert len({r.p for r in kept}) > 1


# Ingest


def event(i, session, second, hook, **data):
    return (i, session, "p", (NOW + second) * 1_000_000, hook, json.dumps(data))


EDIT = {"tool_name": "Edit", "tool_input": {"file_path": "/a/src/a.rs"}}
READ = {"tool_name": "Read", "tool_input": {"file_path": "/a/src/b.rs"}}
COMMIT = {"tool_name": "Bash", "tool_input": {"command": "git commit -m x"}, "tool_output": "[main abcdef12] Fix it"}
EVENTS = [
    event(1, 1, 0, "prompt_submit", prompt="fix it"),
    event(2, 1, 10, "post_tool_use", **EDIT),
    event(3, 1, 20, "post_tool_use", **EDIT),
    event(4, 1, 30, "post_tool_use", **READ),
    event(5, 1, 40, "post_tool_use", **COMMIT),
    event(6, 2, 45, "prompt_submit", prompt="more"),
    event(7, 2, 50, "post_tool_use", **{**EDIT, "tool_input": {"file_path": "src/z.rs"}}),
    event(8, 1, 320, "post_tool_use", **EDIT),
    event(9, 1, 330, "task_completed"),
    event(10, 2, 400, "Stop"),
    event(11, 2, 410, "prompt_submit", prompt="again"),
    event(12, 2, 1000, "post_tool_use", **READ),
    (13, 3, "p", None, "notification", "{}"),
]
TABLES = ("observation", "run", "session", "commits", "summary", "seen", "dedup", "memory", "edge")


@pytest.fixture(scope="module")
def store(spark):
    memory = spark.createDataFrame([(1, "p", "t", ["src/z.rs"], 0.5, True), (2, "p", "u", ["other"], 0.5, True)], "id long, project string, title string, files array<string>, strength double, is_latest boolean")
    return Engine.empty(spark, NOW).after({"memory": schemas.conformed(memory, "memory").persist()})


def taken_in(engine, batches):
    for rows in batches:
        events = engine.spark.createDataFrame(rows, EVENT)
        changes = engine.observe(events)
        engine = engine.after({name: engine.spark.createDataFrame(df.collect(), df.schema) for name, df in changes.items()})
    return {name: sorted(map(str, engine[name].select(sorted(engine[name].columns)).collect())) for name in TABLES}


@pytest.fixture(scope="module")
def at_once(store):
    return taken_in(store, [EVENTS])


def test_batches_give_what_one_batch_gives(store, at_once):
    """Split in the middle of runs and windows; some events, and a whole batch, come again."""
    got = taken_in(store, [EVENTS[:4], EVENTS[2:9], EVENTS[9:], EVENTS[9:]])
    for name in TABLES:
        assert got[name] == at_once[name], name


def test_what_ingest_makes(store, at_once):
    engine = store.after(store.observe(store.spark.createDataFrame([*EVENTS, EVENTS[1]], EVENT)))
    assert sorted(r.id for r in engine["observation"].collect()) == [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 13]  # the prompt at 410 s repeats the stop at 400 s
    runs = {(r.session_id, r.started_s - NOW): (r.outcome, r.lesson, r.observation_ids) for r in engine["run"].collect()}
    assert runs[1, 0] == ("committed", "Edit: a.rs · Edit: a.rs · Bash: git commit -m x · Prompt: fix it · Read: b.rs", [1, 2, 4, 5, 8])
    assert runs[2, 45] == ("uncommitted", "Edit: z.rs · Prompt: more", [6, 7])
    assert runs[2, 410] == ("unknown", None, [12])
    # The run of session 2 wrote and was closed without a commit: 60 days after its close.
    assert {r.id: r.forget_s for r in engine["memory"].collect()} == {1: NOW + 400 + 60 * 86_400, 2: None}
    assert [(r.title, r.observation_count) for r in engine["summary"].collect()] == [("Fix it", 4)]
    assert engine["session"].where("id = 3").count() == 0 and engine["observation"].where("id = 13").count() == 1


def test_events_without_id_count_once(spark, store):
    rows = [(None, 5, "p", NOW * 1_000_000, "post_tool_use", json.dumps(READ)), (None, 5, "p", NOW * 1_000_000, "post_tool_use", json.dumps(READ)), (None, 5, "p", (NOW + 900) * 1_000_000, "post_tool_use", json.dumps(READ))]
    first = store.after(store.observe(spark.createDataFrame(rows, EVENT)))
    assert first["observation"].count() == 2
    assert first.after(first.observe(spark.createDataFrame(rows, EVENT)))["observation"].count() == 2


def test_models_compress_and_rules_are_the_way_back(spark, store):
    def model(system, prompt):
        if "b.rs" in prompt:
            raise OSError("down")
        return "<type>note</type><title> Told </title><fact>one</fact><importance>9</importance>" if "a.rs" in prompt else "no tags"

    seen = store.after({n: spark.createDataFrame(d.collect(), d.schema) for n, d in store.observe(spark.createDataFrame(EVENTS[:5], EVENT), model=model).items()})
    got = {r.id: (r.obs_type, r.title, r.facts, r.importance, r.confidence) for r in seen["observation"].collect()}
    assert got[2] == ("note", "Told", ["one"], 9, 0.8)
    assert got[4][:2] == ("file_read", "Read: b.rs") and got[4][4] == 0.5
    assert got[5][0] == "command_run" and got[1][1] == "Prompt: fix it"
    assert sorted(r.failed for r in seen["reply"].collect()) == [False, False, False, True]


def test_replies_are_asked_for_once(spark):
    def model(system, prompt):
        return None if prompt == "bad" else f"{system}:{prompt}"

    asked = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "prompt string")
    none = spark.createDataFrame([], schemas.SCHEMAS["reply"])
    first = models.replies(asked, model, "s", none)
    assert sorted((r.reply or "", r.failed) for r in first.collect()) == [("", True), ("s:a", False)]
    known = models.all_replies(none, first)
    assert [r.failed for r in models.replies(asked, model, "s", known).collect()] == [True]
    assert models.replies(asked, model, "s", known, version="2").count() == 2


def test_equal_texts_are_embedded_once(spark):
    def model(texts):
        assert len(set(texts)) == len(texts) <= models.BATCH
        return models.hashed_trigrams(texts)

    rows = spark.createDataFrame([(i, f"text {i % 100}") for i in range(400)], "id long, t string").coalesce(1)
    assert models.embedded(rows, "t", model=model).select("embedding").distinct().count() == 100
