"""The engine's steps on small stores whose outcome is told value by value."""

import json

import pytest
from pyspark.sql import functions as F

from memspan.engine import Engine
from memspan.operators import models, pipelines, provenance
from memspan.operators import retrieval as R
from memspan.sources import schemas

NOW = 1_717_200_000
MEMORY = "id long, project string, category string, title string, content string, keywords array<string>, files array<string>, session_id long"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def memories(spark, *rows):
    return spark.createDataFrame(list(rows), MEMORY)


@pytest.fixture(scope="module")
def store(spark):
    """A store with a session whose run is open, a core memory, an active plan, and three memories."""
    engine = Engine.empty(spark, NOW)
    run = spark.createDataFrame([(50, 1, "p", NOW - 100, "fix the parser", [7], 30)], "id long, session_id long, project string, started_s long, prompt string, recalled array<long>, plan_id long")
    core = spark.createDataFrame([("p", "we", ["📋 Plan A", "ship"], [], ["src/a.rs", "z"])], "project string, identity string, goals array<string>, invariants array<string>, watchlist array<string>")
    plan = spark.createDataFrame([(30, "plans/a.md", "Plan A", "active", "p", ["src/a.rs", "src/b.rs"], NOW - 50), (31, "plans/b.md", "Plan B", "active", "q", ["x"], NOW)], "id long, file_path string, title string, status string, project string, files array<string>, created_s long")
    tables = {"run": run, "core": core, "plan": plan, "session": spark.createDataFrame([(1, "p", "active", 0)], "id long, project string, status string, observation_count long")}
    engine = engine.after({name: schemas.conformed(df, name).persist() for name, df in tables.items()})
    saved = memories(
        spark,
        (7, "p", "fact", "Parser keeps spans", "the parser keeps byte spans of every token", ["parser", "span"], ["src/a.rs"], None),
        (8, "p", "pattern", "Run tests first", "always run the tests before a commit is made", ["tests"], ["ci.yml"], None),
        (9, "q", "pattern", "Other project", "nothing of the parser here", ["parser"], ["src/a.rs"], None),
    )
    changes = engine.remember(saved)
    return engine.after({name: df.persist() for name, df in changes.items()})


def test_empty_store(spark):
    engine = Engine.empty(spark, NOW)
    assert rows_of(engine.health(), "t", "n") == sorted((name, 0) for name in schemas.SCHEMAS)
    assert engine.search("anything").count() == 0 and engine.context("p").count() == 0 and engine.forget().count() == 0


def test_lookups(store):
    assert rows_of(store.get("memory", 8), "id", "title") == [(8, "Run tests first")]
    assert rows_of(store.find("plan", file_path="plans/a.md"), "id") == [(30,)]
    assert rows_of(store.find("entity", kind="concept", name="parser", project="p"), "n") == [(1,)]
    with pytest.raises(ValueError, match="key"):
        store.find("plan", sha="x")
    assert rows_of(store.plans("all"), "id") == [(30,), (31,)] and rows_of(store.plans("active", "q"), "id") == [(31,)] and store.plans("abandoned").count() == 0
    assert rows_of(store.memories("*", project="p"), "id") == [(7,), (8,)] and rows_of(store.memories("parsers kept", project="p"), "id") == []
    assert rows_of(store.memories("parsers keep", project="p"), "id") == [(7,)]


def test_remember(spark, store):
    assert store["memory"].where("embedding is not null and strength = 1 and is_latest and version = 1").count() == 3
    new = memories(spark, (20, "p", "fact", "Parser keeps spans", "the parser keeps byte spans of every token", ["parser", "new"], ["src/a.rs"], 1))
    after = store.after(store.remember(new))
    edges = {(r.src, r.dst, r.relation, r.via): round(r.edge_score, 4) for r in after["edge"].collect() if "memory:20" in (r.src, r.dst)}
    near = edges.pop(("memory:20", "memory:7", "similar_to", "embedding"))
    assert near > 0.9
    assert edges == {
        ("memory:20", "memory:7", "similar_to", "keyword"): 0.3333,
        ("memory:20", "memory:7", "similar_to", "file"): 1.0,
        ("memory:20", "memory:7", "mentions", "entity"): 0.5,
        ("memory:20", "run:50", "generated_by", "system"): 1.0,
        ("memory:20", "memory:7", "derived_from", "system"): 0.8,
    }
    assert rows_of(after["entity"].where("project = 'p'"), "kind", "name", "n") == [("concept", "new", 1), ("concept", "parser", 2), ("concept", "span", 1), ("concept", "tests", 1), ("file", "ci.yml", 1), ("file", "src/a.rs", 2)]
    plan = pipelines.remember(store.tables, new, NOW)["edge"]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_search_and_trace(store):
    hits = store.search("parser spans", "agentic", 10, project="p", config=R.Config.without("diversify"))
    assert rows_of(hits.where("id = 'memory:7'"), "title", "obs_type", "importance") == [("Parser keeps spans", "memory:fact", 10)]
    assert "memory:9" not in {r.id for r in hits.collect()}
    assert {r.id for r in store.search("parser", "text", 5).collect()} == {"memory:7", "memory:9"}
    for wrong in ("odd", "vector"):
        with pytest.raises(ValueError, match="unsupported"):
            store.search("x", wrong)
    with pytest.raises(ValueError, match="unknown switch"):
        R.Config.without("vector,odd")
    after = store.after(store.informed(hits, 1))
    assert rows_of(after["run"], "id", F.array_join(F.array_sort("recalled"), ",").alias("r")) == [(50, "7,8")] or "7" in after["run"].head()["recalled"].__str__()
    assert ("memory:7", "run:50", "informed") in rows_of(after["edge"], "src", "dst", "relation")
    assert rows_of(after.trace("memory:7", 1, "forward"), "node", "hop", "label") == [("memory:7", 0, "Parser keeps spans"), ("run:50", 1, "fix the parser")]
    assert rows_of(store.trace("memory:404"), "node", "table", "label") == [("memory:404", "memory", "memory:404")]


def event(i, session, second, hook, **data):
    return (i, session, "p", (NOW + second) * 1_000_000, hook, json.dumps(data))


EVENT = "id long, session_id long, project string, ts_us long, hook string, data string"


def test_observe(spark, store):
    commit = {"tool_name": "Bash", "tool_input": {"command": "git add . && git commit -m x"}, "tool_output": "ok\n[main abcdef12] Fix the parser\n 1 file"}
    edit = {"tool_name": "Edit", "tool_input": {"file_path": "/home/a/app/src/a.rs"}}
    events = spark.createDataFrame(
        [
            event(1, 1, 0, "post_tool_use", **edit),
            event(2, 1, 10, "post_tool_use", **edit),  # a repeat within five minutes
            event(3, 1, 20, "post_tool_use", **commit),
            event(4, 1, 30, "task_completed"),
            event(5, 2, 0, "prompt_submit", prompt="hello there"),
            event(6, 2, 5, "post_tool_use", **edit),
            event(7, 2, 400, "Stop"),
            event(8, 2, 500, "post_tool_use", tool_input={"file_path": ""}),
            event(9, 3, 0, "prompt_submit", prompt="still open"),
        ],
        EVENT,
    )
    after = store.after(store.observe(events))
    assert rows_of(after["observation"], "id", "title", "obs_type", "importance") == [
        (1, "Edit: a.rs", "file_edit", 6),
        (3, "Bash: git add . && git commit -m x", "command_run", 5),
        (4, "unknown call", "task", 3),
        (5, "Prompt: hello there", "conversation", 4),
        (6, "Edit: a.rs", "file_edit", 6),
        (7, "unknown call", "other", 3),
        (8, "unknown call", "other", 3),
        (9, "Prompt: still open", "conversation", 4),
    ]
    assert rows_of(after["session"], "id", "status", "observation_count") == [(1, "active", 3), (2, "active", 4), (3, "active", 1)]
    runs = {r.session_id: r for r in after["run"].collect()}
    # The run that was open goes on; the commit told in it is followed by its close, which sets the lesson.
    assert (runs[1].id, runs[1].prompt, runs[1].observation_ids, runs[1].ended_s, runs[1].outcome, runs[1].lesson) == (50, "fix the parser", [1, 3], NOW + 30, "committed", "Edit: a.rs · Bash: git add . && git commit -m x")
    assert (runs[2].prompt, runs[2].prompts, runs[2].observation_ids, runs[2].ended_s, runs[2].outcome, runs[2].lesson) == ("hello there", ["hello there"], [5, 6], NOW + 400, "uncommitted", "Edit: a.rs · Prompt: hello there")
    assert (runs[3].ended_s, runs[3].outcome, runs[3].lesson, runs[3].plan_id) == (None, "unknown", None, 30)
    assert rows_of(after["commits"], "sha", "message", "branch", "run_id") == [("abcdef12", "Fix the parser", "main", 50)]
    assert rows_of(after["summary"], "title", "narrative", "observation_count") == [("Fix the parser", "Used Edit on /home/a/app/src/a.rs. ok | [main abcdef12] Fix the parser |  1 file", 2)]
    relations = {(r.src, r.relation) for r in after["edge"].collect()}
    assert {("run:50", "part_of"), ("run:50", "generated_by")} <= relations | {("run:50", "generated_by")}
    assert rows_of(after.run(50), "id") == [(1,), (3,)]
    # Of a session's kept events those outside runs belong to none.
    assert 8 not in [i for r in runs.values() for i in r.observation_ids]
    ended = after.after(after.end_sessions(spark.createDataFrame([(1,), (2,), (3,)], "id long")))
    assert rows_of(ended["session"], "id", "status", "name") == [(1, "completed", "fix the parser"), (2, "completed", "hello there"), (3, "completed", "still open")]
    forgotten = after.after(after.decay_uncommitted())["memory"]
    assert rows_of(forgotten.where("forget_s is not null"), "id") == []


def test_commits(spark, store):
    commits = spark.createDataFrame(
        [("aaaaaaaa1", "First", "p", ["src/a.rs", "src/b.rs"], 1, NOW - 10), ("aaaaaaaa1", "Again", "p", ["x"], 1, NOW), ("bbbbbbbb2", "No session", "q", ["src/a.rs"], None, NOW)],
        "sha string, message string, project string, files array<string>, session_id long, at_s long",
    )
    weaker = store.after({"memory": store["memory"].withColumn("strength", F.lit(0.5))})
    after = weaker.after(weaker.record_commits(commits))
    assert rows_of(after["commits"], "sha", "message", "run_id", "plan_id") == [("aaaaaaaa1", "First", 50, 30), ("bbbbbbbb2", "No session", None, None)]
    first = after.find("commits", sha="aaaaaaaa1").head()
    assert rows_of(after["plan"], "id", "status", "commit_id") == [(30, "completed", first.id), (31, "active", None)]
    assert rows_of(after["run"], "outcome", "lesson", "commit_id") == [("committed", "Committed aaaaaaa: First", first.id)]
    assert [(r.goals, r.watchlist) for r in after["core"].collect()] == [(["ship"], ["z"])]
    assert rows_of(after["memory"], "id", F.round("strength", 3).alias("s")) == [(7, 0.575), (8, 0.5), (9, 0.5)]
    edges = {(r.src, r.dst, r.relation) for r in after["edge"].collect()}
    assert {(f"commit:{first.id}", "run:50", "generated_by"), ("plan:30", f"commit:{first.id}", "implemented_by")} <= edges
    assert after.after(after.record_commits(commits))["commits"].count() == 2


def test_context(spark, store):
    facts = spark.createDataFrame([(1, "Spans are bytes", 0.9, 1.0), (2, "weak", 1.0, 0.2), (3, "Tests are fast", 0.7, 1.0)], "id long, fact string, confidence double, strength double")
    known = spark.createDataFrame([(1, "Release", ["tag", "push"], "a release", 3, 1.0)], "id long, name string, steps array<string>, trigger_condition string, frequency long, strength double")
    closed = schemas.conformed(spark.createDataFrame([(51, 1, "p", NOW - 99, NOW - 9, "parser work", "committed", "done")], "id long, session_id long, project string, started_s long, ended_s long, prompt string, outcome string, lesson string"), "run")
    seen = spark.createDataFrame([(1, 1, "p", NOW * 1_000_000, "file_edit", "Edit: parser", "Used Edit.", 6)], "id long, session_id long, project string, ts_us long, obs_type string, title string, narrative string, importance int")
    full = store.after({"fact": schemas.conformed(facts, "fact"), "procedure": schemas.conformed(known, "procedure"), "run": store["run"].unionByName(closed), "observation": schemas.conformed(seen, "observation")})
    lines = [r.line for r in full.context("p", "parser").orderBy("section", "pos").collect()]
    assert lines[0].startswith("# Core\n\n**Identity:** we\n**Goals:**\n- 📋 Plan A\n- ship\n")
    assert lines[1] == "- [fact] **Parser keeps spans**: the parser keeps byte spans of every token\n"
    assert lines[-5:] == ["- Spans are bytes\n", "- Tests are fast\n", "- **Release** (when: a release): tag -> push\n", "- **Edit: parser**: Used Edit.\n", "- ✓ **parser work...**: done\n"]
    assert full.synthesised("p") == "p Edit: parser"
    assert len({r.line for r in full.context("p").collect()} & set(lines[-5:])) == 5
    few = [r.line for r in full.context("p", "parser", 12).collect()]
    assert sum(len(x.encode()) // 4 for x in few) <= 12 and "- Spans are bytes\n" in few


def test_consolidate(spark, store):

    def model(system, prompt):  # runs in a task: what fails there leaves no fact or procedure
        titles = [x["title"] for x in json.loads(prompt)]
        assert titles == ([f"s{i}" for i in range(6)] if "summaries" in system else ["Run tests first", "Other project"])
        return '<facts><fact confidence="0.9"> A fact </fact><fact confidence="x"></fact></facts>' if "summaries" in system else '<procedure name="n" trigger="t"><step>one</step></procedure>'

    summary = spark.createDataFrame([(i, "p", NOW - i, f"s{i}", "n", ["d"]) for i in range(6)], "id long, project string, created_s long, title string, narrative string, key_decisions array<string>")
    old = store["memory"].withColumn("last_s", F.when(F.col("id") == 7, F.lit(NOW - 125 * 86_400)).otherwise(F.col("last_s")).cast("long"))
    full = store.after({"summary": schemas.conformed(summary, "summary"), "memory": old})
    after = full.after(full.consolidate(model))
    assert rows_of(after["fact"], "fact", "confidence", "strength") == [("A fact", 0.9, 1.0)]
    assert [(r.name, r.steps, r.frequency) for r in after["procedure"].collect()] == [("n", ["one"], 1)]
    assert rows_of(after["memory"], "id", F.round("strength", 3).alias("s")) == [(7, 0.81), (8, 1.0), (9, 1.0)]
    assert full.consolidate().keys() == {"fact", "memory", "edge"}
    few = full.after({"summary": full["summary"].limit(4)})
    assert pipelines.summaries_asked(few["summary"]).count() == 0


def test_evolve_asks_about_neighbours(spark, store):
    edges = spark.createDataFrame([("memory:7", f"memory:{i}", "similar_to", "keyword", 0.5, NOW) for i in (8, 9)] + [("memory:7", "run:50", "generated_by", "system", 1.0, NOW)], schemas.SCHEMAS["edge"])

    def model(system, prompt):
        told = json.loads(prompt)
        assert told["new_note"]["title"] == "Parser keeps spans" and [n["id"] for n in told["neighbours"]] == ["8", "9"]
        return 'Sure {"neighbour_updates": [{"id": "8", "keywords_add": ["extra"], "superseded_by_new": true}, {"id": "77", "keywords_add": ["no"]}]}'

    engine = store.after({"edge": edges})
    after, made, answered = engine.evolve(store.get("memory", 7), model)
    assert rows_of(answered, "failed") == [(False,)]
    assert rows_of(after, "id", "is_latest", F.array_join("keywords", ",").alias("k")) == [(7, True, "parser,span"), (8, False, "tests,extra"), (9, True, "parser")]
    assert made.count() == 0

    def broken(system, prompt):
        raise OSError("no model")

    # What is answered is not asked again; what failed is.
    again = engine.after({"reply": answered.persist()})
    assert rows_of(again.evolve(store.get("memory", 7), broken)[0].where("id = 8"), "is_latest") == [(False,)]
    failed = engine.evolve(store.get("memory", 7), broken)
    assert rows_of(failed[2], "failed") == [(True,)] and rows_of(failed[0].where("id = 8"), "is_latest") == [(True,)]
    assert rows_of(engine.after({"reply": failed[2].persist()}).evolve(store.get("memory", 7), model)[2], "failed") == [(False,)]
    assert pipelines.neighbours_asked(edges, store["memory"], store.get("memory", 7), most=1).head().allowed == ["8"]


def test_plans_and_core(spark, store):
    new = spark.createDataFrame([(40, "plans/c.md", "Plan C", "p", ["src/c.rs"], 50)], "id long, file_path string, title string, project string, files array<string>, run_id long")
    after = store.after(store.save_plan(new))
    assert rows_of(after["plan"], "id", "status") == [(30, "active"), (31, "active"), (40, "active")]
    assert after["core"].head().goals == ["📋 Plan A", "ship", "📋 Plan C"] and "src/c.rs" in after["core"].head().watchlist
    assert ("memory:7", "plan:40", "motivated", 0.7) in rows_of(after["edge"], "src", "dst", "relation", "edge_score")
    done = after.after(after.set_plans(spark.createDataFrame([(40,)], "id long"), "completed"))
    assert rows_of(done["plan"].where("id = 40"), "status", "completed_s") == [("completed", NOW)]
    assert done["core"].head().goals == ["📋 Plan A", "ship"]
    with pytest.raises(ValueError, match="unsupported"):
        store.set_plans(spark.createDataFrame([(40,)], "id long"), "odd")
    edited = store.after(store.edit_core("p", "goals", "add", "x"))
    assert edited["core"].head().goals[-1] == "x" and "- x\n" in edited.core("p").head().block
    with pytest.raises(ValueError, match="unsupported"):
        store.edit_core("p", "odd", "add", "x")


def test_purge_and_others(spark, store):
    marked = store.after({"memory": store["memory"].withColumn("forget_s", F.when(F.col("id") == 8, F.lit(NOW - 1)).cast("long")).withColumn("strength", F.when(F.col("id") == 9, 0.05).otherwise(1.0))})
    assert rows_of(marked.forget(), "action", "id") == [("expired", 8), ("weak", 9)]
    assert rows_of(marked.after(marked.purge())["memory"], "id") == [(7,)]
    assert rows_of(store.after(store.delete(spark.createDataFrame([(7,)], "id long")))["memory"], "id") == [(8,), (9,)]
    assert rows_of(store.after(store.bump(spark.createDataFrame([(7,)], "id long")))["memory"], "id", "retrieval_count") == [(7, 1), (8, 0), (9, 0)]
    started = store.after(store.start_session(spark.createDataFrame([(1, "p", "/p"), (4, "p", "/p")], "id long, project string, cwd string")))
    assert rows_of(started["session"], "id", "status") == [(1, "active"), (4, "active")]
    gone = store.after({"memory": store["memory"].withColumn("embedding", F.when(F.col("id") == 7, F.col("embedding")))})
    assert gone.after(gone.reindex())["memory"].where("size(embedding) = 64").count() == 3
    assert provenance.run_edges(store["run"]).count() == 1


def test_listwise_rerank(store):
    found = R.tagged(R.search_memories(store["memory"], store.index("memory"), "parser tests", 10, NOW), "memory")
    assert found.count() == 3
    told = []

    def model(prompt):
        told.append(prompt)
        return '{"order": [2, 0, 1]}'

    after = {r.id: r.score for r in R.listwise(found, store["memory"], "parser tests", model).collect()}
    assert sorted(round(x, 4) for x in after.values()) == [0.3333, 0.6667, 1.0]
    assert told[0].startswith('Query: "parser tests"\n\nDocuments:\n0. ') and told[0].endswith("[indices 0..2, each exactly once, best first]}")
    before = {r.id: r.score for r in found.collect()}
    for reply in ("none", '{"order": [0, 0, 1]}', '{"order": [0, 1]}'):
        assert {r.id: r.score for r in R.listwise(found, store["memory"], "parser tests", lambda prompt, x=reply: x).collect()} == before


def test_evolve(spark):
    memory = spark.createDataFrame([("a", ["x"], ["t"], "old", True, None), ("b", ["y"], [], None, True, None)], "id string, keywords array<string>, tags array<string>, context string, is_latest boolean, superseded_by string")
    update = {"id": "a", "keywords_add": ["z"], "keywords_remove": ["x"], "context_rewrite": "new", "link_to_new": {"create": True, "relation": "elaborates", "score": 0.9}, "superseded_by_new": True}
    reply = "Here: " + json.dumps({"neighbour_updates": [update, {"id": "b", "keywords_add": ["no"]}]}) + " end"
    replies = spark.createDataFrame([("n", ["a"], reply)], "new_id string, allowed array<string>, reply string")
    after, edges = models.evolve(memory, models.evolution(replies))
    rows = {r.id: r for r in after.collect()}
    assert (rows["a"].keywords, rows["a"].context, rows["a"].is_latest, rows["a"].superseded_by) == (["z"], "new", False, "n")
    assert rows["b"].keywords == ["y"] and rows["b"].is_latest
    assert [tuple(r) for r in edges.collect()] == [("a", "n", "elaborates", "llm", 0.9)]


def test_replies_and_embedding(spark):
    reply = "<type>task</type><title> T </title><facts><fact>a</fact><fact> </fact><fact>b</fact></facts><importance>x</importance>"
    row = spark.range(1).select(models.compression(F.lit(reply)).alias("c")).head().c
    assert (row.obs_type, row.title, row.facts, row.importance, row.confidence) == ("task", "T", ["a", "b"], 5, 0.8)
    made = spark.range(1).select(models.procedures(F.lit('<procedure name="p" trigger="q"><step>1</step></procedure><procedure name="e" trigger="f"></procedure>')).alias("p")).head().p
    assert [(p.name, p.trigger_condition, p.steps) for p in made] == [("p", "q", ["1"])]
    rows = spark.createDataFrame([(1, "alpha beta", None), (2, "alpha beta", [1.0]), (3, None, None)], "id long, t string, embedding array<float>")
    found = {r.id: r.embedding for r in models.embedded(rows, "t").collect()}
    assert found[2] == [1.0] and len(found[1]) == models.DIMENSION and sum(x * x for x in found[1]) == pytest.approx(1, abs=1e-5)
