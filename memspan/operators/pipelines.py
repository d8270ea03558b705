"""Whole steps of the store: observing, saving, committing, consolidating, evolving.

A step takes the tables by name and what is new, and returns the tables that change, each
in its next version, or the new rows of tables that only grow (``observation``, ``edge``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.functions import hooks, scores, text
from memspan.operators import graph, lifecycle, maintain, models, plans, provenance
from memspan.operators.vectorindex import VectorIndex
from memspan.sources.schemas import SCHEMAS, conformed, empty
from memspan.sources.tables import checkpoint, written

Tables = Mapping[str, DataFrame]
Model = models.Model
#: What language models are asked for; the tags are those that ``facts_told`` and ``procedures_told`` read.
FACTS_ASKED = 'Session summaries follow as JSON. List what holds for the project beyond one session, each as <fact confidence="C">TEXT</fact> with C between 0 and 1, and write nothing else.'
PROCEDURES_ASKED = 'Patterns follow as JSON. For each routine that several of them show write <procedure name="NAME" trigger="WHEN"><step>TEXT</step>...</procedure>, and nothing else.'


def _ends(df: DataFrame) -> DataFrame:
    """Events with their canonical ``event``."""
    return df.withColumn("event", hooks.event_name(F.col("hook")))


def _table(tables: Tables, name: str, like: DataFrame) -> DataFrame:
    return tables[name] if name in tables else empty(like.sparkSession, name)


def unseen(events: DataFrame, seen: DataFrame) -> DataFrame:
    """Events that were not taken in before, each id once. An event without id has one made of all that it tells."""
    made = F.abs(F.xxhash64("session_id", "project", "ts_us", "hook", "data"))
    return events.withColumn("id", F.coalesce("id", made)).join(seen.select("id"), "id", "left_anti").dropDuplicates(["id"]).select(*events.columns)


def observe(tables: Tables, events: DataFrame, now_s: int, ttl_us: int = lifecycle.TTL_US, model: Model | None = None, version: str = "1") -> dict[str, DataFrame]:
    """What hook events ``id, session_id, project, ts_us, hook, data`` make of the store.

    Events count once: ids that were taken in before (``seen``) are left out, and what the
    last kept event of a key hides is told by ``dedup``. So a batch that comes twice changes
    nothing, and batches that split a stretch of time give what one batch gives.

    Runs are opened by prompts and closed by stops and completed tasks before repeats are
    dropped; an open run of the store goes on. What is kept becomes observations, by a
    language model if one is given and by rules where it fails; they belong to the run that
    was open then and count for their session. Closed runs get an outcome and the titles
    of their five most important observations; where they wrote without a commit, memories
    of the files are to be forgotten. Commits that a shell made are told as rows for
    ``record_commits``. Events without time are kept, belong to no run and begin no session.
    """
    runs = tables["run"]
    events = written(unseen(events, _table(tables, "seen", runs)))
    prompt = F.coalesce(F.get_json_object("data", "$.prompt"), F.lit(""))
    timed = events.where("ts_us is not null")
    rows = _ends(timed).select("id", "session_id", "project", "ts_us", "event", prompt.alias("prompt"), F.lit(None).cast("bigint").alias("run_id"))
    window = lifecycle.Window.partitionBy("session_id").orderBy(F.desc("started_s"), F.desc("id"))
    live = runs.where("ended_s is null").withColumn("_nth", F.row_number().over(window)).where("_nth = 1")
    live = live.join(timed.select("session_id").distinct(), "session_id", "left_semi")
    going = live.select(F.lit(None).cast("bigint").alias("id"), "session_id", "project", (F.col("started_s") * 1_000_000).alias("ts_us"), F.lit("prompt_submit").alias("event"), F.lit(None).cast("string").alias("prompt"), F.col("id").alias("run_id"))
    closes = F.col("event").isin("session_stop", "task_completed")
    numbered = lifecycle.run_numbers(rows.unionByName(going), "session_id", ["ts_us", "id"], F.col("event") == "prompt_submit", closes).withColumn("closes", closes)
    numbered = written(numbered)  # several tables come of these few columns

    given = F.coalesce(hooks.tool_input(F.col("data")), F.lit(""))
    last = _table(tables, "dedup", runs)
    key = hooks.dedup_key(F.col("session_id"), hooks.tool_name(F.col("data")), given).alias("_dedup")
    # Repeats are told by key and time alone; payloads are moved once, to those that stay.
    first = lifecycle.ttl_dedup(events.select("id", "ts_us", key), "_dedup", "ts_us", "id", ttl_us, last=last).select("id")
    kept = written(events.join(first, "id", "left_semi").select("*", key))
    next_last = lifecycle.last_kept(kept, "_dedup", "ts_us", last)
    kept = kept.drop("_dedup")
    seen = hooks.observed(kept).withColumn("at_s", F.floor(F.col("ts_us") / 1_000_000))
    answered = None
    if model is not None:
        seen = seen.withColumn("prompt", F.to_json(F.struct("hook", "project", "data")))
        known = _table(tables, "reply", runs)
        answered = models.all_replies(known, models.replies(seen, model, models.COMPRESS_ASKED, known, version))
        seen = models.compressed(seen, answered, version)
    observations = conformed(seen.select(*(c for c in seen.columns if c in SCHEMAS["observation"].replace(",", " ").split())), "observation")
    if model is not None:
        observations = checkpoint(observations)

    inside = numbered.where("run_no is not null")
    prompts = F.transform(F.array_sort(F.collect_list(F.when((F.col("event") == "prompt_submit") & F.col("id").isNotNull(), F.struct("ts_us", "id", "prompt")))), lambda x: x["prompt"])
    opened = inside.groupBy("session_id", "run_no").agg(F.first("project").alias("project"), F.floor(F.min("ts_us") / 1_000_000).alias("started_s"), F.min(F.struct("ts_us", "id"))["ts_us"].alias("ts_us"), F.max("run_id").alias("run_id"), prompts.alias("more"))
    before = lifecycle.Window.partitionBy("session_id").orderBy("ts_us", "id").rowsBetween(lifecycle.Window.unboundedPreceding, -1)
    ended = numbered.withColumn("of", F.last("run_no", ignorenulls=True).over(before)).where("closes and of is not null").groupBy("session_id", F.col("of").alias("run_no")).agg(F.floor(F.min("ts_us") / 1_000_000).alias("ended_s"))
    shown = ("id", "obs_type", "title", "importance", "ts_us", "files")
    member = inside.where("id is not null").select("id", "session_id", "run_no").join(observations.select(*shown), "id")
    committed = hooks.commits_of(kept)
    # What a run that goes on observed before counts for its outcome and lesson.
    earlier = inside.where("run_id is not null").select("session_id", "run_no", "run_id").join(live.select(F.col("id").alias("run_id"), F.explode("observation_ids").alias("id")), "run_id").drop("run_id").join(tables["observation"].select(*shown), "id")
    every = member.select("session_id", "run_no", *shown).unionByName(earlier.select("session_id", "run_no", *shown))
    told = every.join(committed.select("id", F.lit(True).alias("c")), "id", "left").groupBy("session_id", "run_no").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.coalesce(F.bool_or("c"), F.lit(False)).alias("c"), F.bool_or(F.col("obs_type").isin("file_write", "file_edit")).alias("w"))
    lessons = lifecycle.joined_top(every, ["session_id", "run_no"], "title", [F.desc("importance"), F.col("ts_us"), F.col("id")], 5, " · ", "told")
    made = opened.join(ended, ["session_id", "run_no"], "left").join(told, ["session_id", "run_no"], "left").join(lessons, ["session_id", "run_no"], "left")
    made = made.withColumn("id", F.coalesce("run_id", F.abs(F.xxhash64("session_id", "ts_us"))))
    old = runs.select(F.col("id").alias("run_id"), *(F.col(c).alias(f"_{c}") for c in ("prompt", "prompts", "observation_ids", "lesson", "recalled", "commit_id", "plan_id", "outcome")))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    active = lifecycle.latest(tables["plan"].where("status = 'active'"), ["project"], [F.desc("created_s"), F.desc("id")]).select("project", F.col("id").alias("active"))
    made = made.join(old, "run_id", "left").join(active, "project", "left")
    found = F.col("ended_s").isNotNull()
    outcome = lifecycle.outcome(F.col("c") | F.col("_commit_id").isNotNull(), F.col("w"))
    prompts_now = F.concat(F.coalesce("_prompts", none("string")), F.coalesce("more", none("string")))
    fresh = made.select(
        "id",
        "session_id",
        "project",
        "started_s",
        "ended_s",
        F.coalesce("_prompt", F.get(prompts_now, F.lit(0))).alias("prompt"),
        prompts_now.alias("prompts"),
        F.when(found, F.coalesce(outcome, F.lit("success"))).otherwise(F.coalesce("_outcome", F.lit("unknown"))).alias("outcome"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce("_observation_ids", none("bigint")), F.coalesce("ids", none("bigint"))))).alias("observation_ids"),
        F.when(found, F.nullif("told", F.lit(""))).otherwise(F.col("_lesson")).alias("lesson"),
        F.coalesce("_recalled", none("bigint")).alias("recalled"),
        F.col("_commit_id").alias("commit_id"),
        F.coalesce("_plan_id", "active").alias("plan_id"),
        "run_no",
    )
    fresh = written(fresh)
    numbers, fresh = fresh.select("id", "session_id", "run_no"), conformed(fresh, "run")
    next_runs = conformed(runs.join(fresh.select("id"), "id", "left_anti"), "run").unionByName(fresh)

    counted = observations.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    first = timed.groupBy(F.col("session_id").alias("id")).agg(F.min_by("project", F.struct("ts_us", "id")).alias("project"), F.floor(F.min("ts_us") / 1_000_000).alias("started_s"))
    known = tables["session"]
    new = first.join(known.select("id"), "id", "left_anti").select("id", "project", "started_s", F.lit("active").alias("status"), F.lit(0).cast("bigint").alias("observation_count"))
    sessions = conformed(known, "session").unionByName(conformed(new, "session")).join(counted, "id", "left")
    sessions = sessions.withColumn("observation_count", F.col("observation_count") + F.coalesce("_n", F.lit(0))).drop("_n")

    runs_of = member.join(numbers.withColumnRenamed("id", "run_id"), ["session_id", "run_no"]).select("id", "run_id")
    commits = committed.join(runs_of, "id", "left").select("sha", "branch", "message", "project", "session_id", "run_id", F.floor(F.col("ts_us") / 1_000_000).alias("at_s"))
    edges = provenance.run_edges(next_runs).join(fresh.select(provenance.named("run", F.col("id")).alias("src")), "src", "left_semi").withColumn("created_s", F.lit(now_s).cast("bigint"))
    out = {"observation": observations, "run": next_runs, "session": sessions, "commits": conformed(commits, "commits"), "edge": conformed(edges, "edge"), "seen": events.select("id").distinct(), "dedup": next_last}
    if answered is not None:
        out["reply"] = answered
    # A run that is closed without a commit makes memories of what it wrote fade.
    bad = fresh.where("ended_s is not null and outcome = 'uncommitted'").select(F.col("id").alias("run_id"), F.col("project").alias("of"), "ended_s")
    if not bad.isEmpty():
        wrote = every.where(F.col("obs_type").isin("file_write", "file_edit")).join(numbers.withColumnRenamed("id", "run_id"), ["session_id", "run_no"])
        touched = wrote.join(bad, "run_id").select(F.col("of").alias("project"), F.explode("files").alias("file"), "ended_s")
        covered = tables["commits"].select("project", F.explode("files").alias("file"))
        fading = lifecycle.uncommitted_decay(tables["memory"], touched, covered, now_s).withColumnRenamed("forget_s", "_forget")
        out["memory"] = tables["memory"].join(fading, "id", "left").withColumn("forget_s", F.coalesce("_forget", "forget_s")).drop("_forget")
    return out


def _named_edges(pairs: DataFrame, relation: str, via: str | None = None) -> DataFrame:
    """Edges between memories of pairs ``src, dst`` with a score and, unless given, a ``via``."""
    key = lambda c: provenance.named("memory", F.col(c)).alias(c)
    return pairs.select(key("src"), key("dst"), F.lit(relation).alias("relation"), (F.col("via") if via is None else F.lit(via)).alias("via"), "edge_score")


def remember(tables: Tables, rows: DataFrame, now_s: int, model: models.Embedder = models.hashed_trigrams, nearest: int = 10) -> dict[str, DataFrame]:
    """What new memories make of the store: the tables of ``remembered``."""
    return remembered(tables, rows, now_s, model, nearest)[0]


def remembered(tables: Tables, rows: DataFrame, now_s: int, model: models.Embedder = models.hashed_trigrams, nearest: int = 10, vectors: VectorIndex | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """What new memories ``id, project, category, title, content, keywords, files, session_id`` make of the store, and the new rows as they are stored.

    They are embedded and linked: to their ten nearest memories of the project where vectors,
    keywords or files are alike, to those that share a keyword or file, and to the run that
    was open in their session and what it had recalled. Their entities are counted. With an
    index of the stored vectors only the cells that new memories probe are read.
    """
    made = rows.select(
        *rows.columns,
        F.lit(1.0).alias("strength"),
        F.lit(0).cast("bigint").alias("retrieval_count"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(1).alias("version"),
        F.lit(True).alias("is_latest"),
        *(F.lit(now_s).cast("bigint").alias(c) for c in ("last_s", "created_s", "updated_s")),
        models.embed_text(F.col("title"), F.col("content"), F.col("keywords"), F.col("files")).alias("_text"),
    )
    new = checkpoint(models.embedded(made, "_text", model=model).drop("_text"))
    stored_new = conformed(new.drop("session_id"), "memory")
    memory = conformed(tables["memory"], "memory").unionByName(stored_new)
    # A memory is looked for in its own project and among those of all projects.
    places = F.array_distinct(F.array("project", F.lit("global")))
    asking = new.select("id", "embedding", F.explode(places).alias("place"))
    shown = lambda df: df.where("is_latest").select("id", "embedding", F.col("project").alias("place"))
    if vectors is None or vectors.model is None:
        found = graph.nearest_of(asking, shown(memory), nearest, "place")
    else:
        found = graph.nearest_of(asking, shown(stored_new), nearest, "place").unionByName(indexed_nearest(asking, vectors, tables["memory"].where("is_latest"), nearest))
    window = lifecycle.Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")
    pairs = found.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= nearest).drop("_nth")
    alike = graph.similarity_edges(pairs, memory)
    items = lambda df: df.select("id", "project", F.concat("keywords", "files").alias("entities"))
    shared = graph.tokens_shared_with(items(new), items(tables["memory"]), "entities", "project").withColumnRenamed("jaccard", "edge_score")
    edges = _named_edges(alike, "similar_to").unionByName(_named_edges(shared, "mentions", "entity"))
    saved = new.where("session_id is not null").select("id", "session_id", F.lit(now_s).cast("bigint").alias("at_s"))
    edges = edges.unionByName(provenance.memory_edges(saved, tables["run"].select("id", "session_id", "started_s", "ended_s", "recalled")))
    told = lifecycle.entities(new.select("project", F.lit(now_s).cast("bigint").alias("at_s"), "files", "keywords", F.concat_ws("\n", "title", "content").alias("text")))
    out = {"memory": memory, "edge": conformed(edges.withColumn("created_s", F.lit(now_s).cast("bigint")), "edge"), "entity": lifecycle.entities_merged(tables["entity"], told)}
    return out, stored_new


def indexed_nearest(asking: DataFrame, vectors: VectorIndex, scope: DataFrame, k: int) -> DataFrame:
    """``id, nbr, sim`` of rows ``id, embedding, place`` among indexed ones of their place (the kept column ``project``), within the cells that they probe."""
    probing = checkpoint(vectors.probed(asking).select("id", "embedding", "place", "cell"))
    cells = [r["cell"] for r in probing.select("cell").distinct().collect()]  # as many as the index has, at most
    at = lambda df: df.withColumn("_at", F.concat_ws(":", F.col("cell").cast("string"), "place"))
    stored = vectors.live(["v", "project"], cells, scope=scope).select("id", F.col("v").alias("embedding"), F.col("project").alias("place"), "cell")
    return graph.nearest_of(at(probing), at(stored), k, "_at")


def record_commits(tables: Tables, rows: DataFrame, now_s: int, least: float = 0.8) -> dict[str, DataFrame]:
    """What commits ``sha, message, author, branch, project, files, session_id, at_s`` make of the store.

    A sha counts once, and not if it is known. A commit belongs to its ``run_id``, or to the
    run that was open in its session; it marks that run, strengthens memories of its
    project that share a file (if it has a session, each commit once), and is linked to the project's
    active plan if they share a file, which it completes if it covers ``least`` of its
    files; the plan then leaves core memory. Runs with observations give a summary.
    """
    given = conformed(rows, "commits").join(tables["commits"].select("sha"), "sha", "left_anti")
    first = lifecycle.latest(given, ["sha"], [F.col("at_s"), F.col("message")]).withColumn("id", F.abs(F.xxhash64("sha")))
    open_ = lifecycle.open_at(first.where("session_id is not null").select("id", "session_id", "at_s"), tables["run"].select("id", "session_id", "started_s", "ended_s"), "session_id", "at_s")
    commits = checkpoint(first.join(open_, "id", "left").withColumn("run_id", F.coalesce("run_id", "span_id")).drop("span_id").withColumn("created_s", F.lit(now_s).cast("bigint")))

    plan = lifecycle.latest(tables["plan"].where("status = 'active'"), ["project"], [F.desc("created_s"), F.desc("id")])
    both = commits.join(plan.select("project", F.col("id").alias("_plan"), F.array_distinct("files").alias("_files")), "project")
    both = both.select("id", "at_s", "_plan", (F.size(F.array_intersect("_files", "files")) / F.size("_files")).alias("coverage")).where("coverage > 0")
    commits = commits.drop("plan_id").join(both.select("id", F.col("_plan").alias("plan_id")), "id", "left")
    done = both.where(F.col("coverage") >= least).groupBy(F.col("_plan").alias("id")).agg(F.min_by("id", F.struct("at_s", "id")).alias("_by"), F.min("at_s").alias("_at"))
    next_plans = tables["plan"].join(done, "id", "left")
    ended = F.col("_by").isNotNull()
    next_plans = next_plans.withColumn("status", F.when(ended, "completed").otherwise(F.col("status"))).withColumn("commit_id", F.coalesce("_by", "commit_id")).withColumn("completed_s", F.coalesce("_at", "completed_s")).drop("_by", "_at")
    core = plans.core_synced(tables["core"], tables["plan"].join(done.select("id"), "id", "left_semi"), "remove")

    last = lifecycle.latest(commits.where("run_id is not null"), ["run_id"], [F.desc("at_s"), F.col("id")]).select(F.col("run_id").alias("id"), F.col("id").alias("_commit"), lifecycle.committed_lesson(F.col("sha"), F.col("message")).alias("_told"), F.col("at_s").alias("_at"))
    marked = tables["run"].join(last, "id", "left")
    hit = F.col("_commit").isNotNull()
    lesson = F.when(hit & (F.col("ended_s").isNull() | (F.col("ended_s") < F.col("_at"))), F.col("_told")).otherwise(F.col("lesson"))  # a run that was closed later tells its own
    marked = marked.withColumn("outcome", F.when(hit, "committed").otherwise(F.col("outcome"))).withColumn("lesson", lesson).withColumn("commit_id", F.coalesce("_commit", "commit_id")).drop("_commit", "_told", "_at")

    inside = commits.where("run_id is not null and session_id is not null").select(F.col("id").alias("cid"), "session_id", "project", "message", "run_id", F.col("at_s").alias("_at"))
    seen = inside.join(tables["run"].select(F.col("id").alias("run_id"), F.explode("observation_ids").alias("id")), "run_id").join(tables["observation"].select("id", "title", "narrative", "files", "keywords", "importance", "ts_us"), "id")
    seen = seen.where(F.coalesce(F.floor(F.col("ts_us") / 1_000_000) <= F.col("_at"), F.lit(True)))  # what was observed up to the commit
    window = lifecycle.Window.partitionBy("cid").orderBy(F.desc("importance"), "ts_us", "id")
    ten = seen.withColumn("nth", F.row_number().over(window)).where("nth <= 10")
    listed = lambda c, most: F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", c)))), lambda x: x[c])
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    summary = ten.groupBy("cid", "session_id", "project", "message").agg(listed("narrative", 5).alias("n"), listed("title", 5).alias("key_decisions"), union("files").alias("files"), union("keywords").alias("keywords"), F.count(F.lit(1)).alias("observation_count"))
    summary = summary.select(F.col("cid").alias("id"), "session_id", "project", F.lit(now_s).cast("bigint").alias("created_s"), F.col("message").alias("title"), F.array_join("n", " ").alias("narrative"), "key_decisions", "files", "keywords", "observation_count")

    edges = provenance.commit_edges(commits, tables["run"].select("id", "plan_id")).withColumn("created_s", F.lit(now_s).cast("bigint"))
    return {
        "commits": conformed(commits, "commits"),
        "edge": conformed(edges, "edge"),
        "run": marked,
        "memory": lifecycle.strengthened_by(tables["memory"], commits.where("session_id is not null").select("id", "project", "files")),
        "plan": next_plans,
        "core": core,
        "summary": conformed(summary, "summary"),
    }


def summaries_asked(summary: DataFrame, newest: int = 20, least: int = 5) -> DataFrame:
    """``prompt``: the newest summaries as JSON, or no row if there are under ``least``."""
    few = summary.orderBy(F.desc("created_s"), "id").limit(newest)
    kept = F.struct("created_s", "id", "project", "title", "narrative", "key_decisions")
    listed = few.select(kept.alias("s")).agg(F.reverse(F.array_sort(F.collect_list("s"))).alias("l")).where(F.size("l") >= least)
    return listed.select(text.pretty_json(F.col("l")).alias("prompt"))


def patterns_asked(memory: DataFrame, most: int = 20, least: int = 2) -> DataFrame:
    """``prompt``: the strongest patterns as JSON, or no row if there are under ``least``."""
    few = memory.where("is_latest and category = 'pattern'").orderBy(F.desc("strength"), "id").limit(most)
    listed = few.select(F.struct((-F.col("strength")).alias("s"), "id", "title", "content").alias("s")).agg(F.array_sort(F.collect_list("s")).alias("l")).where(F.size("l") >= least)
    return listed.select(text.pretty_json(F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["content"].alias("content"), (-x["s"]).alias("strength")))).alias("prompt"))


def _replies(asked: DataFrame, model: Model, system: str, known: DataFrame) -> DataFrame:
    """Replies to a prompt or none; those that were given before are not asked again."""
    fresh = models.replies(asked, model, system, known)
    return models.all_replies(known, fresh).join(asked.select(models.prompt_hash(F.col("prompt"), system, "1").alias("hash")), "hash", "left_semi").where("not failed")


def facts_told(replies: DataFrame, now_s: int) -> DataFrame:
    """Facts of a reply, as rows of the table of facts."""
    made = replies.select(F.explode(text.xml_facts(F.col("reply"))).alias("f")).select(F.trim("f.fact").alias("fact"), "f.confidence").where("fact <> ''")
    at = F.lit(now_s).cast("bigint")
    return conformed(made.select(F.abs(F.xxhash64("fact", at)).alias("id"), "fact", "confidence", F.lit(1.0).alias("strength"), F.lit(0).cast("bigint").alias("retrieval_count"), at.alias("last_s"), at.alias("created_s")), "fact")


def procedures_told(replies: DataFrame, now_s: int) -> DataFrame:
    made = replies.select(F.explode(models.procedures(F.col("reply"))).alias("p")).select("p.*")
    at = F.lit(now_s).cast("bigint")
    return conformed(made.select(F.abs(F.xxhash64("name", at)).alias("id"), "name", "steps", "trigger_condition", F.lit(1).cast("bigint").alias("frequency"), F.lit(1.0).alias("strength"), at.alias("created_s")), "procedure")


def decayed(tables: Tables, now_s: int) -> dict[str, DataFrame]:
    """Facts after 30 and memories after 60 days without use lose strength; a memory's change under 0.001 is none."""
    age = lambda: scores.age_days(F.lit(now_s), F.coalesce("last_s", "created_s"))
    facts = tables["fact"].withColumn("strength", scores.decayed(F.col("strength"), age(), 30))
    after = scores.decayed(F.col("strength"), age(), 60)
    memory = tables["memory"].withColumn("strength", F.when(F.abs(after - F.col("strength")) > 0.001, after).otherwise(F.col("strength")))
    return {"fact": facts, "memory": memory}


def consolidate(tables: Tables, now_s: int, model: Model | None = None) -> dict[str, DataFrame]:
    """Four tiers: facts of summaries, edges within clusters, procedures of patterns, decay. Without a model the first and third are left out."""
    out = decayed(tables, now_s)
    members = maintain.clusters(tables["memory"].where("is_latest"))
    pairs = members.withColumnRenamed("id", "src").join(members.withColumnRenamed("id", "dst"), "cluster").where("src < dst").withColumn("edge_score", F.lit(0.5))
    out["edge"] = conformed(_named_edges(pairs, "similar_to", "cluster").withColumn("created_s", F.lit(now_s).cast("bigint")), "edge")
    if model is not None:
        known = empty(tables["memory"].sparkSession, "reply")  # each consolidation asks anew
        out["fact"] = out["fact"].unionByName(facts_told(_replies(summaries_asked(tables["summary"]), model, FACTS_ASKED, known), now_s), allowMissingColumns=True)
        out["procedure"] = tables["procedure"].unionByName(procedures_told(_replies(patterns_asked(tables["memory"]), model, PROCEDURES_ASKED, known), now_s), allowMissingColumns=True)
    return out


def neighbours_asked(edges: DataFrame, memory: DataFrame, new: DataFrame, most: int = 5) -> DataFrame:
    """``new_id, allowed, prompt``: for each new memory its first ``most`` neighbours by id, along edges that leave it, and both as JSON."""
    out = edges.where("src like 'memory:%' and dst like 'memory:%'").select(F.substring_index("src", ":", -1).cast("bigint").alias("new_id"), F.substring_index("dst", ":", -1).cast("bigint").alias("id"))
    near = out.join(new.select(F.col("id").alias("new_id")), "new_id", "left_semi").distinct()
    window = lifecycle.Window.partitionBy("new_id").orderBy(F.col("id").cast("string"))
    near = near.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= most)
    told = memory.select("id", F.struct(F.col("id").cast("string").alias("id"), "title", "content", "keywords", "tags", "context").alias("m"))
    listed = near.join(told, "id").groupBy("new_id").agg(F.array_sort(F.collect_list(F.struct("_nth", "m"))).alias("l"))
    both = listed.join(told.select(F.col("id").alias("new_id"), F.col("m").alias("new")), "new_id")
    notes = F.transform("l", lambda x: x["m"])
    return both.select("new_id", F.transform(notes, lambda m: m["id"]).alias("allowed"), text.pretty_json(F.struct(F.col("new").alias("new_note"), notes.alias("neighbours"))).alias("prompt"))


def purge(tables: Tables, now_s: int) -> dict[str, DataFrame]:
    """The scheduled job: memory and observations without what garbage collection removes; contradicted memories are no longer latest."""
    todo = maintain.to_forget(tables["memory"], tables["observation"], now_s)
    ids = lambda *actions: todo.where(F.col("action").isin(*actions)).select("id").distinct()
    old = ids("contradicted").withColumn("_old", F.lit(True))
    memory = tables["memory"].join(ids("expired", "weak"), "id", "left_anti").join(old, "id", "left")
    memory = memory.withColumn("is_latest", F.col("is_latest") & F.col("_old").isNull()).drop("_old")
    return {"memory": memory, "observation": tables["observation"].join(ids("stale"), "id", "left_anti")}
