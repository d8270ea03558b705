"""Plans, core memory, commits, and further edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.operators import graph, models
from memspan.operators import plans as P
from memspan.operators import provenance as V
from memspan.operators import retrieval as R
from memspan.plans.book import Book, r6
from memspan.operators.lifecycle import open_at
from memspan.plans.graphs import OPEN_SQL, runs_with_recall, tagged
from memspan.plans.lens import NOW, Lens
from memspan.plans.searches import QUERY, index_of, memories_sql

BOOK = Book()


@BOOK.add("plan_upsert", "SELECT id, CASE WHEN id % 3 = 0 THEN title || ' v2' ELSE title END AS title, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS version FROM plan UNION ALL SELECT id + 100000, title || ' new', 2 FROM plan WHERE id % 10 = 0")
def _(t: Lens) -> DataFrame:
    old = t.plan.select("id", "title", F.lit(1).alias("version"))
    new = t.plan.where("id % 3 = 0").select("id", F.concat("title", F.lit(" v2")).alias("title"), F.lit(2).alias("version"))
    fresh = t.plan.where("id % 10 = 0").select((F.col("id") + 100_000).alias("id"), F.concat("title", F.lit(" new")).alias("title"), F.lit(2).alias("version"))
    return P.upsert(old, new.unionByName(fresh), ["id"], "version")


@BOOK.add("plan_abandon", "SELECT id, CASE WHEN id % 7 = 0 THEN 'abandoned' ELSE status END AS status FROM plan")
def _(t: Lens) -> DataFrame:
    return P.status_set(t.plan.select("id", "status"), t.plan.where("id % 7 = 0"), "abandoned")


_ACTIVE = "SELECT p.project, p.title, f.file FROM plan p JOIN plan_files f ON f.plan_id = p.id WHERE p.status = 'active' AND p.id % 6 = 1"


@BOOK.add(
    "plan_activate_core",
    f"""WITH a AS ({_ACTIVE}), g AS (SELECT project, string_agg(title, ';' ORDER BY title) AS goals FROM (SELECT DISTINCT project, '📋 ' || title AS title FROM a) GROUP BY project), w AS (SELECT project, string_agg(file, ';' ORDER BY file) AS files FROM (SELECT DISTINCT project, file FROM a) GROUP BY project),
        c AS (SELECT DISTINCT project FROM plan) SELECT c.project, 'ship' || coalesce(';' || g.goals, '') AS goals, coalesce(w.files, '') AS watchlist FROM c LEFT JOIN g ON c.project = g.project LEFT JOIN w ON c.project = w.project""",
)
def _(t: Lens) -> DataFrame:
    files = t.plan_files.groupBy(F.col("plan_id").alias("id")).agg(F.collect_set("file").alias("files"))
    active = t.plan.where("status = 'active' and id % 6 = 1").join(files, "id")
    core = t.plan.select("project").distinct().select("project", F.array(F.lit("ship")).alias("goals"), F.array().cast("array<string>").alias("watchlist"))
    return P.core_synced(core, active, "add").select("project", F.array_join("goals", ";").alias("goals"), F.array_join("watchlist", ";").alias("watchlist"))


@BOOK.add(
    "core_render",
    "SELECT r_name AS project, CASE WHEN r_regionkey = 0 THEN '' ELSE '# Core' || chr(10) || chr(10) || '**Identity:** ' || r_name || chr(10) || '**Goals:**' || chr(10) || '- a' || chr(10) || CASE WHEN r_regionkey > 2 THEN '**Watchlist:**' || chr(10) || '- f' || chr(10) ELSE '' END || chr(10) END AS block FROM region",
)
def _(t: Lens) -> DataFrame:
    set_ = F.col("r_regionkey") > 0
    none = F.array().cast("array<string>")
    block = P.rendered(F.when(set_, F.col("r_name")), F.when(set_, F.array(F.lit("a"))), none, F.when(F.col("r_regionkey") > 2, F.array(F.lit("f"))))
    return t.region.select(F.col("r_name").alias("project"), block.alias("block"))


@BOOK.add(
    "record_commit",
    f"""WITH c AS (SELECT id, id // 2 AS sha, id % 20 AS session_id, {NOW} - 100000 + id % 90000 AS at_s FROM commits), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY at_s, id) AS nth FROM c) WHERE nth = 1),
        z AS (SELECT commit_id, count(DISTINCT file) AS files FROM commit_files GROUP BY commit_id),
        o AS (SELECT * FROM (SELECT f.id, r.id AS run_id, r.ended_s, f.at_s, row_number() OVER (PARTITION BY f.id ORDER BY r.started_s DESC, r.id DESC) AS nth FROM f JOIN run r ON r.session_id = f.session_id AND r.started_s <= f.at_s) WHERE nth = 1)
        SELECT f.id, f.sha, coalesce(z.files, 0) AS files, CASE WHEN o.ended_s IS NULL OR o.at_s < o.ended_s THEN o.run_id END AS run_id FROM f LEFT JOIN z ON z.commit_id = f.id LEFT JOIN o ON o.id = f.id""",
)
def _(t: Lens) -> DataFrame:
    commits = t.commits.select("id", F.floor(F.col("id") / 2).alias("sha"), (F.col("id") % 20).alias("session_id"), (F.lit(NOW - 100_000) + F.col("id") % 90_000).alias("at_s"))
    return P.recorded(commits, t.commit_files, t.run.select("id", "session_id", "started_s", "ended_s")).select("id", "sha", "files", "run_id")


_COMMITS = f"SELECT id, id % 20 AS session_id, {NOW} - 100000 + id % 90000 AS at_s FROM commits"


@BOOK.add(
    "commit_edges",
    f"""WITH o AS (SELECT id, run_id FROM ({OPEN_SQL.format(_COMMITS)}) WHERE run_id IS NOT NULL) SELECT 'commit:' || CAST(id AS VARCHAR) AS src, 'run:' || CAST(run_id AS VARCHAR) AS dst, 'generated_by' AS relation FROM o
        UNION ALL SELECT 'plan:' || CAST(run_id % 10 AS VARCHAR), 'commit:' || CAST(id AS VARCHAR), 'implemented_by' FROM o""",
)
def _(t: Lens) -> DataFrame:
    commits = t.commits.select("id", (F.col("id") % 20).alias("session_id"), (F.lit(NOW - 100_000) + F.col("id") % 90_000).alias("at_s"))
    runs = runs_with_recall(t)
    opened = open_at(commits, runs, "session_id", "at_s").withColumnRenamed("span_id", "run_id")
    return V.commit_edges(opened, runs).select("src", "dst", "relation")


@BOOK.add("informed_edges", f"SELECT 'memory:' || CAST(x.id AS VARCHAR) AS src, 'run:' || CAST(r.id AS VARCHAR) AS dst, 'informed' AS relation, round(x.score, 6) AS edge_score FROM {memories_sql(QUERY, 20)} AS x JOIN (SELECT id FROM run WHERE ended_s IS NULL ORDER BY started_s DESC, id LIMIT 1) AS r ON TRUE")
def _(t: Lens) -> DataFrame:
    hits = R.search_memories(t.memory, index_of(t, "memory"), QUERY, 20, NOW).select("id", "score")
    newest = t.run.where("ended_s is null").orderBy(F.desc("started_s"), "id").limit(1).select("id").scalar()
    return V.informed_edges(hits, newest).select("src", "dst", "relation", r6(F.col("edge_score")).alias("edge_score"))


@BOOK.add("motivated_edges", "SELECT 'memory:' || CAST(r.id * 3 + i AS VARCHAR) AS src, 'plan:' || CAST(p.id AS VARCHAR) AS dst, 'motivated' AS relation, 0.7::DOUBLE AS edge_score FROM plan p JOIN run r ON r.id = p.id * 2, (VALUES (0), (1)) AS v(i)")
def _(t: Lens) -> DataFrame:
    return V.motivated_edges(t.plan.select("id", (F.col("id") * 2).alias("run_id")), runs_with_recall(t)).select("src", "dst", "relation", "edge_score")


@BOOK.add("fetch_edges", "SELECT src, dst, relation, edge_score FROM edge WHERE (src IN (3, 5, 8) OR dst IN (3, 5, 8)) AND relation IN ('similar_to', 'mentions') AND edge_score >= 0.3")
def _(t: Lens) -> DataFrame:
    return graph.fetched(t.edge, t.memory.where("id in (3, 5, 8)").select("id"), "both", ["similar_to", "mentions"], 0.3).select("src", "dst", "relation", "edge_score")


@BOOK.add("evolve_apply", "SELECT id, CASE WHEN id % 10 = 0 THEN array_to_string([kw2, kw3, 'evolved'], ',') ELSE array_to_string([kw1, kw2, kw3], ',') END AS keywords, is_latest AND NOT id % 20 = 0 AS is_latest FROM memory")
def _(t: Lens) -> DataFrame:
    memory = tagged(t).join(t.memory.select("id", "is_latest", "kw1"), "id").withColumns({"tags": F.array().cast("array<string>"), "context": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("long")})
    ids = F.array((F.col("id")).cast("string"))
    update = F.concat(F.lit('Sure {"neighbour_updates":[{"id":"'), F.col("id").cast("string"), F.lit('","keywords_add":["evolved"],"keywords_remove":["'), "kw1", F.lit('"],"superseded_by_new":'), (F.col("id") % 20 == 0).cast("string"), F.lit("}]}"))
    replies = t.memory.where("id % 10 = 0").select((F.col("id") + 1).alias("new_id"), ids.alias("allowed"), update.alias("reply"))
    updates = models.evolution(replies).withColumn("id", F.col("id").cast("long"))
    after, _ = models.evolve(memory, updates)
    return after.select("id", F.array_join("keywords", ",").alias("keywords"), "is_latest")


@BOOK.add("embed_reindex", "SELECT m.id, 64 AS size, v.embedding IS NOT NULL AS kept, 1.0::DOUBLE AS norm FROM memory m LEFT JOIN (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id % 2 = 0) v ON v.id = m.id")
def _(t: Lens) -> DataFrame:
    old = t.embeddings.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), "embedding", F.col("embedding").alias("old"))
    body = models.embed_text(F.col("title"), F.col("content"), F.array("kw1", "kw2", "kw3"), F.array("f1", "f2"))
    rows = t.memory.select("id", body.alias("body")).join(old, "id", "left")
    made = models.embedded(rows, "body")
    unit = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    kept = F.col("old").isNotNull() & (F.col("embedding") == F.col("old"))
    return made.select("id", F.size("embedding").alias("size"), kept.alias("kept"), F.when(kept, 1.0).otherwise(F.round(unit, 4)).alias("norm"))


@BOOK.add("entity_links", "WITH k AS (SELECT id, project, unnest([kw1, kw2, kw3, f1, f2]) AS w FROM memory) SELECT a.id AS src, b.id AS dst, round(count(*) / (10.0::DOUBLE - count(*)), 6) AS edge_score FROM k a JOIN k b ON a.w = b.w AND a.project = b.project AND a.id <> b.id AND a.id % 50 = 0 AND (b.id % 50 <> 0 OR a.id < b.id) GROUP BY a.id, b.id")
def _(t: Lens) -> DataFrame:
    items = tagged(t).select("id", "project", F.concat("keywords", "files").alias("entities"))
    new, old = items.where("id % 50 = 0"), items.where("id % 50 <> 0")
    return graph.tokens_shared_with(new, old, "entities", "project", digits=6).withColumnRenamed("jaccard", "edge_score")
