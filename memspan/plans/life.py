"""Life cycle and maintenance of sessions, runs, commits, plans and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.functions import scores
from memspan.operators import lifecycle as L
from memspan.operators import maintain as M
from memspan.operators import plans as P
from memspan.plans.book import Book, r6
from memspan.plans.graphs import tagged
from memspan.plans.lens import NOW, Lens

BOOK = Book()
SIX_HOURS_US = 21_600_000_000


@BOOK.add(
    "ttl_dedup",
    f"""WITH RECURSIVE keyed AS (SELECT event_id AS id, ts_us, CAST(user_id AS VARCHAR) || ':' || event_type AS key FROM ev),
        o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us, id) AS i FROM keyed),
        f AS (SELECT key, i, id, ts_us AS last, TRUE AS kept FROM o WHERE i = 1 UNION ALL
              SELECT o.key, o.i, o.id, CASE WHEN o.ts_us - f.last >= {SIX_HOURS_US} THEN o.ts_us ELSE f.last END, o.ts_us - f.last >= {SIX_HOURS_US} FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1)
        SELECT id, key FROM f WHERE kept""",
)
def _(t: Lens) -> DataFrame:
    keyed = t.ev.select(F.col("event_id").alias("id"), "ts_us", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"))
    return L.ttl_dedup(keyed, "key", "ts_us", "id", SIX_HOURS_US).select("id", "key")


_NUMBERED = """SELECT *, CASE WHEN (was AND NOT closes) OR starts THEN sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_us, id) END AS run_no FROM (
  SELECT *, opens AND NOT was AS starts FROM (
    SELECT *, coalesce(last_value(CASE WHEN opens THEN 1 WHEN closes THEN 0 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was FROM (
      SELECT id, session_id, ts_us, title, importance, obs_type, obs_type = 'conversation' AS opens, obs_type = 'task' AS closes FROM observation)))"""


def _numbered(t: Lens) -> DataFrame:
    rows = t.observation.select("id", "session_id", "ts_us", "title", "importance", "obs_type")
    kind = F.col("obs_type")
    return L.run_numbers(rows, "session_id", ["ts_us", "id"], kind == "conversation", kind == "task")


@BOOK.add("run_sessionize", f"SELECT id, session_id, CAST(run_no AS BIGINT) AS run_no FROM ({_NUMBERED}) WHERE run_no IS NOT NULL")
def _(t: Lens) -> DataFrame:
    return _numbered(t).where("run_no is not null").select("id", "session_id", "run_no")


@BOOK.add(
    "run_outcome",
    f"SELECT session_id, CAST(run_no AS BIGINT) AS run_no, count(*) AS observations, CASE WHEN bool_or(id % 10 = 0) THEN 'committed' WHEN bool_or(obs_type IN ('file_write', 'file_edit')) THEN 'uncommitted' ELSE 'success' END AS outcome FROM ({_NUMBERED}) WHERE run_no IS NOT NULL GROUP BY session_id, run_no",
)
def _(t: Lens) -> DataFrame:
    grouped = _numbered(t).where("run_no is not null").groupBy("session_id", "run_no")
    flags = grouped.agg(F.count(F.lit(1)).alias("observations"), F.bool_or(F.col("id") % 10 == 0).alias("c"), F.bool_or(F.col("obs_type").isin("file_write", "file_edit")).alias("w"))
    return flags.select("session_id", "run_no", "observations", L.outcome(F.col("c"), F.col("w")).alias("outcome"))


@BOOK.add(
    "run_lesson",
    f"SELECT session_id, CAST(run_no AS BIGINT) AS run_no, string_agg(title, ' · ' ORDER BY nth) AS lesson FROM (SELECT *, row_number() OVER (PARTITION BY session_id, run_no ORDER BY importance DESC, ts_us, id) AS nth FROM ({_NUMBERED}) WHERE run_no IS NOT NULL) WHERE nth <= 5 GROUP BY session_id, run_no",
)
def _(t: Lens) -> DataFrame:
    inside = _numbered(t).where("run_no is not null")
    return L.joined_top(inside, ["session_id", "run_no"], "title", [F.desc("importance"), F.col("ts_us"), F.col("id")], 5, " · ", "lesson")


@BOOK.add(
    "session_summary",
    "SELECT session_id, string_agg(CASE WHEN nth <= 5 THEN narrative END, ' ' ORDER BY nth) AS narrative, string_agg(CASE WHEN nth <= 5 THEN title END, ';' ORDER BY nth) AS decisions, count(DISTINCT file) AS files FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, ts_us, id) AS nth FROM observation) WHERE nth <= 10 GROUP BY session_id",
)
def _(t: Lens) -> DataFrame:
    order = [F.desc("importance"), F.col("ts_us"), F.col("id")]
    ten = L.joined_top(t.observation, ["session_id"], "file", order, 10, ",", "files")
    told = L.joined_top(t.observation, ["session_id"], "narrative", order, 5, " ", "narrative")
    decided = L.joined_top(t.observation, ["session_id"], "title", order, 5, ";", "decisions")
    return told.join(decided, "session_id").join(ten, "session_id").select("session_id", "narrative", "decisions", F.size(F.array_distinct(F.split("files", ","))).cast("long").alias("files"))


@BOOK.add(
    "session_name",
    f"""WITH p AS (SELECT session_id * 3 AS id, arg_min(prompt, started_s * 100000 + id) AS prompt FROM run GROUP BY session_id), b AS (SELECT session_id AS id, arg_min(title, -importance * 1000000000000000000::HUGEINT + ts_us::HUGEINT) AS title FROM observation WHERE obs_type <> 'conversation' AND session_id % 2 = 0 GROUP BY session_id)
        SELECT s.id, CASE WHEN length(trim(p.prompt)) > 80 THEN (CASE WHEN length(regexp_extract(substring(trim(p.prompt), 1, 80), '(?s)^(.*)\\s', 1)) > 40 THEN regexp_extract(substring(trim(p.prompt), 1, 80), '(?s)^(.*)\\s', 1) ELSE substring(trim(p.prompt), 1, 80) END) || '…'
               WHEN length(trim(p.prompt)) > 5 THEN trim(p.prompt) WHEN length(trim(b.title)) > 3 THEN trim(b.title) ELSE 'app — ' || strftime(make_timestamp({NOW}000000), '%b %d') END AS name
        FROM session s LEFT JOIN p ON p.id = s.id LEFT JOIN b ON b.id = s.id""",
)
def _(t: Lens) -> DataFrame:
    runs = t.run.withColumn("session_id", F.col("session_id") * 3)
    sessions = t.session.select("id", F.lit("/home/dev/app").alias("project"))
    return L.session_names(sessions, runs, t.observation.where("session_id % 2 = 0"), NOW)


@BOOK.add(
    "open_run_asof",
    "WITH p AS (SELECT id, session_id % 20 AS session_id, 1717100000 + id * 37 AS at_s FROM observation) SELECT id, CASE WHEN ended_s IS NULL OR at_s < ended_s THEN run_id END AS span_id FROM (SELECT p.id, p.at_s, r.id AS run_id, r.ended_s, row_number() OVER (PARTITION BY p.id ORDER BY r.started_s DESC, r.id DESC) AS nth FROM p LEFT JOIN run r ON r.session_id = p.session_id AND r.started_s <= p.at_s) WHERE nth = 1",
)
def _(t: Lens) -> DataFrame:
    points = t.observation.select("id", (F.col("session_id") % 20).alias("session_id"), (F.lit(1_717_100_000) + F.col("id") * 37).alias("at_s"))
    return L.open_at(points, t.run.select("id", "session_id", "started_s", "ended_s"), "session_id", "at_s")


@BOOK.add("active_plan", "SELECT project, id, title FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY weight DESC, id) AS nth FROM plan WHERE status = 'active') WHERE nth = 1")
def _(t: Lens) -> DataFrame:
    return L.latest(t.plan.where("status = 'active'"), ["project"], [F.desc("weight"), F.col("id")]).select("project", "id", "title")


@BOOK.add(
    "plan_coverage",
    "WITH p AS (SELECT DISTINCT plan_id, file FROM plan_files), z AS (SELECT plan_id, count(*) AS n FROM p GROUP BY plan_id) SELECT p.plan_id, c.commit_id, round(count(*) / max(z.n)::DOUBLE, 6) AS coverage FROM p JOIN commit_files c ON p.file = c.file JOIN z ON z.plan_id = p.plan_id GROUP BY p.plan_id, c.commit_id HAVING count(*) / max(z.n)::DOUBLE >= 0.8",
)
def _(t: Lens) -> DataFrame:
    return L.covered(t.plan_files, t.commit_files).withColumn("coverage", r6(F.col("coverage")))


@BOOK.add(
    "commit_file_overlap",
    "SELECT p.plan_id, count(DISTINCT c.commit_id) AS commits FROM plan_files p JOIN commit_files c ON p.file = c.file GROUP BY p.plan_id",
)
def _(t: Lens) -> DataFrame:
    return L.overlapping(t.plan_files, t.commit_files)


@BOOK.add(
    "uncommitted_decay",
    f"""WITH m AS (SELECT id, 'proj' || CAST(id % 5 AS VARCHAR) AS project, unnest(['src/m' || CAST(id % 20 AS VARCHAR) || '.rs', 'x']) AS file FROM memory), w AS (SELECT DISTINCT project, file FROM observation WHERE obs_type = 'file_edit' AND id % 3 = 0), c AS (SELECT DISTINCT project, file FROM observation WHERE obs_type = 'task' AND id % 40 = 1)
        SELECT DISTINCT id, CAST({NOW} + 60 * 86400 AS BIGINT) AS forget_s FROM m WHERE (project, file) IN (SELECT project, file FROM w) AND id NOT IN (SELECT id FROM m WHERE (project, file) IN (SELECT project, file FROM c))""",
)
def _(t: Lens) -> DataFrame:
    memory = t.memory.select("id", F.concat(F.lit("proj"), (F.col("id") % 5).cast("string")).alias("project"), F.array(F.concat(F.lit("src/m"), (F.col("id") % 20).cast("string"), F.lit(".rs")), F.lit("x")).alias("files"))
    return L.uncommitted_decay(memory, t.observation.where("obs_type = 'file_edit' and id % 3 = 0"), t.observation.where("obs_type = 'task' and id % 40 = 1"), NOW)


@BOOK.add(
    "entity_upsert",
    "SELECT kind, name, project, count(*) AS n, min(at_s) AS first_s, max(at_s) AS last_s FROM (SELECT 'file' AS kind, file AS name, project, at_s FROM observation UNION ALL SELECT 'concept', lower(kw1), project, at_s FROM observation UNION ALL SELECT 'concept', lower(kw2), project, at_s FROM observation) GROUP BY kind, name, project",
)
def _(t: Lens) -> DataFrame:
    return L.entities(t.observation.select("project", "at_s", F.array("file").alias("files"), F.array("kw1", "kw2").alias("keywords")))




@BOOK.add("core_array_edit", "SELECT r_name AS project, CASE WHEN r_name = 'ASIA' THEN 'a,b,ship' ELSE 'a,b' END AS goals, CASE WHEN r_name = 'ASIA' THEN 'y' ELSE 'x,y' END AS watchlist FROM region")
def _(t: Lens) -> DataFrame:
    core = t.region.select(F.col("r_name").alias("project"), F.array(F.lit("a"), F.lit("b")).alias("goals"), F.array(F.lit("x"), F.lit("y")).alias("watchlist"))
    for field, op, value in (("goals", "add", "ship"), ("goals", "add", "ship"), ("watchlist", "remove", "x")):
        core = L.edit_core(core, "ASIA", field, op, value)
    return core.select("project", F.array_join("goals", ",").alias("goals"), F.array_join("watchlist", ",").alias("watchlist"))


@BOOK.add("supersede", "SELECT id, id % 11 <> 0 AND id % 17 <> 3 AS is_latest, CASE WHEN id % 17 = 3 THEN id + 1 END AS superseded_by, CASE WHEN id % 17 = 4 THEN CAST(id - 1 AS VARCHAR) ELSE '' END AS supersedes FROM memory")
def _(t: Lens) -> DataFrame:
    newer = t.memory.where("id % 17 = 3").select((F.col("id") + 1).alias("id"), F.col("id").alias("older"))
    after = M.superseded(t.memory.select("id", "is_latest"), newer)
    return after.select("id", "is_latest", "superseded_by", F.array_join(F.col("supersedes").cast("array<string>"), ",").alias("supersedes"))


@BOOK.add("ttl_expired", f"SELECT id FROM memory WHERE forget_s IS NOT NULL AND forget_s < {NOW}")
def _(t: Lens) -> DataFrame:
    return t.memory.where(F.col("forget_s") < NOW).select("id")


@BOOK.add("weak_memories", "SELECT id FROM memory WHERE strength < 0.1")
def _(t: Lens) -> DataFrame:
    return t.memory.where("strength < 0.1").select("id")


@BOOK.add("low_value_obs", f"SELECT id FROM observation WHERE importance <= 2 AND at_s < {NOW} - 140 * 86400")
def _(t: Lens) -> DataFrame:
    # Asked 40 days later, when rows of 140 days before are 180 days old.
    return M.to_forget(tagged(t).join(t.memory.select("id", "is_latest", "forget_s", "strength"), "id"), t.observation, NOW + 40 * scores.DAY).where("action = 'stale'").select("id")


_RECENT = "SELECT * FROM memory ORDER BY created_s DESC, id LIMIT {}"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(trim(content)), '\s+'), lambda w: strlen(w) > 2))"


@BOOK.add(
    "contradictions",
    f"""WITH r AS (SELECT id, created_s, kw1, kw2, kw3, {_WORDS} AS w FROM ({_RECENT.format(300)})),
        k AS (SELECT id, unnest([lower(kw1), lower(kw2), lower(kw3)]) AS x FROM r), p AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM k a JOIN k b ON a.x = b.x AND a.id < b.id),
        j AS (SELECT a.id AS src, b.id AS dst, a.created_s AS ta, b.created_s AS tb, len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.w, b.w)))) AS j FROM p JOIN r a ON p.src = a.id JOIN r b ON p.dst = b.id)
        SELECT CASE WHEN ta >= tb THEN src ELSE dst END AS newer, CASE WHEN ta >= tb THEN dst ELSE src END AS older, round(j, 6) AS jaccard FROM j WHERE j >= 0.9""",
)
def _(t: Lens) -> DataFrame:
    return M.contradictions(tagged(t), 0.9, 300).withColumn("jaccard", r6(F.col("jaccard")))


@BOOK.add("reflect_stop_keywords", "SELECT keyword, count(*) AS df FROM (SELECT unnest([kw1, kw2, kw3]) AS keyword FROM memory) GROUP BY keyword HAVING count(*) > (SELECT count(*) // 2 FROM memory)")
def _(t: Lens) -> DataFrame:
    return M.stop_keywords(tagged(t))


@BOOK.add(
    "reflect_pairs",
    f"WITH k AS (SELECT id, unnest([kw1, kw2, kw3]) AS w FROM ({_RECENT.format(100)})) SELECT a.id AS src, b.id AS dst, round(count(*) / (6.0::DOUBLE - count(*)), 6) AS jaccard FROM k a JOIN k b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / (6.0::DOUBLE - count(*)) >= 0.4",
)
def _(t: Lens) -> DataFrame:
    from memspan.operators.graph import shared_tokens

    recent = tagged(t).orderBy(F.desc("created_s"), "id").limit(100)
    return shared_tokens(recent, "keywords", 0.4, digits=6)


@BOOK.add(
    "reflect_clusters",
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (ORDER BY created_s DESC, id) AS pos FROM ({_RECENT.format(100)})), k AS (SELECT pos, unnest([kw1, kw2, kw3]) AS w FROM r),
        s AS (SELECT w FROM k GROUP BY w HAVING count(*) > (SELECT count(*) // 2 FROM r)), q AS (SELECT pos, w FROM k WHERE w NOT IN (SELECT w FROM s)), z AS (SELECT pos, count(*) AS n FROM q GROUP BY pos),
        p AS (SELECT a, list(b ORDER BY b) AS near FROM (SELECT x.pos AS a, y.pos AS b, count(*) AS c FROM q x JOIN q y ON x.w = y.w AND x.pos < y.pos GROUP BY x.pos, y.pos) JOIN z za ON za.pos = a JOIN z zb ON zb.pos = b WHERE c / (za.n + zb.n - c)::DOUBLE >= 0.2 GROUP BY a),
        g AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS taken, []::BIGINT[] AS found UNION ALL
              SELECT m.pos, CASE WHEN m.ok THEN list_concat(m.taken, m.members) ELSE m.taken END, CASE WHEN m.ok THEN m.members ELSE []::BIGINT[] END FROM (SELECT *, NOT list_contains(taken, pos) AND len(members) >= 3 AS ok FROM (
                SELECT g.pos + 1 AS pos, g.taken, list_concat([g.pos + 1], list_filter(coalesce(p.near, []::BIGINT[]), lambda x: NOT list_contains(g.taken, x))) AS members FROM g LEFT JOIN p ON p.a = g.pos + 1 WHERE g.pos < (SELECT count(*) FROM r))) m)
        SELECT c.id AS cluster, m.id FROM (SELECT pos, unnest(found) AS member FROM g) u JOIN r c ON c.pos = u.pos JOIN r m ON m.pos = u.member""",
)
def _(t: Lens) -> DataFrame:
    return M.clusters(tagged(t), least=0.2)


@BOOK.add(
    "commit_strengthen",
    "WITH hit AS (SELECT DISTINCT m.id FROM (SELECT id, 'src/p' || CAST(id % 300 AS VARCHAR) AS file FROM memory) m JOIN commit_files c ON m.file = c.file) SELECT m.id, round(CASE WHEN h.id IS NULL THEN strength ELSE least(strength * 1.15::DOUBLE, 1.0::DOUBLE) END, 6) AS strength FROM memory m LEFT JOIN hit h ON m.id = h.id",
)
def _(t: Lens) -> DataFrame:
    memory = t.memory.select("id", F.lit("p").alias("project"), "strength", F.array(F.concat(F.lit("src/p"), (F.col("id") % 300).cast("string"))).alias("files"))
    commits = t.commit_files.groupBy("commit_id").agg(F.collect_list("file").alias("files")).withColumn("project", F.lit("p"))
    return L.strengthened_by(memory, commits).select("id", r6(F.col("strength")).alias("strength"))


@BOOK.add("session_ensure", "SELECT user_id AS id, arg_min(event_type, ts_us) AS first_type, min(ts_us) AS started_us FROM ev GROUP BY user_id")
def _(t: Lens) -> DataFrame:
    return t.ev.groupBy(F.col("user_id").alias("id")).agg(F.min_by("event_type", "ts_us").alias("first_type"), F.min("ts_us").alias("started_us"))


@BOOK.add("plan_complete", "SELECT id, CASE WHEN status = 'active' AND id % 5 = 0 THEN 'completed' ELSE status END AS status FROM plan")
def _(t: Lens) -> DataFrame:
    return P.status_set(t.plan.select("id", "status"), t.plan.where("status = 'active' and id % 5 = 0"), "completed")


@BOOK.add("reindex_missing", "SELECT d.doc_id AS id FROM documents d WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(t: Lens) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id")).join(t.embeddings.select(F.col("vec_id").alias("id")), "id", "left_anti")


@BOOK.add("stream_session_counts", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY user_id")
def _(t: Lens) -> DataFrame:
    from memspan.streaming.hooks import session_counts

    return session_counts(t.events).select("user_id", "n", F.round("total", 4).alias("total"))


@BOOK.add("stream_window_counts", "SELECT CAST(floor(ts_us / 3600000000) AS BIGINT) AS hour, event_type, count(*) AS n FROM ev GROUP BY hour, event_type")
def _(t: Lens) -> DataFrame:
    from memspan.streaming.hooks import late_windows

    rows = late_windows(t.ev.withColumn("ts", F.timestamp_micros("ts_us")), "ts")
    return rows.select(F.floor(F.unix_seconds("start") / 3600).cast("long").alias("hour"), "event_type", "n")
