"""Whole steps and indexes over whole tables: ingest, searches that skip, changes of an index, nearest vectors by cells, edges by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.functions import registered
from memspan.operators import pipelines
from memspan.operators import retrieval as R
from memspan.operators.adjacency import Adjacency
from memspan.operators.textindex import TextIndex
from memspan.operators.vectorindex import VectorIndex
from memspan.plans.base import _COMMAND, _OUTPUT, _TOOL
from memspan.plans import graphs, more
from memspan.plans.book import Book, r6
from memspan.plans.lens import NOW, Lens
from memspan.plans.searches import _COS, LIMIT, QUERY, bm25_sql, index_of, shown
from memspan.sources import schemas

BOOK = Book()
FIVE_DAYS_US = 432_000_000_000
_VECTORS: dict[tuple[str, str], VectorIndex] = {}
_EDGES: dict[tuple[str, str], Adjacency] = {}


def vectors_of(t: Lens) -> VectorIndex:
    """The index of the embeddings, built once for a session and folder."""
    key = (t._spark.sparkContext.applicationId, t._dir)
    if key not in _VECTORS:
        _VECTORS[key] = VectorIndex.build(t.embeddings, "vec_id", keep=["label"])
    return _VECTORS[key]


def edges_of(t: Lens) -> Adjacency:
    """The adjacency store of the edges, built once for a session and folder."""
    key = (t._spark.sparkContext.applicationId, t._dir)
    if key not in _EDGES:
        _EDGES[key] = Adjacency.build(t.edge)
    return _EDGES[key]


#: A run's events, those of them that dedup keeps (each hides its key's repeats for five days), and the run's end and outcome.
OBSERVE_SQL = rf"""WITH RECURSIVE h AS (SELECT id, session_id, ts_us, hook, {_TOOL} AS tool, {_COMMAND} AS c, {_OUTPUT} AS o,
         CAST(session_id AS VARCHAR) || ':' || {_TOOL} || ':' || substring(CAST(json_extract(data, '$.tool_input') AS VARCHAR), 1, 500) AS key FROM hook),
    o AS (SELECT id, ts_us, key, row_number() OVER (PARTITION BY key ORDER BY ts_us, id) AS i FROM h),
    f AS (SELECT key, i, id, ts_us AS last, TRUE AS kept FROM o WHERE i = 1 UNION ALL
          SELECT o.key, o.i, o.id, CASE WHEN o.ts_us - f.last >= {FIVE_DAYS_US} THEN o.ts_us ELSE f.last END, o.ts_us - f.last >= {FIVE_DAYS_US} FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1),
    w AS (SELECT *, coalesce(last_value(CASE hook WHEN 'prompt_submit' THEN 1 WHEN 'task_completed' THEN 0 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was FROM h),
    s AS (SELECT *, sum(CASE WHEN hook = 'prompt_submit' AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_us, id) AS no FROM w),
    r AS (SELECT *, CASE WHEN (was AND hook <> 'task_completed') OR (hook = 'prompt_submit' AND NOT was) THEN no END AS run_no FROM s),
    e AS (SELECT session_id, no, min(ts_us) AS ended FROM r WHERE hook = 'task_completed' AND no > 0 GROUP BY session_id, no),
    g AS (SELECT r.session_id, r.run_no, min(r.ts_us) AS started, count(*) FILTER (WHERE r.hook = 'prompt_submit') AS prompts, count(k.id) AS observations,
            coalesce(bool_or(k.id IS NOT NULL AND r.tool = 'Bash' AND (r.c LIKE 'git add . && git commit%' OR r.c = 'git -p commit; ls')
              AND len(list_filter(list_transform(string_split(r.o, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^\[\S+(\s[^\]]*)?\s[0-9a-fA-F]{{7,}}\s*\]'))) > 0), FALSE) AS c,
            coalesce(bool_or(k.id IS NOT NULL AND r.tool IN ('Write', 'Edit')), FALSE) AS w
          FROM r LEFT JOIN (SELECT id FROM f WHERE kept) k ON k.id = r.id WHERE r.run_no IS NOT NULL GROUP BY r.session_id, r.run_no)
    SELECT g.session_id, CAST(floor(g.started / 1000000) AS BIGINT) AS started_s, CAST(floor(e.ended / 1000000) AS BIGINT) AS ended_s, g.prompts, g.observations,
           CASE WHEN e.ended IS NULL THEN 'unknown' WHEN g.c THEN 'committed' WHEN g.w THEN 'uncommitted' ELSE 'success' END AS outcome
    FROM g LEFT JOIN e ON e.session_id = g.session_id AND e.no = g.run_no"""


@BOOK.add("observe_step", OBSERVE_SQL)
def _(t: Lens) -> DataFrame:
    tables = {name: schemas.empty(t._spark, name) for name in schemas.SCHEMAS}
    events = t.hook.select("id", "session_id", "project", "ts_us", "hook", "data")
    runs = pipelines.observe(tables, events, NOW, FIVE_DAYS_US)["run"]
    return runs.select("session_id", "started_s", "ended_s", F.size("prompts").cast("long").alias("prompts"), F.size("observation_ids").cast("long").alias("observations"), "outcome")


@BOOK.add("bm25_skipping", f"SELECT id, round(score, 6) AS score FROM {bm25_sql('memory', 'content', QUERY)} ORDER BY score DESC, id LIMIT {LIMIT}")
def _(t: Lens) -> DataFrame:
    return shown(index_of(t, "memory").top("content", QUERY, LIMIT, read_all=0))


_CHANGED = "(SELECT * FROM (SELECT id, CASE WHEN id % 10 = 1 THEN title || ' tion once more' ELSE title END AS title FROM memory) WHERE id % 10 <> 0)"


@BOOK.add("index_changed", f"WITH changed AS {_CHANGED} SELECT id, round(score, 6) AS score FROM {bm25_sql('changed', 'title', QUERY)}")
def _(t: Lens) -> DataFrame:
    """A tenth of all titles deleted and another tenth changed, after the index was built."""
    index = TextIndex.build(t.memory.select("id", "title"), "id", ["title"])
    gone = t.memory.where("id % 10 < 2").select("id", "title")
    new = t.memory.where("id % 10 = 1").select("id", F.concat("title", F.lit(" tion once more")).alias("title"))
    return shown(index.changed(gone, new).bm25("title", QUERY))


@BOOK.add(
    "knn_indexed",
    f"""SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM (SELECT vec_id, embedding AS a FROM embeddings WHERE embedding IS NOT NULL) e, (SELECT vec_id, embedding AS b FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL) q)) WHERE rank <= 10""",
)
def _(t: Lens) -> DataFrame:
    """The ten nearest rows of every vector whose id is divisible by 100, by the index, exactly."""
    asked = t.embeddings.where("vec_id % 100 = 0 and embedding is not null").select("vec_id", "embedding")
    window = R.Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = vectors_of(t).nearest_join(asked, 10, "vec_id")
    return found.select(F.col("query").alias("query_id"), "id", F.row_number().over(window).cast("long").alias("rank"))


@BOOK.add(
    "sql_functions",
    "SELECT id, round(least(strength * 1.15::DOUBLE, 1.0::DOUBLE), 6) AS stronger, strlen(content) // 4 AS tokens, round(strength * exp(-(id % 90)::DOUBLE / 30) * (1 + 0.1::DOUBLE * least(greatest(retrieval_count, 0), 20)), 6) AS boosted, CASE WHEN category = kw2 THEN 1.0::DOUBLE WHEN category = kw3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS alike FROM memory",
)
def _(t: Lens) -> DataFrame:
    registered.register(t._spark)
    told = ["id", "round(strengthened(strength), 6) AS stronger", "token_estimate(content) AS tokens", "round(recency_boost(strength, CAST(id % 90 AS DOUBLE), retrieval_count), 6) AS boosted", "jaccard(array_distinct(array(category)), array_distinct(array(kw2, kw3))) AS alike"]
    return t.memory.selectExpr(*told).withColumn("alike", r6(F.col("alike")))


@BOOK.add("adjacency_limited", graphs.BOOK["graph_expand_limited"][1])
def _(t: Lens) -> DataFrame:
    return edges_of(t).expand(t.memory.where("id between 1 and 200").select("id"), 1, max_results=20)


@BOOK.add("adjacency_fetch", more.BOOK["fetch_edges"][1])
def _(t: Lens) -> DataFrame:
    return edges_of(t).fetched(t.memory.where("id in (3, 5, 8)").select("id"), "both", ["similar_to", "mentions"], 0.3).select("src", "dst", "relation", "edge_score")


@BOOK.add("adjacency_grown", graphs.BOOK["edge_upsert_max"][1])
def _(t: Lens) -> DataFrame:
    """All edges after half of them came again with another score."""
    again = t.edge.where("src % 2 = 0").withColumns({"edge_score": F.col("edge_score") / 2 + 0.2, "created_s": F.col("created_s") + 5})
    return edges_of(t).grown(again).edges()
