"""The knowledge graph, and retrieval metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.operators import context, graph, metrics, plans, provenance
from memspan.operators import retrieval as R
from memspan.plans.book import Book, r6
from memspan.plans import searches
from memspan.plans.lens import NOW, Lens
from memspan.plans.searches import QUERY, bm25_sql, boost_sql, fuse_sql, index_of, knn_sql, memories_sql, shown, shown_sql, tag_sql, tokens_sql

BOOK = Book()
_COS = "list_sum(list_transform(list_zip(a, b), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE)))"
_KNN = f"SELECT id, nbr, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS nth FROM (SELECT x.vec_id AS id, y.vec_id AS nbr, round({_COS.replace('(a', '(x.embedding').replace(', b)', ', y.embedding)').replace('transform(b', 'transform(y.embedding')}, 9) AS sim FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id)) WHERE nth <= 10"


def tagged(t: Lens) -> DataFrame:
    return t.memory.select("id", "created_s", "content", "project", F.array("kw1", "kw2", "kw3").alias("keywords"), F.array("f1", "f2").alias("files"))


@BOOK.add("edge_upsert_max", "SELECT src, dst, relation, via, max(edge_score) AS edge_score, min(created_s) AS created_s FROM (SELECT * FROM edge UNION ALL SELECT src, dst, relation, via, edge_score / 2 + 0.2::DOUBLE, created_s + 5 FROM edge WHERE src % 2 = 0) GROUP BY src, dst, relation, via")
def _(t: Lens) -> DataFrame:
    again = t.edge.where("src % 2 = 0").withColumn("edge_score", F.col("edge_score") / 2 + 0.2).withColumn("created_s", F.col("created_s") + 5)
    return graph.upsert(t.edge.unionByName(again))


@BOOK.add("knn_self_join", f"SELECT id, nbr, round(sim, 6) AS sim FROM ({_KNN})")
def _(t: Lens) -> DataFrame:
    return graph.knn_pairs(t.embeddings, 10, "label").withColumn("sim", r6(F.col("sim")))


@BOOK.add(
    "similarity_edges",
    f"""WITH knn AS ({_KNN}), j AS (SELECT k.id, k.nbr, k.sim, [m.kw1, m.kw2, m.kw3] AS ka, [n.kw1, n.kw2, n.kw3] AS kb, [m.f1, m.f2] AS fa, [n.f1, n.f2] AS fb FROM knn k JOIN memory m ON k.id = m.id JOIN memory n ON k.nbr = n.id),
        s AS (SELECT id, nbr, sim, len(list_intersect(ka, kb))::DOUBLE / len(list_distinct(list_concat(ka, kb))) AS jk, len(list_intersect(fa, fb))::DOUBLE / len(list_distinct(list_concat(fa, fb))) AS jf FROM j)
        SELECT id AS src, nbr AS dst, 'similar_to' AS relation, 'embedding' AS via, round(sim, 6) AS edge_score FROM s WHERE sim > 0.75
        UNION ALL SELECT id, nbr, 'similar_to', 'keyword', round(jk, 6) FROM s WHERE jk >= 0.3 UNION ALL SELECT id, nbr, 'similar_to', 'file', round(jf, 6) FROM s WHERE jf >= 0.3""",
)
def _(t: Lens) -> DataFrame:
    pairs = graph.knn_pairs(t.embeddings, 10, "label")
    return graph.similarity_edges(pairs, tagged(t)).withColumn("edge_score", r6(F.col("edge_score")))


@BOOK.add(
    "keyword_jaccard_edges",
    "WITH k AS (SELECT id, unnest([kw1, kw2, kw3]) AS w FROM memory) SELECT a.id AS src, b.id AS dst, round(count(*) / (6.0::DOUBLE - count(*)), 6) AS jaccard FROM k a JOIN k b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / (6.0::DOUBLE - count(*)) >= 0.4",
)
def _(t: Lens) -> DataFrame:
    return graph.shared_tokens(tagged(t), "keywords", 0.4, digits=6)


@BOOK.add(
    "entity_edges",
    "WITH k AS (SELECT id, project, unnest([kw1, f1]) AS w FROM memory) SELECT a.id AS src, b.id AS dst, round(count(*) / (4.0::DOUBLE - count(*)), 6) AS jaccard FROM k a JOIN k b ON a.w = b.w AND a.project = b.project AND a.id < b.id GROUP BY a.id, b.id",
)
def _(t: Lens) -> DataFrame:
    items = t.memory.select("id", "project", F.array("kw1", "f1").alias("entities"))
    return graph.shared_tokens(items, "entities", 0.0, scope="project", digits=6)


@BOOK.add("run_follows", "SELECT src, dst FROM (SELECT id AS src, lag(id) OVER (PARTITION BY session_id ORDER BY ended_s, id) AS dst FROM run WHERE ended_s IS NOT NULL) WHERE dst IS NOT NULL")
def _(t: Lens) -> DataFrame:
    return provenance.follows(t.run)


@BOOK.add("run_edges", "SELECT 'run:' || CAST(id AS VARCHAR) AS src, 'session:' || CAST(session_id AS VARCHAR) AS dst, 'part_of' AS relation FROM run UNION ALL SELECT 'run:' || CAST(src AS VARCHAR), 'run:' || CAST(dst AS VARCHAR), 'follows' FROM (SELECT id AS src, lag(id) OVER (PARTITION BY session_id ORDER BY ended_s, id) AS dst FROM run WHERE ended_s IS NOT NULL) WHERE dst IS NOT NULL")
def _(t: Lens) -> DataFrame:
    return provenance.run_edges(t.run).select("src", "dst", "relation")


_SAVED = f"SELECT id, id % 20 AS session_id, {NOW} - 100000 + (id * 37) % 90000 AS at_s FROM memory"
#: The run that was open in a row's session at its time: the last that had begun, unless it was over.
OPEN_SQL = "SELECT id, CASE WHEN ended_s IS NULL OR at_s < ended_s THEN run_id END AS run_id FROM (SELECT p.id, p.at_s, r.id AS run_id, r.ended_s, row_number() OVER (PARTITION BY p.id ORDER BY r.started_s DESC, r.id DESC) AS nth FROM ({}) p LEFT JOIN run r ON r.session_id = p.session_id AND r.started_s <= p.at_s) WHERE nth = 1"


def runs_with_recall(t: Lens) -> DataFrame:
    """Runs that each had recalled two memories and had a plan."""
    return t.run.select("*", F.array(F.col("id") * 3, F.col("id") * 3 + 1).alias("recalled"), (F.col("id") % 10).alias("plan_id"))


@BOOK.add(
    "provenance_edges",
    f"""WITH o AS (SELECT id, run_id FROM ({OPEN_SQL.format(_SAVED)}) WHERE run_id IS NOT NULL)
        SELECT 'memory:' || CAST(id AS VARCHAR) AS src, 'run:' || CAST(run_id AS VARCHAR) AS dst, 'generated_by' AS relation, 'system' AS via, 1.0::DOUBLE AS edge_score FROM o
        UNION ALL SELECT 'memory:' || CAST(id AS VARCHAR), 'memory:' || CAST(run_id * 3 + i AS VARCHAR), 'derived_from', 'system', 0.8::DOUBLE FROM o, (VALUES (0), (1)) AS v(i) WHERE run_id * 3 + i <> id""",
)
def _(t: Lens) -> DataFrame:
    saved = t.memory.select("id", (F.col("id") % 20).alias("session_id"), (F.lit(NOW - 100_000) + (F.col("id") * 37) % 90_000).alias("at_s"))
    return provenance.memory_edges(saved, runs_with_recall(t))


@BOOK.add(
    "graph_expand_1hop",
    "WITH best AS (SELECT dst, src, relation, edge_score, row_number() OVER (PARTITION BY dst ORDER BY edge_score DESC, src, relation) AS nth FROM edge WHERE src IN (1, 2, 3, 4, 5, 6, 7, 8, 9) AND edge_score >= 0.2 AND relation IN ('similar_to', 'elaborates') AND dst NOT IN (1, 2, 3, 4, 5, 6, 7, 8, 9)) SELECT dst AS node, CAST(1 AS INT) AS hop, src AS via_src, relation, edge_score FROM best WHERE nth = 1",
)
def _(t: Lens) -> DataFrame:
    seeds = t.memory.where("id between 1 and 9").select("id")
    return graph.expand(t.edge, seeds, 1, ["similar_to", "elaborates"], 0.2)


@BOOK.add(
    "bfs_trace_2hop",
    """WITH s AS (SELECT src, dst, relation, edge_score FROM edge UNION ALL SELECT dst, src, relation, edge_score FROM edge), h0 AS (SELECT id AS node FROM memory WHERE id BETWEEN 1 AND 5),
       h1 AS (SELECT * FROM (SELECT dst AS node, src, relation, edge_score, row_number() OVER (PARTITION BY dst ORDER BY edge_score DESC, src, relation) AS nth FROM s WHERE src IN (SELECT node FROM h0) AND dst NOT IN (SELECT node FROM h0)) WHERE nth = 1),
       h2 AS (SELECT * FROM (SELECT dst AS node, src, relation, edge_score, row_number() OVER (PARTITION BY dst ORDER BY edge_score DESC, src, relation) AS nth FROM s WHERE src IN (SELECT node FROM h1) AND dst NOT IN (SELECT node FROM h0) AND dst NOT IN (SELECT node FROM h1)) WHERE nth = 1)
       SELECT n.node, n.hop, n.via_src, n.relation, n.edge_score, m.title FROM (SELECT node, CAST(1 AS INT) AS hop, src AS via_src, relation, edge_score FROM h1 UNION ALL SELECT node, CAST(2 AS INT), src, relation, edge_score FROM h2) AS n LEFT JOIN memory m ON m.id = n.node""",
)
def _(t: Lens) -> DataFrame:
    seeds = t.memory.where("id between 1 and 5").select("id")
    found = graph.expand(t.edge, seeds, 2, direction="both")
    return found.join(t.memory.select(F.col("id").alias("node"), "title"), "node", "left").select("node", "hop", "via_src", "relation", "edge_score", "title")


@BOOK.add(
    "graph_expand_search",
    f"""WITH r AS (SELECT * FROM ({tag_sql(memories_sql(QUERY, 10), "memory")}) ORDER BY score DESC, id LIMIT 10), seeds AS (SELECT CAST(split_part(id, ':', 2) AS BIGINT) AS src, score FROM r),
        b AS (SELECT e.dst, max(s.score * 0.5::DOUBLE * e.edge_score) AS s, arg_max(e.relation || ':' || e.via, s.score * 0.5::DOUBLE * e.edge_score) AS l FROM edge e JOIN seeds s ON e.src = s.src WHERE e.relation IN ('similar_to', 'elaborates') GROUP BY e.dst)
        """
    + shown_sql(
        f"SELECT * FROM r UNION ALL SELECT 'memory:' || CAST(m.id AS VARCHAR), CAST(NULL AS VARCHAR), m.title, 'memory:' || m.category || '@' || b.l, CAST(floor(10 * m.strength) AS INT), {boost_sql('b.s')} FROM memory m JOIN b ON m.id = b.dst WHERE m.is_latest AND b.dst NOT IN (SELECT src FROM seeds)"
    ),
)
def _(t: Lens) -> DataFrame:
    found = R.top(R.tagged(R.search_memories(t.memory, index_of(t, "memory"), QUERY, 10, NOW), "memory"), 10)
    return shown(R.expand(found, t.edge, t.memory, NOW))


@BOOK.add(
    "graph_expand_limited",
    "WITH best AS (SELECT dst, src, relation, edge_score, row_number() OVER (PARTITION BY dst ORDER BY edge_score DESC, src, relation) AS nth FROM edge WHERE src BETWEEN 1 AND 200 AND dst NOT BETWEEN 1 AND 200) SELECT dst AS node, CAST(1 AS INT) AS hop, src AS via_src, relation, edge_score FROM best WHERE nth = 1 ORDER BY edge_score DESC, node LIMIT 20",
)
def _(t: Lens) -> DataFrame:
    return graph.expand(t.edge, t.memory.where("id between 1 and 200").select("id"), 1, max_results=20)


@BOOK.add(
    "trace_labels",
    """WITH e AS (SELECT 'memory:' || CAST(id AS VARCHAR) AS src, 'run:' || CAST(id % 997 AS VARCHAR) AS dst, 'generated_by' AS relation, CAST(id % 10 + 1 AS DOUBLE) / 10 AS edge_score FROM memory
         UNION ALL SELECT 'run:' || CAST(id AS VARCHAR), 'session:' || CAST(session_id AS VARCHAR), 'part_of', 1.0::DOUBLE FROM run UNION ALL SELECT 'run:' || CAST(id AS VARCHAR), 'gone:' || CAST(id AS VARCHAR), 'follows', 0.5::DOUBLE FROM run),
       s AS (SELECT src, dst, relation, edge_score FROM e UNION ALL SELECT dst, src, relation, edge_score FROM e),
       h1 AS (SELECT * FROM (SELECT dst AS node, src, relation, edge_score, row_number() OVER (PARTITION BY dst ORDER BY edge_score DESC, src, relation) AS nth FROM s WHERE src = 'memory:3' AND dst <> 'memory:3') WHERE nth = 1),
       h2 AS (SELECT * FROM (SELECT dst AS node, src, relation, edge_score, row_number() OVER (PARTITION BY dst ORDER BY edge_score DESC, src, relation) AS nth FROM s WHERE src IN (SELECT node FROM h1) AND dst <> 'memory:3' AND dst NOT IN (SELECT node FROM h1)) WHERE nth = 1),
       f AS (SELECT 'memory:3' AS node, CAST(0 AS INT) AS hop, CAST(NULL AS VARCHAR) AS via_src, CAST(NULL AS VARCHAR) AS relation, CAST(NULL AS DOUBLE) AS edge_score UNION ALL SELECT node, 1, src, relation, edge_score FROM h1 UNION ALL SELECT node, 2, src, relation, edge_score FROM h2),
       n AS (SELECT 'memory:' || CAST(id AS VARCHAR) AS node, 'memory' AS tab, title AS label, created_s AS at_s FROM memory UNION ALL SELECT 'run:' || CAST(id AS VARCHAR), 'run', coalesce(prompt, 'run:' || CAST(id AS VARCHAR)), started_s FROM run UNION ALL SELECT 'session:' || CAST(id AS VARCHAR), 'session', 'session:' || CAST(id AS VARCHAR), NULL FROM session)
       SELECT f.node, f.hop, f.via_src, f.relation, f.edge_score, coalesce(n.tab, split_part(f.node, ':', 1)) AS "table", coalesce(n.label, f.node) AS label, n.at_s FROM f LEFT JOIN n ON n.node = f.node""",
)
def _(t: Lens) -> DataFrame:
    key = provenance.named
    made = t.memory.select(key("memory", F.col("id")).alias("src"), key("run", F.col("id") % 997).alias("dst"), F.lit("generated_by").alias("relation"), ((F.col("id") % 10 + 1).cast("double") / 10).alias("edge_score"))
    part = t.run.select(key("run", F.col("id")).alias("src"), key("session", F.col("session_id")).alias("dst"), F.lit("part_of").alias("relation"), F.lit(1.0).alias("edge_score"))
    gone = t.run.select(key("run", F.col("id")).alias("src"), key("gone", F.col("id")).alias("dst"), F.lit("follows").alias("relation"), F.lit(0.5).alias("edge_score"))
    tables = {"memory": t.memory, "run": t.run, "session": t.session.select("id")}
    return graph.trace(made.unionByName(part).unionByName(gone), "memory:3", tables)


@BOOK.add("memory_links", "SELECT e.dst, e.relation, e.via, e.edge_score, m.title, m.category FROM edge e LEFT JOIN memory m ON m.id = e.dst WHERE e.src = 12")
def _(t: Lens) -> DataFrame:
    mine = t.edge.where("src = 12").select("dst", "relation", "via", "edge_score")
    return mine.join(t.memory.select(F.col("id").alias("dst"), "title", "category"), "dst", "left")


@BOOK.add(
    "cooccurrence_graph",
    "WITH k AS (SELECT DISTINCT id, unnest([kw1, kw2, kw3]) AS w FROM memory), d AS (SELECT w FROM k GROUP BY w HAVING count(*) <= 20) SELECT DISTINCT a.id AS src, b.id AS dst FROM k a JOIN k b ON a.w = b.w AND a.id < b.id WHERE a.w IN (SELECT w FROM d)",
)
def _(t: Lens) -> DataFrame:
    return graph.cooccurrence(tagged(t), "keywords")


@BOOK.add(
    "drawn_graph",
    """WITH i AS (SELECT 'memory:' || CAST(id AS VARCHAR) AS id, unnest([kw1, kw2, kw3]) AS w FROM memory UNION ALL SELECT 'observation:' || CAST(id AS VARCHAR), unnest([kw1, kw2]) FROM observation WHERE obs_type <> 'conversation' AND title <> 'unknown call'),
       k AS (SELECT DISTINCT id, w FROM i), d AS (SELECT w FROM k GROUP BY w HAVING count(*) <= 20), e AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM k a JOIN k b ON a.w = b.w AND a.id < b.id WHERE a.w IN (SELECT w FROM d)),
       g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node)
       SELECT n.id, coalesce(g.degree, 0) AS degree, least(CASE WHEN n.id LIKE 'memory:%' THEN 12 ELSE 6 END + 2 * coalesce(g.degree, 0), 22) AS radius FROM (SELECT DISTINCT id FROM i) n LEFT JOIN g ON g.node = n.id""",
)
def _(t: Lens) -> DataFrame:
    return graph.drawn(tagged(t), t.observation.select("id", "obs_type", "title", F.array("kw1", "kw2").alias("keywords")))[0]


@BOOK.add("node_degree", "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY node")
def _(t: Lens) -> DataFrame:
    return graph.degrees(t.edge)


_GOLD = "SELECT id % 20 AS query_id, id FROM (SELECT doc_id AS id FROM labels WHERE quality = 1) WHERE id % 4 = 0"
_RESULTS = "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (id * 7919) % 1009, id) AS rank FROM (SELECT doc_id % 20 AS query_id, doc_id AS id FROM documents)"
_METRICS = f"""WITH gold AS ({_GOLD}), res AS (SELECT * FROM ({_RESULTS}) WHERE rank <= 50), h AS (SELECT r.query_id, min(r.rank) AS first, sum(CASE WHEN r.rank <= 10 THEN 1.0::DOUBLE / log2(r.rank + 1) END) AS dcg FROM res r JOIN gold g ON r.query_id = g.query_id AND r.id = g.id GROUP BY r.query_id),
    z AS (SELECT query_id, least(10, count(*)) AS n FROM gold GROUP BY query_id), i AS (SELECT n, list_sum(list_transform(range(1, n + 1), lambda x: 1.0::DOUBLE / log2(x + 1))) AS ideal FROM (SELECT DISTINCT n FROM z)),
    m AS (SELECT z.query_id, CASE WHEN h.first <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_any, coalesce(h.dcg / i.ideal, 0.0::DOUBLE) AS ndcg, coalesce(1.0::DOUBLE / h.first, 0.0::DOUBLE) AS mrr FROM z JOIN i ON z.n = i.n LEFT JOIN h ON z.query_id = h.query_id)"""


def _measured(t: Lens) -> DataFrame:
    from pyspark.sql import Window

    gold = t.labels.where("quality = 1 and doc_id % 4 = 0").select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("id"))
    rows = t.documents.select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("id"))
    window = Window.partitionBy("query_id").orderBy((F.col("id") * 7919) % 1009, "id")
    return metrics.per_query(rows.withColumn("rank", F.row_number().over(window)).where("rank <= 50"), gold, 10)


@BOOK.add("retrieval_metrics", _METRICS + " SELECT query_id, recall_any, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM m")
def _(t: Lens) -> DataFrame:
    return _measured(t).select("query_id", "recall_any", r6(F.col("ndcg")).alias("ndcg"), r6(F.col("mrr")).alias("mrr"))


@BOOK.add(
    "metrics_rollup",
    _METRICS + " SELECT kind, count(*) AS n, round(avg(recall_any), 6) AS recall_any, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM (SELECT *, 'type' || CAST(query_id % 3 AS VARCHAR) AS kind FROM m) GROUP BY ROLLUP (kind)",
)
def _(t: Lens) -> DataFrame:
    typed = _measured(t).withColumn("kind", F.concat(F.lit("type"), (F.col("query_id") % 3).cast("string")))
    return typed.rollup("kind").agg(F.count(F.lit(1)).alias("n"), *(r6(F.avg(c)).alias(c) for c in ("recall_any", "ndcg", "mrr")))


@BOOK.add("recall_at_k", "SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall FROM (SELECT conv_id, min(turn) + 1 AS rank FROM turns WHERE role = 'assistant' GROUP BY conv_id), (VALUES (1), (5), (10)) AS v(k) GROUP BY k")
def _(t: Lens) -> DataFrame:
    ranks = t.turns.where("role = 'assistant'").groupBy("conv_id").agg((F.min("turn") + 1).alias("rank"))
    return ranks.select("rank", F.explode(F.array(*(F.lit(k) for k in (1, 5, 10)))).alias("k")).groupBy("k").agg(r6(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0))).alias("recall"))


@BOOK.add("injection_hit_rate", "SELECT count(*) AS n, round(avg(CASE WHEN contains(r.prompt, u.w) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM run r JOIN (SELECT conv_id, substring(text, 1, 3) AS w FROM turns WHERE turn = 1) u ON u.conv_id = r.id")
def _(t: Lens) -> DataFrame:
    words = t.turns.where("turn = 1").select(F.col("conv_id").alias("id"), F.substring("text", 1, 3).alias("w"))
    hits = t.run.select("id", "prompt").join(words, "id")
    return hits.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(metrics.injected(F.col("prompt"), F.col("w")), 1.0).otherwise(0.0))).alias("rate"))


_POOL = "SELECT query_id AS probe, 't' || CAST(id % 97 AS VARCHAR) AS title, CASE id % 3 WHEN 0 THEN 'file_edit' ELSE 'memory:fact' END AS obs_type, rank - 1 AS rank FROM ({}) WHERE rank <= 20".format(_RESULTS)
_ORACLE = "SELECT query_id AS probe, 't' || CAST((query_id * 13) % 97 AS VARCHAR) AS title FROM (SELECT DISTINCT doc_id % 20 AS query_id FROM documents)"
_RANKED = "SELECT o.probe, o.title, min(p.rank) AS rank FROM o LEFT JOIN p ON p.probe = o.probe AND p.title = o.title AND p.obs_type LIKE 'memory:%' GROUP BY o.probe, o.title"


def _probed(t: Lens) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    rows = t.documents.select((F.col("doc_id") % 20).alias("probe"), F.col("doc_id").alias("id"))
    window = Window.partitionBy("probe").orderBy((F.col("id") * 7919) % 1009, "id")
    pool = rows.withColumn("rank", F.row_number().over(window).cast("long") - 1).where("rank < 20")
    pool = pool.select("probe", F.concat(F.lit("t"), (F.col("id") % 97).cast("string")).alias("title"), F.when(F.col("id") % 3 == 0, "file_edit").otherwise("memory:fact").alias("obs_type"), "rank")
    return pool, rows.select("probe").distinct().select("probe", F.concat(F.lit("t"), (F.col("probe") * 13 % 97).cast("string")).alias("title"))


@BOOK.add(
    "miss_report",
    f"""WITH p AS ({_POOL}), o AS ({_ORACLE}), r AS ({_RANKED}), a AS (SELECT r.probe, p.title, row_number() OVER (PARTITION BY r.probe ORDER BY p.rank) AS nth FROM r JOIN p ON p.probe = r.probe AND p.obs_type LIKE 'memory:%' AND (r.rank IS NULL OR p.rank < r.rank)),
        c AS (SELECT probe, string_agg(title, ';' ORDER BY nth) AS above FROM a WHERE nth <= 3 GROUP BY probe) SELECT r.probe, r.rank, r.title, c.above FROM r LEFT JOIN c ON c.probe = r.probe WHERE r.rank IS NULL OR r.rank >= 5""",
)
def _(t: Lens) -> DataFrame:
    return metrics.miss_report(*_probed(t)).select("probe", "rank", "title", F.array_join("titles", ";").alias("above"))


@BOOK.add("probe_recall", f"WITH p AS ({_POOL}), o AS ({_ORACLE}), r AS ({_RANKED}) SELECT k, round(avg(CASE WHEN rank < k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, round(avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (rank + 1) END), 6) AS mrr FROM r, (VALUES (1), (5), (10)) AS v(k) GROUP BY k")
def _(t: Lens) -> DataFrame:
    found = metrics.recall_at(metrics.oracle_ranks(*_probed(t)), 1, 5, 10)
    return found.select("k", r6(F.col("recall")).alias("recall"), r6(F.col("mrr")).alias("mrr"))


@BOOK.add(
    "context_budget_pack",
    "SELECT id, tokens, CAST(used AS BIGINT) AS used FROM (SELECT id, tokens, sum(tokens) OVER (ORDER BY created_s DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT id, created_s, strlen('- ' || title || chr(10)) // 4 AS tokens FROM memory WHERE is_latest ORDER BY created_s DESC, id LIMIT 300)) WHERE used <= 2000",
)
def _(t: Lens) -> DataFrame:
    lines = t.memory.where("is_latest").select("id", "created_s", F.concat(F.lit("- "), F.col("title"), F.lit("\n")).alias("line"))
    return context.fits(lines, [F.desc("created_s"), F.col("id")], 2000).select("id", "tokens", "used")


_LINES = """SELECT 0 AS section, CAST(1 AS INT) AS pos, '# Core' || chr(10) || chr(10) || '**Identity:** proj1' || chr(10) || chr(10) AS line
         UNION ALL SELECT 1, CAST(row_number() OVER (ORDER BY strength DESC, id) AS INT), '- [' || category || '] **' || title || '**: ' || substring(content, 1, 300) || chr(10) FROM (SELECT * FROM memory WHERE is_latest ORDER BY strength DESC, id LIMIT 10)
         UNION ALL SELECT 2, CAST(row_number() OVER (ORDER BY confidence DESC, id) AS INT), '- ' || fact || chr(10) FROM (SELECT item_id AS id, substring(text, 1, 40) AS fact, (item_id % 10) / 10.0::DOUBLE AS confidence FROM benchmark WHERE item_id % 7 > 2 AND substring(text, 1, 40) <> '' ORDER BY confidence DESC, id LIMIT 10)
         UNION ALL SELECT 3, CAST(row_number() OVER (ORDER BY p_size DESC, p_partkey) AS INT), '- **' || p_name || '** (when: ' || p_type || '): look -> ' || p_brand || chr(10) FROM (SELECT * FROM part WHERE p_partkey % 5 > 1 ORDER BY p_size DESC, p_partkey LIMIT 5)
         UNION ALL SELECT 4, CAST(row_number() OVER (ORDER BY ts_us DESC, id) AS INT), '- **' || title || '**: ' || narrative || chr(10) FROM (SELECT * FROM observation WHERE project = 'proj1' AND importance >= 4 ORDER BY ts_us DESC, id LIMIT 20)
         UNION ALL SELECT 5, CAST(row_number() OVER (ORDER BY ended_s DESC, id) AS INT), '- ' || CASE outcome WHEN 'committed' THEN '✓' WHEN 'uncommitted' THEN '○' ELSE '•' END || ' **' || substring(prompt, 1, 60) || '...**: ' || lesson || chr(10) FROM (SELECT * FROM run WHERE ended_s IS NOT NULL AND lesson <> '' AND project = 'proj1' ORDER BY ended_s DESC, id LIMIT 8)"""


@BOOK.add(
    "context_sections",
    f"""WITH RECURSIVE l AS ({_LINES}),
       o AS (SELECT *, strlen(line) // 4 AS n, row_number() OVER (ORDER BY section, pos) AS i FROM l),
       f AS (SELECT i, section, pos, CASE WHEN n <= 900 THEN n ELSE 0 END AS used, CASE WHEN n <= 900 THEN -1 ELSE section END AS shut, n <= 900 AS kept FROM o WHERE i = 1
         UNION ALL SELECT o.i, o.section, o.pos, f.used + CASE WHEN o.section <> f.shut AND f.used + o.n <= 900 THEN o.n ELSE 0 END, CASE WHEN o.section <> f.shut AND f.used + o.n <= 900 THEN f.shut ELSE o.section END, o.section <> f.shut AND f.used + o.n <= 900 FROM f JOIN o ON o.i = f.i + 1)
       SELECT o.section, o.pos, o.line FROM f JOIN o ON o.i = f.i WHERE f.kept""",
)
def _(t: Lens) -> DataFrame:
    none = F.array().cast("array<string>")
    core = t.region.limit(1).select(plans.rendered(F.lit("proj1"), none, none, none).alias("block"))
    told = t.memory.where("is_latest").withColumn("content", F.substring("content", 1, 300))
    facts = t.benchmark.select(F.col("item_id").alias("id"), F.substring("text", 1, 40).alias("fact"), (F.col("item_id") % 10 / 10.0).alias("confidence"), (F.col("item_id") % 7 / 7.0).alias("strength"))
    known = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.lit("look"), "p_brand").alias("steps"), F.col("p_type").alias("trigger_condition"), F.col("p_size").alias("frequency"), (F.col("p_partkey") % 5 / 5.0).alias("strength"))
    parts = [context.core_lines(core), context.memory_lines(told, [F.desc("strength"), "id"]), context.fact_lines(facts), context.procedure_lines(known), context.observation_lines(t.observation, "proj1"), context.run_lines(t.run, "proj1")]
    return context.packed_sections(reduce(DataFrame.unionByName, parts), 900)


BENCH_QUERY = "the of et de"


@BOOK.add("bench_bm25", f"SELECT id, round(score, 6) AS score FROM {bm25_sql('run', 'prompt', BENCH_QUERY)} ORDER BY score DESC, id LIMIT 20")
def _(t: Lens) -> DataFrame:
    return shown(metrics.bench_search(index_of(t, "run"), "prompt", BENCH_QUERY))


@BOOK.add("bench_hybrid", f"SELECT id, round(score, 6) AS score FROM {fuse_sql([bm25_sql('run', 'prompt', BENCH_QUERY), knn_sql(20)], 60, 20)} AS f")
def _(t: Lens) -> DataFrame:
    near = R.nearest(t.embeddings, searches._vector(t), 20)
    return shown(metrics.bench_search(index_of(t, "run"), "prompt", BENCH_QUERY, vectors=near))
