"""Full text, vectors, fusion and hybrid search."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.functions import scores, text
from memspan.functions.stem import stem
from memspan.operators import retrieval as R
from memspan.operators.textindex import TextIndex, postings, query_terms
from memspan.plans.book import Book, r6
from memspan.plans.lens import NOW, Lens

BOOK = Book()
QUERY, LIMIT = "the ernes of tion and", 20
OBS_QUERY = "errors m7 proj1 k42"
FIELDS = {"memory": ["title", "content"], "observation": ["title", "narrative"], "run": ["prompt", "lesson"]}
#: Endings that English words with one stem may have; SQL knows no stems, so it is told the words.
ENDINGS = ["", "s", "es", "ed", "er", "ers", "ing", "ings", "ly", "al", "e", "ement", "ements", "ance", "able", "ation", "ations", "ational", "ative", "ive", "ize", "ness", "ful", "ous", "ism", "ate", "y", "ies", "ied", "ily"]
_INDEXES: dict[tuple[str, str, str], TextIndex] = {}


def index_of(t: Lens, table: str) -> TextIndex:
    """The stored index of a view, built once for a session and folder."""
    key = (t._spark.sparkContext.applicationId, t._dir, table)
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex.build(getattr(t, table).select("id", *FIELDS[table]), "id", FIELDS[table])
    return _INDEXES[key]


def indexes(t: Lens) -> R.Indexes:
    """Indexes of three tables; those that are not built yet are built at the same time."""
    names = ("observation", "memory", "run")
    for name in names:
        getattr(t, name)
    with ThreadPoolExecutor(len(names)) as pool:
        return R.Indexes(**dict(zip(names, pool.map(lambda name: index_of(t, name), names), strict=True)))


def words_of(term: str) -> list[str]:
    """Words that have a stem: the stem and what endings make of it."""
    if term.isdigit():
        return [term]
    heads = {term, term + "e", term[:-1] + "y", term[:-1], term + term[-1:]}
    chains = {"".join(c) for n in (1, 2, 3) for c in product(("s", "ed", "ing", "ly"), repeat=n)}
    return sorted({term} | {w for head in heads for end in chains.union(ENDINGS) if stem(w := head + end) == term})


def tokens_sql(field: str) -> str:
    return rf"coalesce(regexp_extract_all(lower({field}), '\p{{L}}+|[0-9]+'), [])"


def count_sql(term: str, tokens: str = "tk") -> str:
    listed = ", ".join(f"'{w}'" for w in words_of(term))
    return f"len(list_filter({tokens}, lambda x: x IN ({listed})))"


def bm25_sql(table: str, field: str, query: str, every: bool = False, scope: str = "TRUE") -> str:
    """Scores of a table's rows within a scope; the statistics are those of the whole table."""
    terms = query_terms(query)
    n = range(len(terms))
    tfs = ", ".join(f"CAST({count_sql(t)} AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"CAST(count(*) FILTER (WHERE tf{i} > 0) AS DOUBLE) AS df{i}" for i in n)
    weight = " + ".join(f"ln(1.0::DOUBLE + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in n)
    match = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in n)
    return f"""(WITH tk AS (SELECT id, {scope} AS inside, {tokens_sql(field)} AS tk FROM {table}), tt AS (SELECT id, inside, CAST(len(tk) AS DOUBLE) AS dl, {tfs} FROM tk),
        st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {dfs} FROM tt) SELECT id, {weight} AS score FROM tt, st WHERE inside AND ({match}))"""


def fuse_sql(branches: list[str], k: int, limit: int) -> str:
    ranks = " UNION ALL ".join(f"SELECT * FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {b} AS b) WHERE rank <= {limit}" for b in branches)
    return f"(SELECT id, round(sum(1.0::DOUBLE / ({k} + rank)), 12) AS score FROM ({ranks}) GROUP BY id ORDER BY score DESC, id LIMIT {limit})"


def boost_sql(score: str) -> str:
    return f"{score} * strength * exp(-(greatest(0, {NOW} - created_s) / 86400.0::DOUBLE) / 30.0::DOUBLE) * (1.0::DOUBLE + 0.1::DOUBLE * least(greatest(retrieval_count, 0), 20))"


def memories_sql(query: str, limit: int, extra: tuple[str, ...] = (), k: int = 10, scope: str = "is_latest", boost: bool = True) -> str:
    fused = fuse_sql([bm25_sql("memory", "title", query, scope=scope), bm25_sql("memory", "content", query, scope=scope), *extra], k, limit)
    score = boost_sql("f.score") if boost else "f.score * strength"
    return f"(SELECT m.id, CAST(NULL AS VARCHAR) AS session_id, m.title, 'memory:' || m.category AS obs_type, CAST(floor(10 * m.strength) AS INT) AS importance, {score} AS score FROM memory AS m JOIN {fused} AS f ON m.id = f.id)"


def obs_sql(query: str, limit: int, k: int, extra: tuple[str, ...] = ()) -> str:
    fused = fuse_sql([bm25_sql("observation", "title", query), bm25_sql("observation", "narrative", query), *extra], k, limit)
    return f"(SELECT o.id, CAST(o.session_id AS VARCHAR) AS session_id, o.title, o.obs_type, CAST(o.importance AS INT) AS importance, f.score FROM observation AS o JOIN {fused} AS f ON o.id = f.id)"


_CLOSED = "ended_s IS NOT NULL AND coalesce(lesson, '') <> ''"


def runs_sql(query: str, limit: int) -> str:
    fused = fuse_sql([bm25_sql("run", field, query, scope=_CLOSED) for field in ("prompt", "lesson")], 60, limit)
    return f"(SELECT r.id, CAST(r.session_id AS VARCHAR) AS session_id, CASE WHEN length(r.prompt) > 80 THEN substring(r.prompt, 1, 80) || '…' ELSE r.prompt END AS title, 'run:task:' || r.outcome AS obs_type, 5 AS importance, f.score * 0.7::DOUBLE AS score FROM run AS r JOIN {fused} AS f ON r.id = f.id)"


def tag_sql(rows: str, table: str) -> str:
    return f"SELECT '{table}:' || CAST(id AS VARCHAR) AS id, session_id, title, obs_type, importance, score FROM {rows} AS x"


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("score", r6(F.col("score")))


def shown_sql(rows: str) -> str:
    return f"SELECT id, session_id, title, obs_type, importance, round(score, 6) AS score FROM ({rows})"


@BOOK.add("tokenize_df", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term ORDER BY df DESC, term LIMIT 200")
def _(t: Lens) -> DataFrame:
    named = t.documents.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    counted = named.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("df"), "term").limit(200)


@BOOK.add("postings_stats", f"SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS avgdl FROM (SELECT len({tokens_sql('text')}) AS n FROM documents)")
def _(t: Lens) -> DataFrame:
    held = postings(t.documents, "doc_id", ["text"]).agg(F.sum("tf").alias("tokens"))
    both = t.documents.agg(F.count(F.lit(1)).alias("docs")).crossJoin(held)  # a row each
    return both.select("docs", "tokens", r6(F.col("tokens") / F.col("docs")).alias("avgdl"))


_STEMS = ["m", "error", "proj", "use", "purchas", "convers", "click", "view", "signup", "k"]


@BOOK.add(
    "stemmed_postings",
    f"SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT field, term, len(list_filter(tk, lambda x: list_contains(words, x))) AS tf FROM (SELECT 'title' AS field, {tokens_sql('title')} AS tk FROM observation UNION ALL SELECT 'narrative', {tokens_sql('narrative')} FROM observation), (VALUES "
    + ", ".join("('{}', [{}])".format(x, ", ".join(f"'{w}'" for w in words_of(x))) for x in _STEMS)
    + ") AS v(term, words)) WHERE tf > 0 GROUP BY field, term",
)
def _(t: Lens) -> DataFrame:
    made = postings(t.observation, "id", ["title", "narrative"]).where(F.col("term").isin(_STEMS))
    return made.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@BOOK.add("bm25_or_topk", f"SELECT id, round(score, 6) AS score FROM {bm25_sql('memory', 'content', QUERY)} ORDER BY score DESC, id LIMIT {LIMIT}")
def _(t: Lens) -> DataFrame:
    return shown(R.top(index_of(t, "memory").bm25("content", QUERY), LIMIT))


@BOOK.add(
    "bm25_and_filter",
    "SELECT id, ts_us FROM observation WHERE " + " OR ".join("(" + " AND ".join(f"{count_sql(x, tokens_sql(field))} > 0" for x in query_terms("errors m7")) + ")" for field in ("title", "narrative")) + " ORDER BY ts_us DESC, id LIMIT 100",
)
def _(t: Lens) -> DataFrame:
    return R.listed_observations(t.observation, index_of(t, "observation"), "errors m7").select("id", "ts_us")


_BOTH = "is_latest AND project IN ('src1', 'global') AND category = 'en'"


@BOOK.add(
    "memories_search",
    f"""SELECT id, round(score, 6) AS score FROM (SELECT coalesce(a.id, b.id) AS id, coalesce(a.score, 0.0::DOUBLE) + coalesce(b.score, 0.0::DOUBLE) AS score FROM {bm25_sql("memory", "title", "the of", True, _BOTH)} AS a
        FULL JOIN {bm25_sql("memory", "content", "the of", True, _BOTH)} AS b ON a.id = b.id) ORDER BY score DESC, id LIMIT 50""",
)
def _(t: Lens) -> DataFrame:
    return shown(R.listed_memories(t.memory, index_of(t, "memory"), "the of", project="src1", category="en"))


@BOOK.add("memories_wildcard", f"SELECT id, 0.0::DOUBLE AS score FROM memory WHERE {_BOTH} ORDER BY created_s DESC, id LIMIT 50")
def _(t: Lens) -> DataFrame:
    return R.listed_memories(t.memory, index_of(t, "memory"), "*", project="src1", category="en")


_QUERY_VECTOR = "SELECT embedding FROM embeddings WHERE vec_id = 7"
_COS = "(list_sum(list_transform(list_zip(a, b), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE))))"


def _vector(t: Lens) -> list[float]:
    row = t.embeddings.where("vec_id = 7").select("embedding").head()
    return list(row["embedding"]) if row else [0.0]


def knn_sql(limit: int, scope: str = "") -> str:
    return f"(SELECT id, score FROM (SELECT vec_id AS id, {_COS} AS score FROM (SELECT vec_id, embedding AS a, ({_QUERY_VECTOR}) AS b FROM embeddings WHERE embedding IS NOT NULL{scope})) ORDER BY score DESC, id LIMIT {limit})"


@BOOK.add("knn_topk", f"SELECT id, round(score, 6) AS score FROM {knn_sql(LIMIT)} AS k")
def _(t: Lens) -> DataFrame:
    return shown(R.nearest(t.embeddings, _vector(t), LIMIT))


@BOOK.add("search_semantic", f"SELECT o.id, o.title, round(k.score, 6) AS score FROM {knn_sql(LIMIT)} AS k JOIN observation o ON o.id = k.id")
def _(t: Lens) -> DataFrame:
    found = R.nearest(t.embeddings, _vector(t), LIMIT)
    return shown(t.observation.select("id", "title").join(F.broadcast(found), "id"))


@BOOK.add("rrf_fuse", f"SELECT id, round(score, 6) AS score FROM {fuse_sql([bm25_sql('memory', 'title', QUERY), bm25_sql('memory', 'content', QUERY), knn_sql(LIMIT)], 10, LIMIT)} AS f")
def _(t: Lens) -> DataFrame:
    branches = [index_of(t, "memory").bm25(field, QUERY) for field in ("title", "content")]
    return shown(R.fuse([*branches, R.nearest(t.embeddings, _vector(t), LIMIT)], 10, LIMIT))


@BOOK.add("search_memories", shown_sql(f"SELECT * FROM {memories_sql(QUERY, LIMIT)} AS x ORDER BY score DESC, id LIMIT 10"))
def _(t: Lens) -> DataFrame:
    return shown(R.top(R.search_memories(t.memory, index_of(t, "memory"), QUERY, LIMIT, NOW), 10))


@BOOK.add("search_memories_vector", shown_sql(f"SELECT * FROM {memories_sql(QUERY, LIMIT, extra=(f'(SELECT k.id, k.score FROM {knn_sql(LIMIT)} AS k JOIN memory AS m ON m.id = k.id AND m.is_latest)',))} AS x"))
def _(t: Lens) -> DataFrame:
    return shown(R.search_memories(t.memory, index_of(t, "memory"), QUERY, LIMIT, NOW, vectors=R.nearest(t.embeddings, _vector(t), LIMIT)))


@BOOK.add("search_observations", shown_sql(f"SELECT * FROM {obs_sql(OBS_QUERY, LIMIT, 10)} AS x"))
def _(t: Lens) -> DataFrame:
    return shown(R.search_observations(t.observation, index_of(t, "observation"), OBS_QUERY, LIMIT, 10))


@BOOK.add("search_runs", shown_sql(f"SELECT * FROM {runs_sql(QUERY, LIMIT)} AS x"))
def _(t: Lens) -> DataFrame:
    return shown(R.search_runs(t.run, index_of(t, "run"), QUERY, LIMIT))


_RUNS = "project = 'proj1'"


@BOOK.add("runs_recent", "SELECT id, session_id, outcome FROM run ORDER BY started_s DESC, id LIMIT 20")
def _(t: Lens) -> DataFrame:
    return R.listed_runs(t.run, index_of(t, "run"), "").select("id", "session_id", "outcome")


@BOOK.add("runs_search", f"SELECT r.id, r.session_id, round(f.score, 6) AS score FROM run AS r JOIN {fuse_sql([bm25_sql('run', 'prompt', QUERY, scope=_RUNS), bm25_sql('run', 'lesson', QUERY, scope=_RUNS)], 60, LIMIT)} AS f ON r.id = f.id")
def _(t: Lens) -> DataFrame:
    return shown(R.listed_runs(t.run, index_of(t, "run"), QUERY, LIMIT, project="proj1").select("id", "session_id", "score"))


@BOOK.add("search_text", shown_sql(f"SELECT * FROM ({tag_sql(obs_sql(OBS_QUERY + ' the', LIMIT, 60), 'observation')} UNION ALL {tag_sql(memories_sql(OBS_QUERY + ' the', LIMIT), 'memory')}) ORDER BY score DESC, id LIMIT {LIMIT}"))
def _(t: Lens) -> DataFrame:
    return shown(R.search_text(t.observation, t.memory, indexes(t), OBS_QUERY + " the", LIMIT, NOW))


HYBRID = OBS_QUERY + " the et"
_SOME = " AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_NEAR_OBS, _NEAR_LATEST = (knn_sql(LIMIT, f"{_SOME} AND vec_id IN (SELECT id FROM {rows})") for rows in ("observation", "memory WHERE is_latest"))
_HYBRID_ROWS = f"SELECT * FROM ({tag_sql(obs_sql(HYBRID, LIMIT, 10, (_NEAR_OBS,)), 'observation')} UNION ALL {tag_sql(memories_sql(HYBRID, LIMIT, (_NEAR_LATEST,)), 'memory')} UNION ALL {tag_sql(runs_sql(HYBRID, LIMIT // 2), 'run')}) ORDER BY score DESC, id LIMIT {LIMIT}"
_EXPANDED = f"""WITH r AS ({_HYBRID_ROWS}), seeds AS (SELECT CAST(split_part(id, ':', 2) AS BIGINT) AS src, score FROM r WHERE id LIKE 'memory:%'),
        met AS (SELECT e.dst, e.relation, e.via, s.score * 0.5::DOUBLE * e.edge_score AS s FROM edge e JOIN seeds s ON e.src = s.src WHERE e.relation IN ('similar_to', 'elaborates')),
        b AS (SELECT *, relation || ':' || via AS l FROM met QUALIFY row_number() OVER (PARTITION BY dst ORDER BY s DESC, relation DESC, via DESC) = 1)
        SELECT * FROM (SELECT * FROM r UNION ALL SELECT 'memory:' || CAST(m.id AS VARCHAR), CAST(NULL AS VARCHAR), m.title, 'memory:' || m.category || '@' || b.l, CAST(floor(10 * m.strength) AS INT), {boost_sql("b.s")} FROM memory m JOIN b ON m.id = b.dst WHERE m.is_latest AND b.dst NOT IN (SELECT src FROM seeds)) ORDER BY score DESC, id LIMIT {LIMIT}"""
_DIVERSE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(session_id, 'id:' || id) ORDER BY score DESC, id) AS nth FROM ({})) WHERE nth <= 3"


def _near(t: Lens, rows: DataFrame) -> DataFrame:
    """The vectors nearest to the query's among those of some rows; one without a direction has no cosine."""
    some = t.embeddings.where(F.exists("embedding", lambda x: x != 0))
    return R.nearest(some.join(rows.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), _vector(t), LIMIT)


@BOOK.add("search_hybrid", shown_sql(_DIVERSE.format(_EXPANDED)))
def _(t: Lens) -> DataFrame:
    near = {"obs_vectors": _near(t, t.observation), "memory_vectors": _near(t, t.memory.where("is_latest"))}
    return shown(R.search_hybrid(t.observation, t.memory, t.run, indexes(t), HYBRID, LIMIT, NOW, edges=t.edge, **near))


@BOOK.add("diversify_by_session", "SELECT session_id, count(*) AS n, min(score) AS least FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id) AS nth FROM (SELECT event_id AS id, user_id AS session_id, value AS score FROM events)) WHERE nth <= 3 GROUP BY session_id")
def _(t: Lens) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("value").alias("score"))
    return R.diversify(rows).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))


@BOOK.add("mmr_lite", f"SELECT id, category, kw1, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY category, kw1 ORDER BY score DESC, id) AS nth FROM (SELECT id, category, kw1, {boost_sql('1.0::DOUBLE')} AS score FROM memory)) WHERE nth = 1 ORDER BY score DESC, id LIMIT 10")
def _(t: Lens) -> DataFrame:
    age = scores.age_days(F.lit(NOW), F.col("created_s"))
    rows = t.memory.select("id", "category", "kw1", scores.recency_access(F.col("strength"), age, F.col("retrieval_count")).alias("score"))
    return shown(R.first_of_each(rows, ["category", "kw1"], 10))


@BOOK.add("top_memories_by_rank", f"SELECT id, round(score, 6) AS score FROM (SELECT id, {boost_sql('1.0::DOUBLE')} AS score FROM (SELECT * FROM memory WHERE is_latest AND project IN ('src1', 'global') ORDER BY created_s DESC, id LIMIT 100)) ORDER BY score DESC, id LIMIT 20")
def _(t: Lens) -> DataFrame:
    age = scores.age_days(F.lit(NOW), F.col("created_s"))
    few = t.memory.where(F.col("is_latest") & F.col("project").isin("src1", "global")).orderBy(F.desc("created_s"), "id").limit(100)
    return shown(R.top(few.select("id", scores.recency_access(F.col("strength"), age, F.col("retrieval_count")).alias("score")), 20))


@BOOK.add("access_bump", f"SELECT m.id, m.retrieval_count + CASE WHEN h.id IS NULL THEN 0 ELSE 1 END AS retrieval_count, CASE WHEN h.id IS NOT NULL THEN CAST({NOW} AS BIGINT) END AS last_s FROM memory m LEFT JOIN (SELECT DISTINCT id FROM {memories_sql(QUERY, LIMIT)} AS x) AS h ON m.id = h.id")
def _(t: Lens) -> DataFrame:
    hits = R.search_memories(t.memory, index_of(t, "memory"), QUERY, LIMIT, NOW)
    return R.bump(t.memory.select("id", "retrieval_count", "last_s"), hits, NOW).select("id", "retrieval_count", F.col("last_s").cast("long").alias("last_s"))


ABLATIONS = {"all": "", "no_vector": "vector", "no_recency": "recency,access", "no_diversify": "diversify"}
_NEAR = f"(SELECT k.id, k.score FROM {knn_sql(LIMIT)} AS k JOIN memory AS m ON m.id = k.id AND m.is_latest)"


def _ablated_sql(name: str) -> str:
    memories = memories_sql(HYBRID, LIMIT, extra=() if name == "no_vector" else (_NEAR,), boost=name != "no_recency")
    rows = f"SELECT * FROM ({tag_sql(obs_sql(HYBRID, LIMIT, 10), 'observation')} UNION ALL {tag_sql(memories, 'memory')} UNION ALL {tag_sql(runs_sql(HYBRID, LIMIT // 2), 'run')}) ORDER BY score DESC, id LIMIT {LIMIT}"
    return f"SELECT '{name}' AS mode, id, round(score, 6) AS score FROM ({rows if name == 'no_diversify' else _DIVERSE.format(rows)})"


@BOOK.add("search_ablations", " UNION ALL ".join(map(_ablated_sql, ABLATIONS)))
def _(t: Lens) -> DataFrame:
    near = R.nearest(t.embeddings, _vector(t), LIMIT)
    runs = [
        R.search_hybrid(t.observation, t.memory, t.run, indexes(t), HYBRID, LIMIT, NOW, memory_vectors=near, config=R.Config.without(switches)).select(F.lit(mode).alias("mode"), "id", r6(F.col("score")).alias("score"))
        for mode, switches in ABLATIONS.items()
    ]
    return reduce(DataFrame.unionByName, runs)


_ASKED = list(dict.fromkeys(R._tokens(QUERY)))


@BOOK.add(
    "rerank_plugin",
    shown_sql(
        f"SELECT id, session_id, title, obs_type, importance, CASE WHEN nth <= 20 THEN len(list_intersect({_ASKED}, {tokens_sql('title')})) / {len(_ASKED)}::DOUBLE ELSE score END AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS nth FROM {memories_sql(QUERY, LIMIT)} AS x)"
    ),
)
def _(t: Lens) -> DataFrame:
    found = R.search_memories(t.memory, index_of(t, "memory"), QUERY, LIMIT, NOW)
    return shown(R.rerank(found, R.overlap_score(QUERY, F.col("title"))))


@BOOK.add(
    "listwise_rerank",
    f"SELECT id, round(CAST(nth AS DOUBLE) / count(*) OVER (), 6) AS score FROM (SELECT 'memory:' || CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY score DESC, 'memory:' || CAST(id AS VARCHAR)) AS nth FROM {memories_sql(QUERY, LIMIT)} AS x ORDER BY score DESC, 'memory:' || CAST(id AS VARCHAR) LIMIT 8)",
)
def _(t: Lens) -> DataFrame:
    def backwards(prompt: str) -> str:
        count = prompt.count(" — ")
        return f'So: {{"order": {list(range(count))[::-1]}}} it is'

    found = R.top(R.tagged(R.search_memories(t.memory, index_of(t, "memory"), QUERY, LIMIT, NOW), "memory"), 8)
    return R.listwise(found, t.memory, QUERY, backwards).select("id", r6(F.col("score")).alias("score"))


@BOOK.add("synth_query", "SELECT 'proj1 ' || string_agg(title, ' ' ORDER BY importance DESC, ts_us, id) AS query FROM (SELECT * FROM observation WHERE project = 'proj1' AND importance >= 5 ORDER BY importance DESC, ts_us, id LIMIT 5)")
def _(t: Lens) -> DataFrame:
    few = t.observation.where("project = 'proj1' and importance >= 5").orderBy(F.desc("importance"), "ts_us", "id").limit(5)
    listed = few.agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "ts_us", "id", "title"))).alias("l"))
    return listed.select(F.concat(F.lit("proj1 "), F.array_join(F.transform("l", lambda x: x["title"]), " ")).alias("query"))
