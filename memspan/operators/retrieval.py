"""Searches: ranks of full text and nearest vectors, fused, boosted, diversified and expanded along edges.

Full text is that of stored indexes (``textindex``) of memories' titles and contents,
observations' titles and narratives, and runs' prompts and lessons.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.functions import scores, text
from memspan.operators.textindex import TextIndex
from memspan.sources.tables import checkpoint


@dataclass(frozen=True)
class Config:
    """What of a hybrid search is on, and the constant of its rank fusion."""

    vector: bool = True
    recency_access: bool = True
    graph: bool = True
    diversify: bool = True
    k: int = 10

    @classmethod
    def without(cls, switches: str, k: int = 10) -> Config:
        """All but what a list ``vector,recency,access,graph,diversify`` names."""
        names = {"vector": "vector", "recency": "recency_access", "access": "recency_access", "recency+access": "recency_access", "graph": "graph", "diversify": "diversify"}
        asked = [x.strip() for x in switches.split(",") if x.strip()]
        if unknown := [x for x in asked if x not in names]:
            raise ValueError(f"unknown switch {unknown[0]}: {', '.join(names)}")
        return cls(**{names[x]: False for x in asked}, k=k)


def plain(query: str | None) -> bool:
    """Whether a query asks for a plain listing."""
    return query is None or query.strip() in ("", "*")

def top(df: DataFrame, limit: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The best rows; unknown scores count as 0 and ties go to the smaller id."""
    return df.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(id_col)).limit(limit)


def nearest(vectors: DataFrame, query: Sequence[float], limit: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, score``: the rows of highest cosine, exactly."""
    scored = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), scores.cosine(F.col(vector_col), F.lit(list(map(float, query)))).alias("score"))
    return top(scored, limit)


def ranked(branch: DataFrame, limit: int) -> DataFrame:
    """``id, rank`` of a branch's best rows: the limit goes first, so that one small partition is ranked."""
    return top(branch, limit).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id")))).select("id", "rank")


def fuse(branches: Sequence[DataFrame], k: int, limit: int) -> DataFrame:
    """Reciprocal rank fusion: ``id, score`` with the sum of 1 / (k + rank) over the branches."""
    rows = reduce(DataFrame.unionByName, (ranked(b, limit) for b in branches))
    return top(rows.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score")), limit)


def diversify(results: DataFrame, per_session: int = 3) -> DataFrame:
    """At most so many results of a session, best first; results without a session are exempt."""
    window = Window.partitionBy(F.coalesce(F.col("session_id").cast("string"), F.concat(F.lit("id:"), F.col("id").cast("string")))).orderBy(F.col("score").desc(), "id")
    return results.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= per_session).drop("_nth")


def first_of_each(results: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The best result of each key, then the best of those."""
    window = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return top(results.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth"), limit)


def boosted(fused: DataFrame, memory: DataFrame, now_s: int, recency_access: bool = True) -> DataFrame:
    """Memories with their fused score times strength, recency and access."""
    age = scores.age_days(F.lit(now_s), F.col("created_s"))
    score = F.col("score") * F.col("strength")
    return memory.join(fused, "id").withColumn("score", scores.recency_access(score, age, F.col("retrieval_count")) if recency_access else score)


def scoped(branch: DataFrame, scope: DataFrame) -> DataFrame:
    """Hits within a scope of rows: before they are ranked, as ranks depend on it."""
    return branch.join(scope.select("id"), "id", "left_semi")


def search_memories(memory: DataFrame, index: TextIndex, query: str, limit: int, now_s: int, project: str | None = None, vectors: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Hybrid search of latest memories: BM25 of titles and contents, and vector ranks if given, fused and boosted."""
    scope = memory.where("is_latest")
    if project is not None:
        scope = scope.where(F.col("project") == project)
    branches = [index.top(field, query, limit, scope) for field in ("title", "content")]
    if vectors is not None and config.vector:
        branches.append(scoped(vectors, scope))
    wide = scope.select("id", "project", "category", "title", "strength", "retrieval_count", "created_s")
    found = boosted(fuse(branches, config.k, limit), wide, now_s, config.recency_access)
    return found.select("id", F.lit(None).cast("string").alias("session_id"), "title", F.concat(F.lit("memory:"), F.col("category")).alias("obs_type"), F.floor(10 * F.col("strength")).cast("int").alias("importance"), "score")


def listed_memories(memory: DataFrame, index: TextIndex, query: str | None, limit: int = 50, project: str | None = None, category: str | None = None) -> DataFrame:
    """``id, score``: latest memories of a project or all projects, by the sum of both fields' scores if every term matches, or newest first."""
    wanted = [F.col("is_latest")]
    if project is not None:
        wanted.append(F.col("project").isin(project, "global"))
    if category is not None:
        wanted.append(F.col("category") == category)
    scope = memory.where(reduce(lambda a, b: a & b, wanted))
    if plain(query):
        return scope.orderBy(F.desc("created_s"), "id").limit(limit).select("id", F.lit(0.0).alias("score"))
    title, content = (index.bm25(field, query, every=True).withColumnRenamed("score", field) for field in ("title", "content"))
    both = title.join(content, "id", "full").select("id", (F.coalesce("title", F.lit(0.0)) + F.coalesce("content", F.lit(0.0))).alias("score"))
    return top(scoped(both, scope), limit)


def listed_observations(obs: DataFrame, index: TextIndex, query: str | None, limit: int = 100, session: int | None = None) -> DataFrame:
    """Observations of which one field holds every term of the query, newest first; all of them without a query."""
    scope = obs if session is None else obs.where(F.col("session_id") == session)
    found = scope if plain(query) else scope.join(index.matching(["title", "narrative"], query), "id", "left_semi")
    return found.orderBy(F.desc("ts_us"), "id").limit(limit)


def listed_runs(runs: DataFrame, index: TextIndex, query: str | None, limit: int = 20, project: str | None = None) -> DataFrame:
    """Runs by fused ranks of prompt and lesson, or the newest ones."""
    scope = runs if project is None else runs.where(F.col("project") == project)
    if plain(query):
        return scope.orderBy(F.desc("started_s"), "id").limit(limit).withColumn("score", F.lit(0.0))
    fused = fuse([index.top(field, query, limit, scope) for field in ("prompt", "lesson")], 60, limit)
    return scope.join(fused, "id").orderBy(F.desc("score"), "id")


def search_runs(runs: DataFrame, index: TextIndex, query: str, limit: int, k: int = 60, weight: float = 0.7) -> DataFrame:
    """Closed runs with a lesson, by fused ranks of prompt and lesson."""
    closed = runs.where("ended_s is not null and lesson <> ''")
    fused = fuse([index.top(field, query, limit, closed) for field in ("prompt", "lesson")], k, limit)
    found = closed.select("id", "session_id", "prompt", "outcome").join(fused, "id")
    return found.select("id", F.col("session_id").cast("string").alias("session_id"), text.cut(F.col("prompt"), 80).alias("title"), F.concat(F.lit("run:task:"), F.col("outcome")).alias("obs_type"), F.lit(5).alias("importance"), (F.col("score") * weight).alias("score"))


def search_observations(obs: DataFrame, index: TextIndex, query: str, limit: int, k: int, vectors: DataFrame | None = None, project: str | None = None) -> DataFrame:
    scope = obs if project is None else obs.where(F.col("project") == project)
    branches = [index.top(field, query, limit, None if project is None else scope) for field in ("title", "narrative")]
    if vectors is not None:
        branches.append(vectors)
    found = scope.select("id", "session_id", "title", "obs_type", "importance").join(fuse(branches, k, limit), "id")
    return found.select("id", F.col("session_id").cast("string").alias("session_id"), "title", "obs_type", F.col("importance").cast("int").alias("importance"), "score")


def tagged(results: DataFrame, table: str) -> DataFrame:
    """Ids as ``table:key``."""
    return results.withColumn("id", F.concat(F.lit(f"{table}:"), F.col("id").cast("string")))


@dataclass(frozen=True)
class Indexes:
    """The indexes that searches over several tables read."""

    observation: TextIndex
    memory: TextIndex
    run: TextIndex


def search_text(obs: DataFrame, memory: DataFrame, indexes: Indexes, query: str, limit: int, now_s: int) -> DataFrame:
    both = tagged(search_observations(obs, indexes.observation, query, limit, 60), "observation").unionByName(tagged(search_memories(memory, indexes.memory, query, limit, now_s), "memory"))
    return top(both, limit)


def search_hybrid(
    obs: DataFrame,
    memory: DataFrame,
    runs: DataFrame,
    indexes: Indexes,
    query: str,
    limit: int,
    now_s: int,
    edges: DataFrame | None = None,
    memory_vectors: DataFrame | None = None,
    obs_vectors: DataFrame | None = None,
    project: str | None = None,
    config: Config = Config(),
) -> DataFrame:
    """Observations, memories and half as many runs on one scale; expanded along edges and diversified.

    Memories alone are scoped by the project. The vector switch concerns memories alone.
    """
    found = tagged(search_observations(obs, indexes.observation, query, limit, config.k, obs_vectors), "observation")
    found = found.unionByName(tagged(search_memories(memory, indexes.memory, query, limit, now_s, project, memory_vectors, config), "memory"))
    found = top(found.unionByName(tagged(search_runs(runs, indexes.run, query, limit // 2), "run")), limit)
    if edges is not None and config.graph:
        found = top(expand(found, edges, memory, now_s), limit)
    return diversify(found) if config.diversify else found


def expand(results: DataFrame, edges: DataFrame, memory: DataFrame, now_s: int, damping: float = 0.5) -> DataFrame:
    """Adds latest memories that memory hits point to and that are no hits themselves, scored by the best edge."""
    results = checkpoint(results)  # a stated top, used three times: it is found once
    seeds = results.where(F.col("id").startswith("memory:")).select(F.regexp_extract("id", "[^:]*$", 0).cast("long").alias("src"), "score")
    out = edges.where(F.col("relation").isin("similar_to", "elaborates")).join(F.broadcast(seeds), "src")
    best = out.groupBy("dst").agg(F.max(F.struct((F.col("score") * damping * F.col("edge_score")).alias("s"), "relation", "via")).alias("b"))
    fresh = best.join(seeds.select(F.col("src").alias("dst")), "dst", "left_anti")  # an observation or a run may have a memory's number
    joined = memory.where("is_latest").join(fresh, F.col("id") == F.col("dst"))
    age = scores.age_days(F.lit(now_s), F.col("created_s"))
    added = joined.select(
        F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("session_id"),
        "title",
        F.concat(F.lit("memory:"), "category", F.lit("@"), "b.relation", F.lit(":"), "b.via").alias("obs_type"),
        F.floor(10 * F.col("strength")).cast("int").alias("importance"),
        scores.recency_access(F.col("b.s") * F.col("strength"), age, F.col("retrieval_count")).alias("score"),
    )
    return results.unionByName(added)


def bump(memory: DataFrame, hits: DataFrame, now_s: int) -> DataFrame:
    """The next version of the memory table after hits were returned."""
    hit = hits.select("id").distinct().withColumn("_hit", F.lit(1))
    joined = memory.join(hit, "id", "left")
    touched = F.col("_hit").isNotNull()
    return joined.withColumn("retrieval_count", F.col("retrieval_count") + F.when(touched, 1).otherwise(0)).withColumn("last_s", F.when(touched, F.lit(now_s)).otherwise(F.col("last_s"))).drop("_hit")


def rerank(results: DataFrame, score: Column, top_n: int = 20) -> DataFrame:
    """The first ``top_n`` memory rows get a scorer's score instead of their own; the others are not ranked."""
    memories = results.where(F.col("obs_type").startswith("memory:"))
    few = top(memories.select("id", "score"), top_n).select("id", F.lit(True).alias("_few"))
    told = results.join(F.broadcast(few), "id", "left")  # ``top_n`` rows
    return told.withColumn("score", F.when(F.col("_few") & F.col("obs_type").startswith("memory:"), score).otherwise(F.col("score"))).drop("_few")


def overlap_score(query: str, document: Column) -> Column:
    """An offline scorer: the share of the query's terms that a document holds."""
    asked = F.lit(list(dict.fromkeys(_tokens(query))))
    return F.size(F.array_intersect(asked, text.tokens(document))) / F.size(asked)


def _tokens(query: str) -> list[str]:
    return regex.findall(text.TOKEN, query.lower())


def listwise(results: DataFrame, memory: DataFrame, query: str, model: Callable[[str], str], top_n: int = 20) -> DataFrame:
    """The first memory rows in the order that a language model tells; unchanged if there are under two, or its reply is no order of them.

    The prompt has the few rows' titles and first 240 characters; results are a stated top.
    """
    results = checkpoint(results)  # used for the prompt and for the reply
    few = top(results.where(F.col("obs_type").startswith("memory:")), top_n)
    told = few.join(memory.select(F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("id"), "content"), "id")
    rows = top(told, top_n).select(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "id", "title", "content").alias("r")).agg(F.collect_list("r").alias("l"))
    ordered = F.sort_array("l")
    asked = rows.select(ordered["id"].alias("ids"), text.listwise_prompt(query, ordered["title"], ordered["content"]).alias("prompt")).head()
    if len(asked["ids"]) < 2:
        return results
    reply = results.sparkSession.createDataFrame([(asked["ids"], model(asked["prompt"]))], "ids array<string>, reply string")
    order = F.from_json(text.json_slice(F.col("reply")), "`order` array<int>")["order"]
    given = reply.select("ids", F.explode(text.permutation_scores(order, F.size("ids"))).alias("x")).select(F.get("ids", F.col("x.item")).alias("id"), F.col("x.score").alias("told"))
    return results.join(F.broadcast(given), "id", "left").withColumn("score", F.coalesce("told", "score")).drop("told")
