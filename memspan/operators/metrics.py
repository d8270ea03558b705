"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.operators import retrieval as R
from memspan.operators.textindex import TextIndex


def graded(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results ``query_id, id, rank`` with ``hit``, and every query of the gold set ``query_id, id``."""
    return results.join(gold.withColumn("hit", F.lit(True)), ["query_id", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def per_query(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``recall_any``, ``ndcg`` and ``mrr`` of each query of the gold set."""
    sizes = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"))
    hits = graded(results, gold).where("hit").groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("gold").cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    joined = sizes.join(hits, "query_id", "left")
    return joined.select(
        "query_id",
        F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias("recall_any"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def bench_search(index: TextIndex, field: str, query: str, limit: int = 20, vectors: DataFrame | None = None) -> DataFrame:
    """A benchmark's search of one field: BM25, or its ranks fused with those of vectors (k 60), in that order."""
    found = index.bm25(field, query)
    return R.top(found, limit) if vectors is None else R.fuse([R.top(found, limit), vectors], 60, limit)


def oracle_ranks(results: DataFrame, oracle: DataFrame) -> DataFrame:
    """``probe, rank``: where each probe's memory ``title`` stands in its results ``probe, title, obs_type, rank``, from 0; null if nowhere."""
    hits = results.where(F.col("obs_type").startswith("memory:")).join(oracle, ["probe", "title"]).groupBy("probe").agg(F.min("rank").alias("rank"))
    return oracle.select("probe").join(hits, "probe", "left")


def competitors(results: DataFrame, ranks: DataFrame, most: int = 3) -> DataFrame:
    """``probe, titles``: the first memories that stand above a probe's own, or above all if it is not there."""
    above = results.where(F.col("obs_type").startswith("memory:")).join(ranks.withColumnRenamed("rank", "own"), "probe").where("own is null or rank < own")
    window = Window.partitionBy("probe").orderBy("rank")
    few = above.withColumn("nth", F.row_number().over(window)).where(F.col("nth") <= most)
    return few.groupBy("probe").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"]).alias("titles"))


def miss_report(results: DataFrame, oracle: DataFrame, k: int = 5) -> DataFrame:
    """Probes whose memory is not among the first ``k``, with what stands above it: those in the pool by rank, then the others, by title."""
    ranks = oracle_ranks(results, oracle)
    missed = ranks.where(F.col("rank").isNull() | (F.col("rank") >= k))
    return missed.join(oracle, "probe").join(competitors(results, ranks), "probe", "left").orderBy(F.col("rank").isNull(), "rank", "title", "probe")


def recall_at(ranks: DataFrame, *ks: int) -> DataFrame:
    """``k, recall, mrr`` over ranks from 0."""
    at = F.explode(F.array(*(F.lit(k) for k in ks)))
    hit = F.when(F.col("rank") < F.col("k"), 1.0).otherwise(0.0)
    return ranks.select("rank", at.alias("k")).groupBy("k").agg(F.avg(hit).alias("recall"), F.avg(F.coalesce(1.0 / (F.col("rank") + 1.0), F.lit(0.0))).alias("mrr"))


def injected(context: Column, title: Column) -> Column:
    """Whether a context tells a memory's title."""
    return F.contains(context, title)
