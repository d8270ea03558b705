"""Maintenance: what to forget, contradictions, stop keywords, clusters, decay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.functions import scores
from memspan.operators.graph import shared_tokens
from memspan.sources.tables import checkpoint


def stop_keywords(items: DataFrame, keywords: str = "keywords") -> DataFrame:
    """Keywords that over half of the items hold."""
    half = items.agg((F.count(F.lit(1)) / 2).cast("long").alias("h")).scalar()
    counted = items.select(F.explode(F.array_distinct(keywords)).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    return counted.where(F.col("df") > half)


def contradictions(memory: DataFrame, least: float = 0.9, newest: int = 100) -> DataFrame:
    """``newer, older`` among the newest memories that share a keyword and nearly all words."""
    recent = memory.orderBy(F.col("created_s").desc(), "id").limit(newest)
    # The few rows are used four times; they are found once.
    words = checkpoint(recent.select("id", "created_s", F.transform("keywords", lambda k: F.lower(k)).alias("keywords"), scores.long_words(F.col("content")).alias("words")))
    pairs = shared_tokens(words, "keywords", 0.0).select("src", "dst")
    a = words.select(F.col("id").alias("src"), F.col("created_s").alias("ta"), F.col("words").alias("wa"))
    b = words.select(F.col("id").alias("dst"), F.col("created_s").alias("tb"), F.col("words").alias("wb"))
    near = F.least(F.size("wa"), F.size("wb")) >= least * F.greatest(F.size("wa"), F.size("wb"))  # sets of unlike sizes are not alike
    alike = pairs.join(a, "src").join(b, "dst").where(near).withColumn("jaccard", scores.jaccard(F.col("wa"), F.col("wb"))).where(F.col("jaccard") >= least)
    first = (F.col("ta") > F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("src") < F.col("dst")))
    return alike.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("newer"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("older"), "jaccard")


#: Pairs up to which one task works through them; beyond, all that can be decided is decided in rounds.
TASK_PAIRS = 50_000


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place in an order, from 1, without one task for all: ranges are numbered, and then moved by what lies before them."""
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()  # a row for each range
    starts, total = [], 0
    for row in sizes:
        starts.append((row["_range"], total))
        total += row["n"]
    before = df.sparkSession.createDataFrame(starts, "_range int, _before bigint")
    window = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.row_number().over(window) + F.col("_before")).drop("_range", "_before")


def clusters(memory: DataFrame, newest: int | None = 100, least: float = 0.4, smallest: int = 3, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """``cluster, id``: greedy clusters, in the order of their time, of the newest memories, or of all.

    Seeds come in order; a seed gathers later unclustered memories alike it; too small
    clusters release theirs.
    """
    order = [F.col("created_s").desc(), F.col("id")]
    recent = numbered(memory.orderBy(*order).limit(newest) if newest is not None else memory, order, "pos")
    stop = stop_keywords(recent.select("id", "keywords")).agg(F.collect_list("keyword").alias("s")).scalar()
    told = recent.select("pos", "id", F.array_except("keywords", stop).alias("keywords"))
    pairs = checkpoint(shared_tokens(told.select(F.col("pos").alias("id"), "keywords"), "keywords", least).select("src", "dst"))
    found = in_one_task(pairs, smallest) if pairs.count() <= task_pairs else in_rounds(pairs, smallest)
    names = told.select("pos", "id")
    return found.join(names.select(F.col("pos").alias("seed"), F.col("id").alias("cluster")), "seed").join(names, "pos").select("cluster", "id")


def in_one_task(pairs: DataFrame, smallest: int) -> DataFrame:
    """``seed, pos`` of clusters, one seed after the other, of pairs ``src < dst`` that are few."""

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in sorted(zip(rows["src"], rows["dst"], strict=True)):
            near.setdefault(int(a), []).append(int(b))
        taken: set[int] = set()
        out = []
        for seed in sorted(near):
            group = [seed, *(p for p in near[seed] if p not in taken)]
            if seed not in taken and len(group) >= smallest:
                taken.update(group)
                out += [(seed, p) for p in group]
        return pd.DataFrame(out, columns=["seed", "pos"]).astype("int64")

    if smallest < 2:
        raise ValueError("clusters have two members at least")
    return pairs.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(greedy, "seed long, pos long")  # a stated number of pairs


def in_rounds(pairs: DataFrame, smallest: int) -> DataFrame:
    """``seed, pos``: the same clusters of any number of pairs, in rounds.

    What a node does depends on earlier nodes alone: on its earlier neighbours, which may take it,
    and on the earlier neighbours of its later neighbours, which may take those. A node decides
    when it is the first undecided one among all these. Of a round all such nodes decide
    together; each node that is taken is so by the one undecided node that was first at it.
    """
    live, out = pairs, None
    while not live.isEmpty():
        # ``live`` has pairs whose source is undecided and whose end is not taken; the first at an end, and at a source as an end.
        first = live.groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("first"))
        told = live.join(first.select(F.col("at").alias("dst"), F.col("first").alias("at_end")), "dst").join(first.select(F.col("at").alias("src"), F.col("first").alias("at_source")), "src", "left")
        flags = told.groupBy("src").agg((F.count("at_source") == 0).alias("free"), F.bool_and(F.col("at_end") == F.col("src")).alias("leads"), F.count(F.lit(1)).alias("ends"))
        ready = checkpoint(flags.where("free and leads").select("src", (F.col("ends") + 1 >= smallest).alias("seeds")))
        taken = checkpoint(live.join(ready.where("seeds"), "src").select(F.col("src").alias("seed"), F.col("dst").alias("pos")))
        made = taken.unionByName(ready.where("seeds").select(F.col("src").alias("seed"), F.col("src").alias("pos")))
        out = made if out is None else out.unionByName(made)
        gone = taken.select(F.col("pos").alias("src")).unionByName(ready.select("src"))
        live = checkpoint(live.join(gone.distinct(), "src", "left_anti").join(taken.select(F.col("pos").alias("dst")), "dst", "left_anti").select("src", "dst"))
    return pairs.select(F.col("src").alias("seed"), F.col("dst").alias("pos")).limit(0) if out is None else out


def superseded(memory: DataFrame, newer: DataFrame) -> DataFrame:
    """Memories after newer ones ``id`` took the place of ``older``: the old is no longer the latest, the new one tells what it supersedes."""
    old = newer.groupBy(F.col("older").alias("id")).agg(F.min("id").alias("_by"))
    new = newer.groupBy("id").agg(F.array_sort(F.collect_set("older")).alias("_of"))
    joined = memory.join(old, "id", "left").join(new, "id", "left")
    known = F.coalesce(F.col("supersedes"), F.array().cast("array<bigint>")) if "supersedes" in memory.columns else F.array().cast("array<bigint>")
    changed = {"is_latest": F.col("is_latest") & F.col("_by").isNull(), "superseded_by": F.col("_by"), "supersedes": F.array_union(known, F.coalesce("_of", F.array().cast("array<bigint>")))}
    return joined.withColumns(changed).drop("_by", "_of")


def to_forget(memory: DataFrame, obs: DataFrame, now_s: int) -> DataFrame:
    """``action, id`` of everything that garbage collection would remove or mark."""
    expired = memory.where(F.col("forget_s") < now_s).select(F.lit("expired").alias("action"), "id")
    weak = memory.where("strength < 0.1").select(F.lit("weak").alias("action"), "id")
    stale = obs.where((F.col("at_s") < now_s - 180 * scores.DAY) & (F.col("importance") <= 2)).select(F.lit("stale").alias("action"), "id")
    older = contradictions(memory.where("is_latest")).select(F.lit("contradicted").alias("action"), F.col("older").alias("id")).distinct()
    return expired.unionByName(weak).unionByName(stale).unionByName(older)
