"""Plans and core memory: upserts, status changes that keep core memory in step, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the mark that goals made of plans carry.
GOAL_MARK = "📋 "
SECTIONS = ("goals", "invariants", "watchlist")


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of both by key, the one of the highest ``version`` of each; new rows go before old ones of the same."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    window = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth", "_new")


def status_set(plans: DataFrame, changed: DataFrame, status: str) -> DataFrame:
    """Plans after those of ``changed`` (by ``id``) got a status."""
    marked = changed.select("id").distinct().withColumn("_hit", F.lit(True))
    return plans.join(marked, "id", "left").withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def core_synced(core: DataFrame, plans: DataFrame, op: str) -> DataFrame:
    """Core memory after plans ``project, title, files`` were activated (``add``) or ended (``remove``).

    All plans of a project change its row together.
    """
    if op not in ("add", "remove"):
        raise ValueError(f"unsupported op {op}: add or remove")
    changes = plans.groupBy("project").agg(F.sort_array(F.collect_set(F.concat(F.lit(GOAL_MARK), "title"))).alias("_goals"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("files")))).alias("_files"))
    joined = core.join(changes, "project", "left")

    def after(name: str, change: str) -> Column:
        edited = F.array_distinct(F.concat(name, change)) if op == "add" else F.array_except(name, change)
        return F.when(F.col(change).isNotNull(), edited).otherwise(F.col(name))

    return joined.withColumn("goals", after("goals", "_goals")).withColumn("watchlist", after("watchlist", "_files")).drop("_goals", "_files")


def rendered(identity: Column, goals: Column, invariants: Column, watchlist: Column) -> Column:
    """Core memory as markdown; empty where nothing is set."""
    said = F.trim(F.coalesce(identity, F.lit("")))
    lists = [F.coalesce(x, F.array().cast("array<string>")) for x in (goals, invariants, watchlist)]
    parts = [F.when(said != "", F.concat(F.lit("**Identity:** "), said, F.lit("\n")))]
    for name, items in zip(SECTIONS, lists, strict=True):
        listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
        parts.append(F.when(F.size(items) > 0, F.concat(F.lit(f"**{name.capitalize()}:**\n"), listed)))
    body = F.concat_ws("", *parts)
    return F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("# Core\n\n"), body, F.lit("\n")))


def recorded(commits: DataFrame, files: DataFrame, spans: DataFrame) -> DataFrame:
    """Commits once each, the earliest of a sha, with their number of files and the latest run that was open then.

    ``commits`` has ``id, sha, session_id, at_s``; ``files`` has ``commit_id, file``.
    """
    from memspan.operators.lifecycle import latest, open_at

    first = latest(commits, ["sha"], [F.col("at_s"), F.col("id")])
    sizes = files.groupBy(F.col("commit_id").alias("id")).agg(F.countDistinct("file").alias("files"))
    runs = open_at(first.select("id", "session_id", "at_s"), spans, "session_id", "at_s").withColumnRenamed("span_id", "run_id")
    return first.join(sizes, "id", "left").join(runs, "id", "left").withColumn("files", F.coalesce("files", F.lit(0)))
