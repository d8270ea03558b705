"""Edges that tell where records come from: sessions, runs, commits, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.operators.lifecycle import open_at


def named(table: str, key: Column) -> Column:
    """The name of a node, ``table:id``."""
    return F.concat(F.lit(f"{table}:"), key.cast("string"))


def edges(rows: DataFrame, src: Column, dst: Column, relation: str, score: float | Column = 1.0, via: str = "system") -> DataFrame:
    """Edges ``src, dst, relation, via, edge_score`` of rows with both ends."""
    value = score if isinstance(score, Column) else F.lit(score)
    made = rows.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(via).alias("via"), value.alias("edge_score"))
    return made.where("src is not null and dst is not null")


def follows(runs: DataFrame) -> DataFrame:
    """Run to the run of its session that ended before it."""
    window = Window.partitionBy("session_id").orderBy("ended_s", "id")
    return runs.where("ended_s is not null").select(F.col("id").alias("src"), F.lag("id").over(window).alias("dst")).where("dst is not null")


def run_edges(runs: DataFrame) -> DataFrame:
    """Runs as parts of their sessions, and closed runs as followers of the one before."""
    part = edges(runs, named("run", F.col("id")), named("session", F.col("session_id")), "part_of")
    return part.unionByName(edges(follows(runs), named("run", F.col("src")), named("run", F.col("dst")), "follows"))


def memory_edges(memories: DataFrame, runs: DataFrame) -> DataFrame:
    """Memories ``id, session_id, at_s`` to the run that was open when they were saved, and to what it had recalled.

    Runs have ``id, session_id, started_s, ended_s, recalled`` (an array of memory ids).
    """
    inside = open_at(memories, runs, "session_id", "at_s").where("span_id is not null")
    made = edges(inside, named("memory", F.col("id")), named("run", F.col("span_id")), "generated_by")
    recalled = inside.join(runs.select(F.col("id").alias("span_id"), F.explode(F.array_distinct("recalled")).alias("r")), "span_id").where("r <> id")
    return made.unionByName(edges(recalled, named("memory", F.col("id")), named("memory", F.col("r")), "derived_from", 0.8))


def commit_edges(commits: DataFrame, runs: DataFrame) -> DataFrame:
    """Commits ``id, run_id`` to their run, and the plan of that run to the commit."""
    made = edges(commits, named("commit", F.col("id")), named("run", F.col("run_id")), "generated_by")
    planned = commits.select("id", "run_id").join(runs.select(F.col("id").alias("run_id"), "plan_id"), "run_id")
    return made.unionByName(edges(planned, named("plan", F.col("plan_id")), named("commit", F.col("id")), "implemented_by"))


def informed_edges(hits: DataFrame, run: Column) -> DataFrame:
    """Memories ``id, score`` that a search found to the run they were found for."""
    return edges(hits, named("memory", F.col("id")), named("run", run), "informed", F.col("score"))


def motivated_edges(plans: DataFrame, runs: DataFrame) -> DataFrame:
    """Memories that a run had recalled to the plan ``id, run_id`` that was made in it."""
    recalled = plans.join(runs.select(F.col("id").alias("run_id"), F.explode(F.array_distinct("recalled")).alias("r")), "run_id")
    return edges(recalled, named("memory", F.col("r")), named("plan", F.col("id")), "motivated", 0.7)
