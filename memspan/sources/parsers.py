"""Text sources: numstat, diffs, settings, hook events, retrieval benchmarks; the JSON export."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspan.functions import text

#: A hook event as it is posted.
HOOK_SCHEMA = "hookType string, hook_type string, sessionId string, session_id string, project string, cwd string, timestamp timestamp, source string, data string"


def numstat(lines: DataFrame, key: str, line: str) -> DataFrame:
    """``insertions <tab> deletions <tab> path`` lines, summed by ``key``; ``-`` counts as 0."""
    parts = F.split(F.col(line), "\t", 3)
    count = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("long"), F.lit(0))
    rows = lines.where(F.size(parts) == 3).select(key, count(0).alias("i"), count(1).alias("d"), F.get(parts, F.lit(2)).alias("f"))
    return rows.groupBy(key).agg(F.collect_list("f").alias("files"), F.sum("i").alias("insertions"), F.sum("d").alias("deletions"))


def diff_lines(diffs: DataFrame, key: str, body: str) -> DataFrame:
    """Lines of diffs with their file's number and kind."""
    lines = diffs.select(key, F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    header = F.col("line").startswith("diff --git")
    kind = (
        F.when(header, "file")
        .when(F.col("line").startswith("@@"), "hunk")
        .when(F.col("line").rlike(r"^(\+\+\+|---)"), "meta")
        .when(F.col("line").startswith("+"), "add")
        .when(F.col("line").startswith("-"), "del")
        .otherwise("ctx")
    )
    window = Window.partitionBy(key).orderBy("pos")
    return lines.select(key, "pos", "line", kind.alias("kind"), F.sum(header.cast("int")).over(window).alias("file_no"))


def settings(path: str, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings of an env file; the file goes before the process's environment."""
    out = dict(os.environ if environment is None else environment)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in map(str.strip, lines):
                name, mark, value = line.partition("=")
                if mark and not line.startswith("#"):
                    out[name.strip()] = value.strip().strip("\"'")
    return out


def hook_events(raw: DataFrame) -> DataFrame:
    """Posted events under one spelling."""
    return raw.select(
        F.coalesce("hookType", "hook_type").alias("hook"),
        F.coalesce("sessionId", "session_id").alias("session_id"),
        F.coalesce("project", "cwd").alias("project"),
        "cwd",
        "timestamp",
        "source",
        F.coalesce("data", F.lit("{}")).alias("data"),
    )


def read_hooks(spark: SparkSession, path: str) -> DataFrame:
    return hook_events(spark.read.schema(HOOK_SCHEMA).json(path))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """One row for each session of a nested retrieval benchmark, with the start of its content that is embedded; abstention questions are left out."""
    rows = spark.read.option("multiLine", True).json(path).where(~F.col("question_type").endswith("_abs"))
    zipped = rows.select("question_id", "question_type", "question", "answer_session_ids", F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("s"))
    turns = F.transform("s.haystack_sessions", lambda t: F.concat_ws(": ", t["role"], t["content"]))
    content = F.array_join(turns, "\n")
    told = zipped.select("question_id", "question_type", "question", "answer_session_ids", F.col("s.haystack_session_ids").alias("session_id"), content.alias("content"))
    return told.withColumn("embedded", text.first_bytes(F.col("content"), 512))


def export(tables: Mapping[str, DataFrame], path: str, version: str, exported_at: str) -> None:
    """Every table as JSON lines in a folder of its own, and a manifest; nothing passes through the driver."""
    for name, df in tables.items():
        df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row")).write.mode("overwrite").json(f"{path}/{name}")
    first = next(iter(tables.values())).sparkSession
    first.createDataFrame([(version, exported_at, sorted(tables))], "version string, exported_at string, tables array<string>").write.mode("overwrite").json(f"{path}/manifest")


def write_results(metrics: DataFrame, path: str) -> None:
    """A benchmark's results as JSON lines, a row each."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
