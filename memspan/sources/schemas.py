"""Schemas of the store's tables, and empty tables to begin with. Times are seconds since 1970 in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "session": "id bigint, project string, cwd string, started_s bigint, ended_s bigint, status string, observation_count bigint, model string, name string, tags array<string>",
    "observation": "id bigint, session_id bigint, project string, ts_us bigint, at_s bigint, obs_type string, title string, subtitle string, facts array<string>, narrative string, keywords array<string>, files array<string>, importance int, confidence double, embedding array<float>",
    "memory": "id bigint, project string, category string, title string, content string, keywords array<string>, files array<string>, tags array<string>, context string, strength double, retrieval_count bigint, last_s bigint, embedding array<float>, version int, parent_id bigint, superseded_by bigint, is_latest boolean, forget_s bigint, created_s bigint, updated_s bigint",
    "summary": "id bigint, session_id bigint, project string, created_s bigint, title string, narrative string, key_decisions array<string>, files array<string>, keywords array<string>, observation_count bigint",
    "fact": "id bigint, fact string, confidence double, strength double, retrieval_count bigint, last_s bigint, created_s bigint",
    "procedure": "id bigint, name string, steps array<string>, trigger_condition string, frequency bigint, strength double, created_s bigint",
    "core": "project string, identity string, goals array<string>, invariants array<string>, watchlist array<string>, updated_s bigint",
    "entity": "kind string, name string, project string, n bigint, first_s bigint, last_s bigint",
    "run": "id bigint, session_id bigint, project string, started_s bigint, ended_s bigint, prompt string, prompts array<string>, outcome string, observation_ids array<bigint>, lesson string, recalled array<bigint>, commit_id bigint, plan_id bigint",
    "edge": "src string, dst string, relation string, via string, edge_score double, created_s bigint",
    "commits": "id bigint, sha string, message string, author string, branch string, project string, files array<string>, insertions bigint, deletions bigint, is_amend boolean, session_id bigint, run_id bigint, plan_id bigint, at_s bigint, created_s bigint",
    "seen": "id bigint",
    "dedup": "key string, last_us bigint",
    "reply": "hash string, reply string, failed boolean",
    "plan": "id bigint, file_path string, title string, content string, status string, project string, keywords array<string>, files array<string>, session_id bigint, run_id bigint, commit_id bigint, created_s bigint, completed_s bigint",
}
#: ``seen`` has the ids of events that were taken in, ``dedup`` the last time kept of each key, ``reply`` what language models answered.
#: Columns that name a row of a table besides its id.
KEYS = {"commits": ("sha",), "plan": ("file_path",), "core": ("project",), "entity": ("kind", "name", "project"), "dedup": ("key",), "reply": ("hash",), "edge": ("src", "dst", "relation", "via")}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conformed(df: DataFrame, name: str) -> DataFrame:
    """A frame with just the table's columns, in its types; missing ones are null."""
    return empty(df.sparkSession, name).unionByName(df, allowMissingColumns=True).select(empty(df.sparkSession, name).columns)
