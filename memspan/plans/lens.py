"""Domain views over the test tables.

Each view is one SQL text for both engines; ``{micros}`` is the only part that differs:
microseconds of a time stamp without zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from memspan.sources.tables import read_table

#: The time at which queries are asked, 1 June 2024.
NOW = 1_717_200_000
MICROS = {"spark": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})", "duckdb": "epoch_us({})"}

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
VIEWS = {
    "ev": f"""
        SELECT event_id, user_id, event_type, value, {{micros:ts}} AS ts_us, {_K} AS k, 'proj' || CAST(user_id % 5 AS STRING) AS project FROM events""",
    "session": """
        SELECT user_id AS id, max(project) AS project, min(ts_us) AS started_us, max(ts_us) AS ended_us, count(*) AS observation_count,
               CASE WHEN user_id % 3 = 0 THEN 'active' ELSE 'ended' END AS status
        FROM ev GROUP BY user_id""",
    "observation": """
        SELECT event_id AS id, user_id AS session_id, project, ts_us, CAST(floor(ts_us / 1000000) AS BIGINT) AS at_s,
               CASE event_type WHEN 'view' THEN 'file_read' WHEN 'click' THEN 'file_edit' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'task' ELSE 'conversation' END AS obs_type,
               CASE event_type WHEN 'error' THEN 7 WHEN 'purchase' THEN 6 WHEN 'click' THEN 5 WHEN 'signup' THEN 4 ELSE 2 END AS importance,
               event_type || ' m' || CAST(k % 20 AS STRING) || ' of ' || project AS title,
               'used m' || CAST(k % 20 AS STRING) || ' for k' || CAST(k AS STRING) || ' in ' || event_type AS narrative,
               event_type AS kw1, 'k' || CAST(k AS STRING) AS kw2, 'src/m' || CAST(k % 20 AS STRING) || '.rs' AS file
        FROM ev""",
    "hook": """
        SELECT event_id AS id, user_id AS session_id, project, ts_us, hook, tool,
               '{' || CASE WHEN tool = '' THEN '' ELSE '"tool_name":"' || tool || '",' END || '"tool_input":{"file_path":"' || path || '","command":"' || command || '"},"tool_output":"' || output || '","prompt":"' || prompt || '"}' AS data
        FROM (
          SELECT *, CASE event_type WHEN 'signup' THEN 'prompt_submit' WHEN 'purchase' THEN 'task_completed' WHEN 'error' THEN 'post_tool_failure' ELSE 'post_tool_use' END AS hook,
                 CASE WHEN event_type = 'error' THEN 'Bash' WHEN event_type = 'view' AND k % 3 = 0 THEN 'Read' WHEN event_type = 'view' THEN 'Grep'
                      WHEN event_type = 'click' AND k % 4 = 0 THEN 'Write' WHEN event_type = 'click' AND k % 4 = 1 THEN 'Edit' WHEN event_type = 'click' THEN 'Bash' ELSE '' END AS tool,
                 CASE WHEN k % 4 = 2 THEN '' ELSE '/home/dev/app' || CAST(k % 5 AS STRING) || '/core/m' || CAST(k % 20 AS STRING) || '.rs' END AS path,
                 CASE k % 5 WHEN 0 THEN 'git add . && git commit -m fix' || CAST(k AS STRING) WHEN 1 THEN '# note' || chr(92) || 'ncargo test | tail -n 3' WHEN 2 THEN 'git commit --dry-run'
                            WHEN 3 THEN 'git -p commit; ls' ELSE 'git status' END AS command,
                 CASE k % 5 WHEN 0 THEN 'done' || chr(92) || 'n[main ' || substring(md5(CAST(k AS STRING)), 1, 8) || '] fix ' || CAST(k AS STRING) WHEN 1 THEN '' WHEN 2 THEN 'a' || chr(92) || 'nb' || chr(92) || 'nc' || chr(92) || 'nd'
                            WHEN 3 THEN '[dev (root-commit) ' || substring(md5(CAST(k AS STRING)), 1, 7) || '] first' ELSE '[odd line' END AS output,
                 'please look at m' || CAST(k % 20 AS STRING) || ' and tell what k' || CAST(k AS STRING) || ' does' AS prompt
          FROM ev) AS h""",
    "memory": f"""
        SELECT doc_id AS id, source AS project, lang AS category, substring(split_part(text, chr(10), 1), 1, 80) AS title, text AS content,
               CAST((doc_id * 37) % 100 + 1 AS DOUBLE) / 100 AS strength, doc_id % 30 AS retrieval_count, {NOW} - (doc_id % 365) * 86400 AS created_s,
               doc_id % 11 <> 0 AS is_latest, CASE WHEN doc_id % 13 = 0 THEN {NOW} - 1000 + doc_id END AS forget_s, CAST(NULL AS BIGINT) AS last_s,
               'n' || CAST(doc_id % 50 AS STRING) AS kw1, 'q' || CAST(doc_id % 7 AS STRING) AS kw2, lang AS kw3,
               'src/f' || CAST(doc_id % 40 AS STRING) || '.rs' AS f1, 'lib/g' || CAST(doc_id % 9 AS STRING) || '.py' AS f2
        FROM documents""",
    "turns": """
        SELECT conv_id, turn, role, text, conv_id * 100 + turn AS id FROM conversations""",
    "run": f"""
        SELECT conv_id AS id, conv_id % 20 AS session_id, 'proj' || CAST(conv_id % 5 AS STRING) AS project, max(CASE WHEN turn = 0 THEN text END) AS prompt,
               max(CASE WHEN turn = 1 THEN text END) AS lesson, {NOW} - 100000 + min(conv_id) * 700 AS started_s,
               CASE WHEN conv_id % 10 < 9 THEN {NOW} - 100000 + min(conv_id) * 700 + 60 * count(*) END AS ended_s,
               CASE conv_id % 3 WHEN 0 THEN 'committed' WHEN 1 THEN 'uncommitted' ELSE 'success' END AS outcome
        FROM turns GROUP BY conv_id""",
    "commits": """
        SELECT o_orderkey AS id, o_orderpriority AS project, 'branch' || o_orderstatus AS branch, o_custkey AS author, {micros:o_orderdate} AS at_us FROM orders""",
    "commit_files": """
        SELECT DISTINCT l_orderkey AS commit_id, 'src/p' || CAST(l_partkey % 300 AS STRING) AS file FROM lineitem""",
    "plan": """
        SELECT s_suppkey AS id, 'proj' || CAST(s_nationkey % 5 AS STRING) AS project, s_name AS title,
               CASE s_suppkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'abandoned' ELSE 'active' END AS status, s_acctbal AS weight FROM supplier""",
    "plan_files": """
        SELECT id AS plan_id, 'src/p' || CAST((id * 17 + i * (id % 5 + 1)) % 300 AS STRING) AS file FROM plan CROSS JOIN (VALUES (0), (1)) AS v(i)""",
    "edge": f"""
        SELECT id AS src, (id * 7 + 1) % 997 AS dst, CASE id % 3 WHEN 0 THEN 'similar_to' WHEN 1 THEN 'elaborates' ELSE 'mentions' END AS relation,
               CASE id % 2 WHEN 0 THEN 'keyword' ELSE 'embedding' END AS via, CAST(id % 10 + 1 AS DOUBLE) / 10 AS edge_score, {NOW} - id AS created_s FROM memory""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view_sql(name: str, dialect: str) -> str:
    """A view's text for one engine."""
    return re.sub(r"\{micros:(\w+)\}", lambda m: MICROS[dialect].format(m[1]), VIEWS[name])


def needed(sql: str) -> list[str]:
    """The views that a text refers to, directly or not, in the order of their definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        fresh = {v for v in VIEWS if v in words} - found
        found |= fresh
        todo += [VIEWS[v] for v in fresh]
    return [v for v in VIEWS if v in found]


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it needs as common table expressions."""
    parts = [f"{v} AS ({view_sql(v, 'duckdb')})" for v in needed(sql)]
    body = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{', '.join(parts)}{', ' if parts else ''}{body[m.end() :]}"
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Lens:
    """Tables and views of a data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = read_table(self._spark, self._dir, name)
            else:
                inner = set(re.findall(r"\w+", VIEWS[name])) - {name}
                parts = {n: getattr(self, n) for n in [*TABLES, *VIEWS] if n in inner}
                sql = view_sql(name, "spark")
                for n in parts:
                    sql = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
                self._made[name] = self._run(sql, parts)
        return self._made[name]

    def _run(self, sql: str, parts: dict[str, DataFrame]) -> DataFrame:
        names = {}
        for n, df in parts.items():
            names[n] = f"memspan_{n}_{id(self)}"
            df.createOrReplaceTempView(names[n])
        for n, view in names.items():
            sql = sql.replace("{" + n + "}", view)
        out = self._spark.sql(sql)
        for view in names.values():
            self._spark.catalog.dropTempView(view)
        return out
