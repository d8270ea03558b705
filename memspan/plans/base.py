"""Scans, filters, listings, digests and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspan.functions import hooks, scores, text, times
from memspan.plans.book import Book, r6
from memspan.plans.lens import NOW, Lens

BOOK = Book()
PROJECT = "proj1"


@BOOK.add(
    "health_counts",
    "SELECT 'session' AS t, count(*) AS n FROM session UNION ALL SELECT 'observation', count(*) FROM observation UNION ALL SELECT 'memory', count(*) FROM memory UNION ALL SELECT 'run', count(*) FROM run UNION ALL SELECT 'commit', count(*) FROM commits",
)
def _(t: Lens) -> DataFrame:
    parts = {"session": t.events.select("user_id").distinct(), "observation": t.events, "memory": t.documents, "run": t.conversations.select("conv_id").distinct(), "commit": t.orders}
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("t"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()))


@BOOK.add("sessions_recent", "SELECT id, project, status, observation_count FROM session ORDER BY started_us DESC, id LIMIT 20")
def _(t: Lens) -> DataFrame:
    return t.session.orderBy(F.desc("started_us"), "id").limit(20).select("id", "project", "status", "observation_count")


@BOOK.add("session_by_id", "SELECT id, project, status, observation_count FROM session WHERE id = 7")
def _(t: Lens) -> DataFrame:
    return t.session.where("id = 7").select("id", "project", "status", "observation_count")


@BOOK.add("timeline_session", "SELECT id, ts_us, title, obs_type, importance FROM observation WHERE session_id = 7 ORDER BY ts_us, id LIMIT 500")
def _(t: Lens) -> DataFrame:
    return t.observation.where("session_id = 7").orderBy("ts_us", "id").limit(500).select("id", "ts_us", "title", "obs_type", "importance")


@BOOK.add("timeline_global", "SELECT id, ts_us, title FROM observation ORDER BY ts_us DESC, id LIMIT 100")
def _(t: Lens) -> DataFrame:
    return t.observation.orderBy(F.desc("ts_us"), "id").limit(100).select("id", "ts_us", "title")


@BOOK.add("observations_by_type", "SELECT obs_type, count(*) AS n FROM observation WHERE obs_type IN ('file_edit', 'error', 'task') AND obs_type NOT IN ('conversation') GROUP BY obs_type")
def _(t: Lens) -> DataFrame:
    kind = F.col("obs_type")
    return t.observation.where(kind.isin("file_edit", "error", "task") & ~kind.isin("conversation")).groupBy("obs_type").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("digest_counts", "SELECT s.project, count(DISTINCT s.id) AS sessions, CAST(sum(s.observation_count) AS BIGINT) AS observations FROM session s GROUP BY s.project")
def _(t: Lens) -> DataFrame:
    return t.session.groupBy("project").agg(F.countDistinct("id").alias("sessions"), F.sum("observation_count").alias("observations"))


_LATEST = f"SELECT * FROM observation WHERE project = '{PROJECT}' ORDER BY ts_us DESC, id LIMIT 200"


def _latest(t: Lens) -> DataFrame:
    return t.observation.where(F.col("project") == PROJECT).orderBy(F.desc("ts_us"), "id").limit(200)


@BOOK.add("digest_top_keywords", f"SELECT kw, count(*) AS n FROM (SELECT unnest([kw1, kw2]) AS kw FROM ({_LATEST})) GROUP BY kw ORDER BY n DESC, kw LIMIT 20")
def _(t: Lens) -> DataFrame:
    return _latest(t).select(F.explode(F.array("kw1", "kw2")).alias("kw")).groupBy("kw").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kw").limit(20)


@BOOK.add("digest_top_files", f"SELECT file, count(*) AS n FROM ({_LATEST}) GROUP BY file ORDER BY n DESC, file LIMIT 20")
def _(t: Lens) -> DataFrame:
    return _latest(t).groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(20)


@BOOK.add("commits_list", "SELECT id, project, branch, author FROM commits WHERE project = '1-URGENT' AND branch = 'branchO' ORDER BY at_us DESC, id LIMIT 50")
def _(t: Lens) -> DataFrame:
    given = {"project": "1-URGENT", "branch": "branchO", "author": None}
    wanted = [F.col(c) == v for c, v in given.items() if v is not None]
    return t.commits.where(reduce(lambda a, b: a & b, wanted)).orderBy(F.desc("at_us"), "id").limit(50).select("id", "project", "branch", "author")


def plans(t: Lens, status: str | None) -> DataFrame:
    return t.plan if status in (None, "all") else t.plan.where(F.col("status") == status)


@BOOK.add("plans_by_status", "SELECT id, title, status FROM plan WHERE status = 'active' ORDER BY weight DESC, id LIMIT 20")
def _(t: Lens) -> DataFrame:
    return plans(t, "active").orderBy(F.desc("weight"), "id").limit(20).select("id", "title", "status")


@BOOK.add("plans_all", "SELECT status, count(*) AS n FROM plan GROUP BY status")
def _(t: Lens) -> DataFrame:
    return plans(t, "all").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("obs_project_join", "SELECT s.project, s.status, count(*) AS n, CAST(sum(o.importance) AS BIGINT) AS importance FROM observation o JOIN session s ON o.session_id = s.id WHERE o.importance >= 4 GROUP BY s.project, s.status")
def _(t: Lens) -> DataFrame:
    joined = t.observation.where("importance >= 4").select("session_id", "importance").join(t.session.select(F.col("id").alias("session_id"), "project", "status"), "session_id")
    return joined.groupBy("project", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("importance").alias("importance"))


@BOOK.add("id_semi_join", "SELECT id, title FROM memory WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t: Lens) -> DataFrame:
    return t.memory.select("id", "title").join(t.labels.where("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi")


@BOOK.add("null_filter_open_runs", "SELECT id, session_id, started_s FROM run WHERE ended_s IS NULL")
def _(t: Lens) -> DataFrame:
    return t.run.where("ended_s is null").select("id", "session_id", "started_s")


@BOOK.add("memories_scope_or_global", "SELECT id, title FROM memory WHERE (project = 'src3' OR project = 'src0') AND is_latest AND category = 'en' AND strength > 0.3 ORDER BY created_s DESC, id LIMIT 100")
def _(t: Lens) -> DataFrame:
    scope = (F.col("project") == "src3") | (F.col("project") == "src0")
    return t.memory.where(scope & F.col("is_latest") & (F.col("category") == "en") & (F.col("strength") > 0.3)).orderBy(F.desc("created_s"), "id").limit(100).select("id", "title")


@BOOK.add("run_detail", "SELECT r.id AS run_id, u.turn, u.role, length(u.text) AS n FROM run r JOIN turns u ON u.conv_id = r.id WHERE r.id = 3 ORDER BY u.turn")
def _(t: Lens) -> DataFrame:
    turns = t.turns.where("conv_id = 3").select(F.col("conv_id").alias("run_id"), "turn", "role", F.length("text").cast("long").alias("n"))
    return turns.join(t.run.select(F.col("id").alias("run_id")), "run_id", "left_semi").orderBy("turn")


@BOOK.add("export_rows", "SELECT 'memory' AS t, CAST(id AS VARCHAR) AS id FROM memory UNION ALL SELECT 'plan', CAST(id AS VARCHAR) FROM plan UNION ALL SELECT 'run', CAST(id AS VARCHAR) FROM run")
def _(t: Lens) -> DataFrame:
    parts = {"memory": t.documents.select(F.col("doc_id").alias("id")), "plan": t.plan, "run": t.run}
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("t"), F.col("id").cast("string").alias("id")) for name, df in parts.items()))


@BOOK.add(
    "event_vocab",
    "SELECT h, CASE h WHEN 'prompt_submit' THEN 'prompt_submit' WHEN 'task_completed' THEN 'task_completed' WHEN 'post_tool_failure' THEN 'tool_failed' WHEN 'post_tool_use' THEN 'tool_complete' ELSE 'unknown' END AS event, count(*) AS n FROM (SELECT CASE WHEN id % 50 = 0 THEN 'odd' ELSE hook END AS h FROM hook) GROUP BY h",
)
def _(t: Lens) -> DataFrame:
    named = t.hook.select(F.when(F.col("id") % 50 == 0, "odd").otherwise(F.col("hook")).alias("h"))
    return named.groupBy("h").agg(F.count(F.lit(1)).alias("n")).select("h", hooks.event_name(F.col("h")).alias("event"), "n")


_TOOL = "coalesce(json_extract_string(data, '$.tool_name'), 'unknown')"
_PATH = "json_extract_string(data, '$.tool_input.file_path')"
_COMMAND = "json_extract_string(data, '$.tool_input.command')"
_OUTPUT = "json_extract_string(data, '$.tool_output')"


@BOOK.add(
    "infer_obs_type",
    f"""SELECT id, CASE {_TOOL} WHEN 'Read' THEN 'file_read' WHEN 'Write' THEN 'file_write' WHEN 'Edit' THEN 'file_edit' WHEN 'Bash' THEN 'command_run' WHEN 'Grep' THEN 'search' WHEN 'Glob' THEN 'search'
        ELSE CASE hook WHEN 'post_tool_failure' THEN 'error' WHEN 'prompt_submit' THEN 'conversation' WHEN 'task_completed' THEN 'task' ELSE 'other' END END AS obs_type FROM hook""",
)
def _(t: Lens) -> DataFrame:
    return t.hook.select("id", hooks.obs_type(hooks.tool_name(F.col("data")), F.col("hook")).alias("obs_type"))


@BOOK.add(
    "infer_importance",
    f"SELECT id, CASE hook WHEN 'post_tool_failure' THEN 7 WHEN 'prompt_submit' THEN 4 ELSE CASE {_TOOL} WHEN 'Write' THEN 6 WHEN 'Edit' THEN 6 WHEN 'Bash' THEN 5 WHEN 'Read' THEN 2 WHEN 'Grep' THEN 2 ELSE 3 END END AS importance FROM hook",
)
def _(t: Lens) -> DataFrame:
    return t.hook.select("id", hooks.importance(F.col("hook"), hooks.tool_name(F.col("data"))).alias("importance"))


@BOOK.add(
    "build_title",
    f"""WITH h AS (SELECT id, hook, json_extract_string(data, '$.prompt') AS q, {_TOOL} AS tool, {_PATH} AS p, {_COMMAND} AS c FROM hook),
        l AS (SELECT *, coalesce(list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], c) AS line FROM h)
        SELECT id, CASE WHEN hook = 'prompt_submit' THEN 'Prompt' || CASE WHEN q = '' THEN '' WHEN length(q) > 60 THEN ': ' || substring(q, 1, 60) || '…' ELSE ': ' || q END
               WHEN tool = 'Bash' AND c <> '' THEN tool || ': ' || trim(CASE WHEN strpos(line, '|') BETWEEN 1 AND 80 THEN substring(line, 1, strpos(line, '|') - 1) ELSE substring(line, 1, 80) END)
               WHEN p <> '' THEN tool || ': ' || string_split(p, '/')[-1] ELSE tool || ' call' END AS title FROM l""",
)
def _(t: Lens) -> DataFrame:
    return t.hook.select("id", hooks.title(hooks.tool_name(F.col("data")), F.col("hook"), F.col("data")).alias("title"))


@BOOK.add(
    "build_narrative",
    f"""WITH h AS (SELECT id, hook, {_TOOL} AS tool, {_PATH} AS p, {_OUTPUT} AS o, json_extract_string(data, '$.prompt') AS q FROM hook)
        SELECT id, CASE hook WHEN 'post_tool_use' THEN CASE WHEN tool = 'Bash' THEN CASE WHEN o = '' THEN '(no output)' ELSE array_to_string(string_split(o, chr(10))[-3:], ' | ') END
                 WHEN p = '' THEN 'Used ' || tool || ' tool.' ELSE 'Used ' || tool || ' on ' || p || '.' END
               WHEN 'post_tool_failure' THEN tool || ' failed.' WHEN 'prompt_submit' THEN q ELSE 'Hook ' || hook || ' fired for ' || tool || '.' END AS narrative FROM h""",
)
def _(t: Lens) -> DataFrame:
    return t.hook.select("id", hooks.narrative(hooks.tool_name(F.col("data")), F.col("hook"), F.col("data")).alias("narrative"))


@BOOK.add(
    "extract_keywords",
    f"SELECT id, CASE WHEN p = '' THEN lower(tool) ELSE array_to_string([string_split(p, '/')[4], 'core', 'rs', lower(tool)], ',') END AS keywords FROM (SELECT id, {_TOOL} AS tool, {_PATH} AS p FROM hook)",
)
def _(t: Lens) -> DataFrame:
    return t.hook.select("id", F.array_join(hooks.keywords(hooks.tool_name(F.col("data")), F.col("data")), ",").alias("keywords"))


@BOOK.add(
    "json_facts",
    f"SELECT id, 'file_path: ' || p || ';command: ' || c || CASE WHEN tool = 'Bash' AND o <> '' THEN ';output: ' || o ELSE '' END AS facts FROM (SELECT id, {_TOOL} AS tool, {_PATH} AS p, {_COMMAND} AS c, {_OUTPUT} AS o FROM hook)",
)
def _(t: Lens) -> DataFrame:
    return t.hook.select("id", F.array_join(hooks.facts(hooks.tool_name(F.col("data")), F.col("data")), ";").alias("facts"))


@BOOK.add("dedup_hash", f"SELECT id, sha256(CAST(session_id AS VARCHAR) || ':' || {_TOOL} || ':' || substring({_COMMAND}, 1, 500)) AS key FROM hook")
def _(t: Lens) -> DataFrame:
    command = F.get_json_object(hooks.tool_input(F.col("data")), "$.command")
    return t.hook.select("id", hooks.dedup_key(F.col("session_id"), hooks.tool_name(F.col("data")), command).alias("key"))


@BOOK.add(
    "truncate_word",
    r"""SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE
          (CASE WHEN length(regexp_extract(substring(text, 1, 60), '(?s)^(.*)\s', 1)) > 30 THEN regexp_extract(substring(text, 1, 60), '(?s)^(.*)\s', 1) ELSE substring(text, 1, 60) END) || '…' END AS short,
        CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '…' ELSE text END AS hard FROM documents""",
)
def _(t: Lens) -> DataFrame:
    return t.documents.select("doc_id", text.cut_at_word(F.col("text"), 60).alias("short"), text.cut(F.col("text"), 80).alias("hard"))


@BOOK.add(
    "recency_access_rank",
    f"SELECT id, round(strength * exp(-(greatest(0, {NOW} - created_s) / 86400.0::DOUBLE) / 30.0::DOUBLE) * (1.0::DOUBLE + 0.1::DOUBLE * least(greatest(retrieval_count, 0), 20)), 6) AS score FROM memory",
)
def _(t: Lens) -> DataFrame:
    age = scores.age_days(F.lit(NOW), F.col("created_s"))
    return t.memory.select("id", r6(scores.recency_access(F.col("strength"), age, F.col("retrieval_count"))).alias("score"))


@BOOK.add(
    "decay_strength",
    f"SELECT id, round(CASE WHEN d > 60 THEN greatest(0.1::DOUBLE, strength * pow(0.9::DOUBLE, d // 60)) ELSE strength END, 6) AS strength FROM (SELECT id, strength, ({NOW} - created_s) // 86400 AS d FROM memory)",
)
def _(t: Lens) -> DataFrame:
    age = scores.age_days(F.lit(NOW), F.col("created_s"))
    return t.memory.select("id", r6(scores.decayed(F.col("strength"), age, 60)).alias("strength"))


@BOOK.add("strengthen_cap", "SELECT id, round(least(strength * 1.15::DOUBLE, 1.0::DOUBLE), 6) AS strength FROM memory")
def _(t: Lens) -> DataFrame:
    return t.memory.select("id", r6(scores.strengthened(F.col("strength"))).alias("strength"))


@BOOK.add(
    "git_commit_detect",
    f"SELECT id, c LIKE 'git add . && git commit%' OR c = 'git -p commit; ls' AS is_commit FROM (SELECT id, {_COMMAND} AS c FROM hook)",
)
def _(t: Lens) -> DataFrame:
    return t.hook.select("id", hooks.is_commit_command(F.get_json_object(hooks.tool_input(F.col("data")), "$.command")).alias("is_commit"))


@BOOK.add(
    "commit_output_parse",
    rf"""WITH l AS (SELECT id, list_filter(list_transform(string_split({_OUTPUT}, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^\[\S+(\s[^\]]*)?\s[0-9a-fA-F]{{7,}}\s*\]'))[1] AS line FROM hook)
        SELECT id, regexp_extract(line, '^\[(\S+)', 1) AS branch, regexp_extract(line, '^\[[^\]]*?([0-9a-fA-F]+)\s*\]', 1) AS sha, trim(regexp_extract(line, '^\[[^\]]*\](.*)$', 1)) AS message FROM l WHERE line IS NOT NULL""",
)
def _(t: Lens) -> DataFrame:
    branch, sha, message = hooks.commit_parts(hooks.shell_output(hooks.tool_output(F.col("data"))))
    return t.hook.select("id", branch.alias("branch"), sha.alias("sha"), message.alias("message")).where("sha is not null")


@BOOK.add(
    "numstat_parse",
    "SELECT l_orderkey AS commit_id, count(*) AS files, CAST(sum(l_linenumber) AS BIGINT) AS insertions, CAST(sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber * 2 END) AS BIGINT) AS deletions FROM lineitem GROUP BY l_orderkey",
)
def _(t: Lens) -> DataFrame:
    from memspan.sources.parsers import numstat

    deleted = F.when(F.col("l_linenumber") % 3 == 0, F.lit("-")).otherwise((F.col("l_linenumber") * 2).cast("string"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("commit_id"), F.concat_ws("\t", F.col("l_linenumber").cast("string"), deleted, F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"))).alias("line"))
    return numstat(lines, "commit_id", "line").select("commit_id", F.size("files").cast("long").alias("files"), "insertions", "deletions")


@BOOK.add(
    "entity_extract",
    r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b(?:E\d{3,}|[45]\d{2})\b'))), ',') AS errors FROM documents",
)
def _(t: Lens) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(F.array_sort(text.error_codes(F.col("text"))), ",").alias("errors"))


@BOOK.add(
    "xml_fact_parse",
    "SELECT item_id, substring(text, 1, 20) AS fact, CASE item_id % 3 WHEN 0 THEN 0.5::DOUBLE ELSE (item_id % 3) / 4.0::DOUBLE END AS confidence FROM benchmark",
)
def _(t: Lens) -> DataFrame:
    told = F.when(F.col("item_id") % 3 == 0, F.lit("high")).otherwise((F.col("item_id") % 3 / 4.0).cast("string"))
    reply = F.concat(F.lit('<facts><fact confidence="'), told, F.lit('">'), F.substring("text", 1, 20), F.lit("</fact></facts>"))
    return t.benchmark.select("item_id", F.explode(text.xml_facts(reply)).alias("f")).select("item_id", "f.fact", "f.confidence")


@BOOK.add("json_slice_parse", "SELECT event_id, k FROM ev")
def _(t: Lens) -> DataFrame:
    reply = F.concat(F.lit("Sure: "), F.col("props"), F.lit(" and done"))
    return t.events.select("event_id", F.get_json_object(text.json_slice(reply), "$.k").cast("long").alias("k"))


@BOOK.add("author_parse", "SELECT c_custkey, c_name AS name, lower(c_mktsegment) || '@x.org' AS address FROM customer")
def _(t: Lens) -> DataFrame:
    name, address = text.author_parts(F.concat(F.col("c_name"), F.lit(" <"), F.lower("c_mktsegment"), F.lit("@x.org>")))
    return t.customer.select("c_custkey", name.alias("name"), address.alias("address"))


@BOOK.add("hook_queries", f"SELECT id, substring(tool || ' ' || o, 1, 200 + length(tool) + 1) AS query FROM (SELECT id, hook, {_TOOL} AS tool, {_OUTPUT} AS o FROM hook) WHERE hook = 'post_tool_failure'")
def _(t: Lens) -> DataFrame:
    failed = t.hook.where("hook = 'post_tool_failure'")
    return failed.select("id", F.concat(hooks.tool_name(F.col("data")), F.lit(" "), F.substring(hooks.tool_output(F.col("data")), 1, 200)).alias("query"))


@BOOK.add("listwise_scores", "SELECT conv_id, CAST((turn + 1) % n AS INT) AS item, round((n - turn) / n::DOUBLE, 6) AS score FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM turns) WHERE n >= 2")
def _(t: Lens) -> DataFrame:
    sized = t.turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n >= 2")
    order = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i + 1) % F.col("n"))
    return sized.select("conv_id", F.explode(text.permutation_scores(order, F.col("n"))).alias("s")).select("conv_id", F.col("s.item").cast("int").alias("item"), r6(F.col("s.score")).alias("score"))


@BOOK.add(
    "observe_compress",
    f"""WITH h AS (SELECT id, hook, {_TOOL} AS tool, {_PATH} AS p, {_COMMAND} AS c, {_OUTPUT} AS o, json_extract_string(data, '$.prompt') AS q FROM hook)
        SELECT id, hook, tool, CASE tool WHEN 'Read' THEN 'file_read' WHEN 'Write' THEN 'file_write' WHEN 'Edit' THEN 'file_edit' WHEN 'Bash' THEN 'command_run' WHEN 'Grep' THEN 'search'
                 ELSE CASE hook WHEN 'post_tool_failure' THEN 'error' WHEN 'prompt_submit' THEN 'conversation' WHEN 'task_completed' THEN 'task' ELSE 'other' END END AS obs_type,
               CASE hook WHEN 'post_tool_failure' THEN 7 WHEN 'prompt_submit' THEN 4 ELSE CASE tool WHEN 'Write' THEN 6 WHEN 'Edit' THEN 6 WHEN 'Bash' THEN 5 WHEN 'Read' THEN 2 WHEN 'Grep' THEN 2 ELSE 3 END END AS importance,
               CASE WHEN hook = 'prompt_submit' THEN 'Prompt: ' || q WHEN tool = 'Bash' THEN '-' WHEN p <> '' THEN tool || ': ' || string_split(p, '/')[-1] ELSE tool || ' call' END AS title,
               CASE WHEN p = '' THEN lower(tool) ELSE array_to_string([string_split(p, '/')[4], 'core', 'rs', lower(tool)], ',') END AS keywords, 0.5::DOUBLE AS confidence FROM h""",
)
def _(t: Lens) -> DataFrame:
    rows = hooks.observed(t.hook.drop("tool"))
    title = F.when((F.col("tool") == "Bash") & (F.col("hook") != "prompt_submit"), F.lit("-")).otherwise(F.col("title"))
    return rows.select("id", "hook", "tool", "obs_type", "importance", title.alias("title"), F.array_join("keywords", ",").alias("keywords"), "confidence")




@BOOK.add(
    "rfc3339_age",
    f"SELECT id, CASE WHEN id % 5 = 0 THEN 1.0::DOUBLE WHEN id % 5 = 1 THEN round(({NOW} - epoch(CAST('2024-05-2' || CAST(id % 10 AS VARCHAR) || ' 08:11:12' AS TIMESTAMP)))::DOUBLE / 86400, 6) ELSE 0.0::DOUBLE END AS age FROM memory",
)
def _(t: Lens) -> DataFrame:
    kind = F.col("id") % 5
    local = F.concat(F.lit("2024-05-2"), (F.col("id") % 10).cast("string"), F.lit("T10:11:12.5+02:00"))
    told = F.when(kind == 0, "2024-05-31T00:00:00Z").when(kind == 1, local).when(kind == 2, "yesterday").when(kind == 3, "2031-01-01T00:00:00Z")
    return t.memory.select("id", r6(times.age_of(told, F.lit(NOW))).alias("age"))


@BOOK.add("month_day", "SELECT id, strftime(make_timestamp(created_s * 1000000), '%b %d') AS day FROM memory")
def _(t: Lens) -> DataFrame:
    return t.memory.select("id", times.month_day(F.col("created_s")).alias("day"))


@BOOK.add(
    "plan_capture",
    "SELECT id, title, 'src/a' || CAST(id AS VARCHAR) || '.rs,docs/b.md' AS files, 'src/a' || CAST(id AS VARCHAR) || '.rs,docs/b.md,first-steps-' || CAST(id AS VARCHAR) || ',then-more' AS keywords FROM plan",
)
def _(t: Lens) -> DataFrame:
    n = F.col("id").cast("string")
    body = F.concat(F.lit("# "), "title", F.lit("\nuse src/a"), n, F.lit(".rs and docs/b.md, then src/a"), n, F.lit(".rs\n## First Steps: "), n, F.lit("\nx\n## Then, more!\n## ab\n"))
    return t.plan.select("id", text.plan_title(body, F.lit("none")).alias("title"), F.array_join(text.plan_files(body), ",").alias("files"), F.array_join(text.plan_keywords(body), ",").alias("keywords"))


@BOOK.add(
    "listwise_prompt",
    """SELECT conv_id, 'Query: "q"' || chr(10) || chr(10) || 'Documents:' || chr(10) || string_agg(CAST(turn AS VARCHAR) || '. ' || role || ' — ' || substring(text, 1, 240) || chr(10), '' ORDER BY turn) || chr(10)
       || 'Respond with strict JSON: {"order": [indices 0..' || CAST(count(*) - 1 AS VARCHAR) || ', each exactly once, best first]}' AS prompt FROM turns GROUP BY conv_id HAVING count(*) = max(turn) + 1""",
)
def _(t: Lens) -> DataFrame:
    turns = t.turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("l"), F.max("turn").alias("last")).where("size(l) = last + 1")
    return turns.select("conv_id", text.listwise_prompt("q", F.transform("l", lambda x: x["role"]), F.transform("l", lambda x: x["text"])).alias("prompt"))
