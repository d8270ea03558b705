"""Payloads of hook events: names, compression by rules, commit detection, keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspan.functions import text

#: The names under which hooks report each event.
EVENT_NAMES = {
    "prompt_submit": ["UserPromptSubmit", "prompt_submit"],
    "tool_start": ["PreToolUse", "pre_tool_use", "tool_start"],
    "tool_complete": ["PostToolUse", "post_tool_use", "tool_complete"],
    "tool_failed": ["PostToolUseFailure", "PostToolFailure", "post_tool_failure", "tool_failed"],
    "session_start": ["SessionStart", "session_start"],
    "session_stop": ["Stop", "stop", "session_stop"],
    "task_completed": ["TaskCompleted", "task_completed"],
    "session_end": ["SessionEnd", "session_end"],
    "pre_compact": ["PreCompact", "pre_compact"],
    "post_compact": ["PostCompact", "post_compact"],
    "subagent_start": ["SubagentStart", "subagent_start"],
    "subagent_stop": ["SubagentStop", "subagent_stop"],
    "notification": ["Notification", "notification"],
    "git_commit": ["git_commit"],
}
#: Observation types and importances.
TOOL_TYPES = {"Read": "file_read", "Write": "file_write", "Edit": "file_edit", "Bash": "command_run", "Grep": "search", "Glob": "search", "WebFetch": "web_fetch", "WebSearch": "web_fetch"}
HOOK_TYPES = {
    "post_tool_failure": "error",
    "prompt_submit": "conversation",
    "subagent_start": "subagent",
    "subagent_stop": "subagent",
    "notification": "notification",
    "task_completed": "task",
    "post_compact": "compaction_summary",
}
HOOK_IMPORTANCE = {"post_tool_failure": 7, "session_start": 3, "session_end": 3, "prompt_submit": 4}
TOOL_IMPORTANCE = {"Write": 6, "Edit": 6, "Bash": 5, "Read": 2, "Glob": 2, "Grep": 2}


def look_up(value: Column, table: dict, default: Column) -> Column:
    out = default
    for key, found in reversed(table.items()):
        out = F.when(value == key, F.lit(found)).otherwise(out)
    return out


def event_name(hook: Column) -> Column:
    """The canonical event of a hook's name, or ``unknown``."""
    return look_up(hook, {alias: name for name, aliases in EVENT_NAMES.items() for alias in aliases}, F.lit("unknown"))


def either(data: Column, *paths: str) -> Column:
    """The first of several JSON paths that is there."""
    return F.coalesce(*(F.get_json_object(data, p) for p in paths))


def tool_name(data: Column) -> Column:
    """The tool's name; ``unknown`` where a payload has none."""
    return F.coalesce(either(data, "$.tool_name", "$.toolName"), F.lit("unknown"))


def tool_input(data: Column) -> Column:
    return either(data, "$.tool_input", "$.toolInput")


def tool_output(data: Column) -> Column:
    return F.coalesce(either(data, "$.tool_output", "$.toolOutput"), F.lit(""))


def file_path(data: Column) -> Column:
    return F.coalesce(either(tool_input(data), "$.file_path", "$.filePath"), F.lit(""))


def files(data: Column) -> Column:
    given = tool_input(data)
    return F.array_compact(F.array(*(F.get_json_object(given, f"$.{k}") for k in ("file_path", "filePath", "path", "file"))))


def shell(tool: Column) -> Column:
    return tool.isin("Bash", "Shell")


def obs_type(tool: Column, hook: Column) -> Column:
    return look_up(tool, TOOL_TYPES, look_up(hook, HOOK_TYPES, F.lit("other")))


def importance(hook: Column, tool: Column) -> Column:
    return look_up(hook, HOOK_IMPORTANCE, look_up(tool, TOOL_IMPORTANCE, F.lit(3)))


@dataclass(frozen=True)
class Payload:
    """What of a payload the rules look at."""

    tool: Column
    given: Column
    output: Column
    prompt: Column
    command: Column
    path: Column
    files: Column


def told(tool: Column, data: Column) -> Payload:
    """A payload's parts as expressions of the payload, each of which parses it."""
    text_at = lambda path, of: F.coalesce(F.get_json_object(of, path), F.lit(""))
    return Payload(tool, tool_input(data), tool_output(data), text_at("$.prompt", data), text_at("$.command", tool_input(data)), file_path(data), files(data))


def parsed(events: DataFrame, data: str = "data") -> tuple[DataFrame, Payload]:
    """Events, and their payloads' parts as columns: the payload is parsed once, and what a tool was given once."""
    outer = ("tool_name", "toolName", "tool_input", "toolInput", "tool_output", "toolOutput", "prompt")
    inner = ("command", "file_path", "filePath", "path", "file")
    either_of = lambda *names: F.coalesce(*(F.col(f"_o_{n}") for n in names))
    rows = events.select(F.struct(*(F.col(f"`{c}`") for c in events.columns)).alias("_event"), F.col(f"`{data}`").alias("_data"))
    rows = rows.select("_event", F.json_tuple("_data", *outer).alias(*(f"_o_{n}" for n in outer)))
    rows = rows.withColumn("_given", either_of("tool_input", "toolInput")).select("*", F.json_tuple("_given", *inner).alias(*(f"_i_{n}" for n in inner)))
    found = F.array_compact(F.array(*(F.col(f"_i_{n}") for n in inner[1:])))
    empty = lambda value: F.coalesce(value, F.lit(""))
    rows = rows.select(
        "_event.*",
        F.coalesce(either_of("tool_name", "toolName"), F.lit("unknown")).alias("_tool"),
        "_given",
        empty(either_of("tool_output", "toolOutput")).alias("_output"),
        empty(F.col("_o_prompt")).alias("_prompt"),
        empty(F.col("_i_command")).alias("_command"),
        empty(F.coalesce("_i_file_path", "_i_filePath")).alias("_path"),
        found.alias("_files"),
    )
    return rows, Payload(*(F.col(f"_{n}") for n in ("tool", "given", "output", "prompt", "command", "path", "files")))


def title(tool: Column, hook: Column, data: Column) -> Column:
    return title_of(hook, told(tool, data))


def title_of(hook: Column, p: Payload) -> Column:
    by_file = F.when(p.path != "", F.concat(p.tool, F.lit(": "), text.basename(p.path))).otherwise(F.concat(p.tool, F.lit(" call")))
    by_tool = F.when(shell(p.tool) & (p.command != ""), F.concat(p.tool, F.lit(": "), text.first_command(p.command))).otherwise(by_file)
    asked = F.when(p.prompt == "", F.lit("Prompt")).otherwise(F.concat(F.lit("Prompt: "), text.cut(p.prompt, 60)))
    return F.when(hook == "prompt_submit", asked).otherwise(by_tool)


def narrative(tool: Column, hook: Column, data: Column) -> Column:
    return narrative_of(hook, told(tool, data))


def narrative_of(hook: Column, p: Payload) -> Column:
    used = F.when(shell(p.tool), F.when(p.output == "", F.lit("(no output)")).otherwise(text.last_lines(p.output)))
    used = used.when(p.path == "", F.concat(F.lit("Used "), p.tool, F.lit(" tool."))).otherwise(F.concat(F.lit("Used "), p.tool, F.lit(" on "), p.path, F.lit(".")))
    said = F.when(p.prompt == "", F.lit("User submitted a prompt.")).otherwise(text.cut(p.prompt, 120))
    return (
        F.when(hook == "post_tool_use", used)
        .when(hook == "post_tool_failure", F.concat(p.tool, F.lit(" failed.")))
        .when(hook == "session_start", F.lit("Session started."))
        .when(hook == "session_end", F.lit("Session ended."))
        .when(hook == "prompt_submit", said)
        .otherwise(F.concat(F.lit("Hook "), hook, F.lit(" fired for "), p.tool, F.lit(".")))
    )


def facts(tool: Column, data: Column) -> Column:
    return facts_of(told(tool, data))


def facts_of(p: Payload) -> Column:
    """``key: value`` of the input's entries, and of shells the output."""
    entries = F.map_entries(F.from_json(p.given, "map<string,string>"))
    listed = F.coalesce(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), text.cut(e["value"], 200, "..."))), F.array().cast("array<string>"))
    shown = F.when(shell(p.tool) & (p.output != ""), F.array(F.concat(F.lit("output: "), text.cut(p.output, 300, "...")))).otherwise(F.array().cast("array<string>"))
    return F.concat(listed, shown)


def keywords(tool: Column, data: Column) -> Column:
    return text.path_keywords(files(data), tool)


def dedup_key(session: Column, tool: Column, given: Column, event: Column | None = None) -> Column:
    """Hash of session, tool and the first 500 characters of the input, and of the event if given."""
    parts = [F.coalesce(session.cast("string"), F.lit("")), F.coalesce(tool, F.lit("unknown")), F.substring(F.coalesce(given, F.lit("")), 1, 500)]
    return F.sha2(F.concat_ws(":", *parts, *([event] if event is not None else [])), 256)


def is_commit_command(command: Column) -> Column:
    """Whether one of the commands joined by ``&`` or ``;`` is a git commit that is not a dry run."""

    def commits(words: Column) -> Column:
        after = F.slice(words, F.array_position(words, F.lit("git")).cast("int") + 1, F.greatest(F.size(words), F.lit(1)))
        verb = F.get(F.filter(after, lambda w: ~w.startswith("-") | (w == "--")), F.lit(0))
        return F.coalesce(F.array_contains(words, "git") & (verb == "commit") & ~F.arrays_overlap(words, F.lit(["--dry-run", "-n"])), F.lit(False))

    return F.coalesce(F.exists(F.split(command, "[&;]"), lambda part: commits(F.filter(F.split(F.trim(part), r"\s+"), lambda w: w != ""))), F.lit(False))


def commit_line(output: Column) -> Column:
    """The first line of an output that tells a commit, ``[branch ... sha] message``, or null."""
    lines = F.transform(F.split(output, "\n"), lambda x: F.trim(x))
    found = F.filter(lines, lambda x: x.rlike(r"^\[\S+(?:\s[^\]]*)?\s[0-9a-fA-F]{7,}\s*\]"))
    return F.get(found, F.lit(0))


def commit_parts(output: Column) -> tuple[Column, Column, Column]:
    """Branch, sha and message of the commit that an output tells; null if none."""
    line = commit_line(output)
    part = lambda pattern: F.when(line.isNotNull(), F.regexp_extract(line, pattern, 1))
    return part(r"^\[(\S+)"), part(r"^\[[^\]]*?([0-9a-fA-F]+)\s*\]"), F.trim(part(r"^\[[^\]]*\](.*)$"))


def shell_output(output: Column) -> Column:
    """Standard output of a shell's reply, which may be JSON that holds it."""
    return F.coalesce(F.get_json_object(output, "$.stdout"), output)


def commits_of(events: DataFrame, data: str = "data") -> DataFrame:
    """Events that tell a commit, with ``sha``, ``branch`` and ``message``: a shell ran a commit and its output names it."""
    rows, p = parsed(events, data)
    branch, sha, message = commit_parts(shell_output(p.output))
    named = rows.where(shell(p.tool) & is_commit_command(p.command))
    return named.select(*events.columns, sha.alias("sha"), branch.alias("branch"), message.alias("message")).where("sha is not null")


def observed(events: DataFrame, hook: str = "hook", data: str = "data") -> DataFrame:
    """Events compressed by rules to observations: type, title, facts, narrative, keywords, files, importance."""
    rows, p = parsed(events, data)
    return rows.select(
        *(F.col(f"`{c}`") for c in events.columns),
        p.tool.alias("tool"),
        obs_type(p.tool, F.col(hook)).alias("obs_type"),
        title_of(F.col(hook), p).alias("title"),
        narrative_of(F.col(hook), p).alias("narrative"),
        facts_of(p).alias("facts"),
        text.path_keywords(p.files, p.tool).alias("keywords"),
        p.files.alias("files"),
        importance(F.col(hook), p.tool).alias("importance"),
        F.lit(0.5).alias("confidence"),
    )
