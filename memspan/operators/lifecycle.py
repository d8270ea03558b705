"""Ingest and life cycle: dedup, runs, commits, sessions, plans, core memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspan.sources.tables import written

TTL_US = 300_000_000


#: Events meant for a chunk of a key.
CHUNK_ROWS = 100_000


def _first_of_windows(ttl_us: int, key: int, time: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Passes rows that come sorted by key and time: the first of a key from ``least`` on, and those that are late enough after the last one passed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bound = None, 0
        for batch in batches:
            keep = []
            for row, (k, t, x) in enumerate(zip(batch.column(key).to_pylist(), batch.column(time).to_pylist(), batch.column(least).to_pylist(), strict=True)):
                if k != of:
                    of, bound = k, x
                if bound is None or t >= bound:
                    bound = t + ttl_us
                    keep.append(row)
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def _ways_through(ttl_us: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a chunk's times: for each that may be the first one kept, the last one that is kept then."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(rows["_t"].to_numpy())
        following = np.searchsorted(times, times + ttl_us)
        last = np.arange(len(times))
        for i in range(len(times) - 1, -1, -1):  # what follows is known already
            if following[i] < len(times):
                last[i] = last[following[i]]
        # What was kept before the chunk hides nothing beyond its first stretch.
        entries = min(len(times), int(np.searchsorted(times, (times[0] // ttl_us + 1) * ttl_us)) + 1)
        first = rows.iloc[[0] * entries][["_key", "_part", "_chunk"]].reset_index(drop=True)
        return first.assign(_from=times[:entries], _last=times[last[:entries]])

    return run


def _entries(ttl_us: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Follows a part from chunk to chunk: for each the time from which an event is kept (``_least``, null for the first)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, bound = [], None
        for chunk, some in rows.sort_values(["_chunk", "_from"]).groupby("_chunk"):
            out.append((rows["_key"].iloc[0], rows["_part"].iloc[0], chunk, bound))
            at = 0 if bound is None else int(np.searchsorted(some["_from"].to_numpy(), bound))
            if at < len(some):
                bound = int(some["_last"].iloc[at]) + ttl_us
        return pd.DataFrame(out, columns=["_key", "_part", "_chunk", "_least"]).astype({"_least": "Int64"})

    return run


def ttl_dedup(events: DataFrame, key: str, time_us: str, event_id: str, ttl_us: int = TTL_US, last: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Events that are kept when each kept one hides its key's repeats for the next ``ttl_us``.

    A repeat does not renew the window, so which events stay depends on those kept before.
    Time is cut into stretches as long as the window, of which each keeps one event at most.
    Where a stretch holds no event of a key, what follows does not depend on what was
    before: a key is cut there into parts. A part of more than ``chunk_rows`` events is cut
    into chunks of whole stretches. For each chunk it is found where a way through it ends,
    for every event of its first stretch with which it may begin; ways are joined from
    chunk to chunk, and then every chunk is passed on its own, one row at a time. So no task
    holds a key, whatever its gaps; it holds a stretch.

    ``last`` has ``key, last_us`` of what was kept before. An event earlier than that is a
    repeat if it is so by less than the window, and else counts among such late ones.

    Events without time cannot be compared: all are kept and hide nothing. A null key is a
    key of its own, other than an empty one. Of equal times the smallest id is kept.
    """
    name = F.col(key).cast("string")
    row = F.struct(*(F.col(f"`{c}`") for c in events.columns)).alias("_row")
    keyed = events.select(row, F.when(name.isNull(), "0").otherwise(F.concat(F.lit("1"), name)).alias("_key"), F.col(time_us).alias("_t"))
    timed = keyed.where("_t is not null")
    if last is not None:
        known = last.select(F.when(F.col("key").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("key").cast("string"))).alias("_key"), F.col("last_us").alias("_since"))
        timed = timed.join(known, "_key", "left").where(F.coalesce(F.abs(F.col("_t") - F.col("_since")) >= ttl_us, F.lit(True)))
        timed = timed.withColumn("_key", F.when(F.col("_t") < F.col("_since"), F.concat(F.lit("-"), "_key")).otherwise(F.col("_key"))).drop("_since")
    timed = timed.withColumn("_bucket", F.floor(F.col("_t") / ttl_us))
    window = Window.partitionBy("_key").orderBy("_bucket")
    new = F.when(F.col("_bucket") - F.lag("_bucket").over(window) <= 1, 0).otherwise(1)
    stretches = timed.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    parts = stretches.withColumn("_part", F.sum(new).over(window))
    inner = Window.partitionBy("_key", "_part").orderBy("_bucket")
    parts = parts.withColumn("_chunk", F.floor((F.sum("_n").over(inner) - F.col("_n")) / chunk_rows)).drop("_n")
    long = parts.where("_chunk > 0").select("_key", "_part").distinct()
    places = parts.join(long, ["_key", "_part"], "left_semi")
    # Only parts of several chunks are followed; their times alone are moved.
    ways = timed.select("_key", "_bucket", "_t").join(places.select("_key", "_bucket", "_part", "_chunk"), ["_key", "_bucket"]).groupBy("_key", "_part", "_chunk")
    ways = ways.applyInPandas(_ways_through(ttl_us), "_key string, _part bigint, _chunk bigint, _from bigint, _last bigint")
    entries = ways.groupBy("_key", "_part").applyInPandas(_entries(ttl_us), "_key string, _part bigint, _chunk bigint, _least bigint")
    placed = timed.join(parts.select("_key", "_bucket", "_part", "_chunk"), ["_key", "_bucket"]).join(entries, ["_key", "_part", "_chunk"], "left")
    placed = placed.select(F.struct("_key", "_part", "_chunk").alias("_group"), "_least", "_t", "_row")
    ordered = placed.repartition("_group").sortWithinPartitions("_group", "_t", f"_row.{event_id}")
    kept = ordered.mapInArrow(_first_of_windows(ttl_us, 0, 2, 1), ordered.schema)
    return kept.select("_row.*").unionByName(keyed.where("_t is null").select("_row.*"))


def last_kept(kept: DataFrame, key: str, time_us: str, last: DataFrame) -> DataFrame:
    """``key, last_us`` after more was kept: what ``ttl_dedup`` takes with the next events."""
    fresh = kept.where(F.col(time_us).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(time_us).alias("last_us"))
    return last.select("key", "last_us").unionByName(fresh).groupBy("key").agg(F.max("last_us").alias("last_us"))


def run_numbers(events: DataFrame, session: str, order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Events with ``run_no``: an opening event starts a run if none is open, a closing one ends it.

    The closing event and events outside runs have none; further opening events belong to
    the open run.
    """
    window = Window.partitionBy(session).orderBy(*order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(opens, 1).when(closes, 0)
    was_open = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(0)) == 1
    flagged = events.select("*", was_open.alias("_was"), (opens & ~was_open).alias("_starts"))
    numbered = flagged.withColumn("_no", F.sum(F.col("_starts").cast("long")).over(window))
    return numbered.withColumn("run_no", F.when((F.col("_was") & ~closes) | F.col("_starts"), F.col("_no"))).drop("_was", "_starts", "_no")


def outcome(committed: Column, wrote: Column) -> Column:
    return F.when(committed, "committed").when(wrote, "uncommitted").otherwise("success")


def runs_of(numbered: DataFrame) -> DataFrame:
    """Runs of events ``id, session_id, project, ts_us, hook, prompt, run_no``: first prompt, later prompts, ids and times.

    ``numbered`` has events outside runs too: one that ends a run tells when it ended.
    """
    inside = numbered.where("run_no is not null")
    prompts = F.transform(F.array_sort(F.collect_list(F.when(F.col("hook") == "prompt_submit", F.struct("ts_us", "id", "prompt")))), lambda x: x["prompt"])
    made = inside.groupBy("session_id", "run_no").agg(
        F.first("project").alias("project"),
        F.floor(F.min("ts_us") / 1_000_000).alias("started_s"),
        prompts.alias("prompts"),
        F.array_sort(F.collect_list("id")).alias("observation_ids"),
    )
    window = Window.partitionBy("session_id").orderBy("ts_us", "id").rowsBetween(Window.unboundedPreceding, -1)
    ends = numbered.withColumn("of", F.last("run_no", ignorenulls=True).over(window)).where("run_no is null and closes")
    ends = ends.groupBy("session_id", F.col("of").alias("run_no")).agg(F.floor(F.min("ts_us") / 1_000_000).alias("ended_s"))
    return made.join(ends, ["session_id", "run_no"], "left").withColumn("prompt", F.get("prompts", F.lit(0)))


def recalled(values: Column, more: Column) -> Column:
    """Ids that a run has recalled, with further ones."""
    return F.array_distinct(F.concat(F.coalesce(values, F.array().cast("array<bigint>")), more))


def committed_lesson(sha: Column, message: Column) -> Column:
    return F.concat(F.lit("Committed "), F.substring(sha, 1, 7), F.lit(": "), message)


def session_name(prompt: Column, title: Column, project: Column, at_s: Column) -> Column:
    """A session's name: its first prompt if that says something, its best title, or the project's last folder and the day."""
    from memspan.functions import text, times

    day = F.concat(text.basename(project), F.lit(" — "), times.month_day(at_s))
    told = lambda value, least: F.when(F.length(F.trim(value)) > least, text.cut_at_word(F.trim(value), 80))
    return F.coalesce(told(prompt, 5), told(title, 3), day)


def session_names(sessions: DataFrame, runs: DataFrame, obs: DataFrame, now_s: int) -> DataFrame:
    """``id, name`` of sessions ``id, project``, from their first run and best observation."""
    prompts = runs.groupBy(F.col("session_id").alias("id")).agg(F.min_by("prompt", F.struct("started_s", "id")).alias("prompt"))
    shown = obs.where("obs_type <> 'conversation'").groupBy(F.col("session_id").alias("id")).agg(F.min_by("title", F.struct((-F.col("importance")).alias("i"), "ts_us", "id")).alias("title"))
    both = sessions.select("id", "project").join(prompts, "id", "left").join(shown, "id", "left")
    return both.select("id", session_name(F.col("prompt"), F.col("title"), F.col("project"), F.lit(now_s)).alias("name"))


def uncommitted_decay(memory: DataFrame, touched: DataFrame, commits: DataFrame, now_s: int, days: int = 60) -> DataFrame:
    """``id, forget_s`` of memories with files that uncommitted runs wrote and no commit of their project changed.

    ``touched`` and ``commits`` have ``project, file``; memories have ``files``. Days count from
    ``now_s``, or from the last ``ended_s`` of what touched a memory's files if there is one.
    """
    touched = touched if "ended_s" in touched.columns else touched.withColumn("ended_s", F.lit(now_s))
    files = memory.select("id", "project", F.explode(F.array_distinct("files")).alias("file"))
    safe = files.join(commits.select("project", "file").distinct(), ["project", "file"], "left_semi").select("id").distinct()
    last = touched.groupBy("project", "file").agg(F.max("ended_s").alias("ended_s"))
    hit = files.join(last, ["project", "file"]).groupBy("id").agg(F.max("ended_s").alias("ended_s"))
    return hit.join(safe, "id", "left_anti").select("id", (F.col("ended_s") + days * 86_400).cast("long").alias("forget_s"))


def strengthened_by(memory: DataFrame, commits: DataFrame) -> DataFrame:
    """Memories after commits ``project, files``: those of the project that share a file grow stronger, once, or once for each commit that has an ``id``."""
    from memspan.functions import scores

    each = "id" in commits.columns
    changed = commits.select("project", (F.col("id") if each else F.lit(0)).alias("_commit"), F.explode("files").alias("file")).distinct()
    met = memory.select("id", "project", F.explode("files").alias("file")).join(changed, ["project", "file"])
    hit = met.select("id", "_commit").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("_hits"))
    return memory.join(hit, "id", "left").withColumn("strength", F.when(F.col("_hits") > 0, scores.strengthened(F.col("strength"), F.col("_hits"))).otherwise(F.col("strength"))).drop("_hits")


def joined_top(df: DataFrame, group: list[str], value: str, order: list[Column], limit: int, separator: str, name: str) -> DataFrame:
    """The values of a group's first rows, joined; groups keep no more than ``limit`` rows before they are collected."""
    window = Window.partitionBy(*group).orderBy(*order)
    few = df.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= limit)
    listed = few.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_nth", F.col(value).alias("v")))).alias("l"))
    return listed.select(*group, F.array_join(F.transform("l", lambda x: x["v"]), separator).alias(name))


def latest(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_nth = 1").drop("_nth")


def open_at(points: DataFrame, spans: DataFrame, session: str, at: str) -> DataFrame:
    """Points with the ``id`` of the span of their session that was open then, the latest if several; an as-of join.

    Points and starts are sorted together in each session, so nothing is paired.
    """
    starts = spans.select(session, F.col("started_s").alias("_t"), F.lit(0).alias("_kind"), F.struct("started_s", "id", "ended_s").alias("_span"), F.lit(None).cast("long").alias("_point"))
    rows = points.select(session, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_span"].dataType).alias("_span"), F.col("id").alias("_point"))
    window = Window.partitionBy(session).orderBy("_t", "_kind", F.col("_span.id"), "_point").rowsBetween(Window.unboundedPreceding, 0)
    last = starts.unionByName(rows).withColumn("_open", F.last("_span", ignorenulls=True).over(window)).where("_kind = 1")
    inside = F.col("_open").isNotNull() & (F.col("_open.ended_s").isNull() | (F.col("_t") < F.col("_open.ended_s")))
    return last.select(F.col("_point").alias("id"), F.when(inside, F.col("_open.id")).alias("span_id"))


def edited(values: Column, op: str, value: Column) -> Column:
    """A list of core memory after an edit; identity is set, lists are added to or removed from."""
    if op == "add":
        return F.array_distinct(F.concat(values, F.array(value)))
    if op == "remove":
        return F.array_except(values, F.array(value))
    raise ValueError(f"unsupported op {op}: add or remove")


def edit_core(core: DataFrame, project: str, field: str, op: str, value: str) -> DataFrame:
    """Core memory after one edit of a project's row."""
    mine = F.col("project") == project
    if field == "identity":
        return core.withColumn("identity", F.when(mine, F.lit(value)).otherwise(F.col("identity")))
    if field not in ("goals", "invariants", "watchlist"):
        raise ValueError(f"unsupported field {field}")
    return core.withColumn(field, F.when(mine, edited(F.col(field), op, F.lit(value))).otherwise(F.col(field)))


#: Plans of one set of files that meet a commit together, about.
LIST_PLANS = 1000


def _file_sets(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files, plans``: each distinct set of plans' files with its number of plans, and ``plan_id, files``.

    Stored, so that the planner knows the size of the sets, which are few if plans repeat them.
    """
    sets = plans.where("file is not null").groupBy("plan_id").agg(F.sort_array(F.collect_set("file")).alias("files"))
    return written(sets.groupBy("files").agg(F.count(F.lit(1)).alias("plans"))), sets


def _first_met(sets: DataFrame, commits: DataFrame, some: Column) -> DataFrame:
    """``files, commit_id, both``: sets and commits that share one of ``some`` of a set's files, once each, at the first such file.

    A commit carries its files, so what a pair shares is told where it meets, and pairs are not grouped.
    """
    changed = commits.where("file is not null").groupBy("commit_id").agg(F.collect_set("file").alias("changed"))
    asked = sets.select("files", some.alias("some")).select("files", "some", F.explode("some").alias("file"))
    met = changed.select("commit_id", "changed", F.explode("changed").alias("file")).join(asked, "file")
    first = met.where(F.get(F.array_intersect("some", "changed"), F.lit(0)) == F.col("file"))
    return first.select("files", "commit_id", F.size(F.array_intersect("files", "changed")).alias("both"))


def covered(plans: DataFrame, commits: DataFrame, least: float = 0.8) -> DataFrame:
    """``plan_id, commit_id, coverage``: the share of a plan's files that a commit changed.

    Plans of one set of files meet commits together. A commit that has enough of a set has
    one of any files of it that are one more than it may miss, so only these are looked for.
    """
    sets, of = _file_sets(plans)
    needed = F.greatest(F.ceil(least * F.size("files") - F.lit(1e-9)).cast("int"), F.lit(1))
    met = _first_met(sets, commits, F.slice("files", F.lit(1), F.size("files") - needed + 1))
    enough = met.select("files", "commit_id", (F.col("both") / F.size("files")).alias("coverage")).where(F.col("coverage") >= least)
    # Plans of a set come in lists, so a pair is made where its list meets the commit.
    part = F.pmod(F.xxhash64("plan_id"), F.ceil(F.col("plans") / LIST_PLANS)).alias("_part")
    listed = of.join(sets, "files").groupBy("files", part).agg(F.collect_list("plan_id").alias("_plans"))
    return enough.join(written(listed.drop("_part")), "files").select(F.explode("_plans").alias("plan_id"), "commit_id", "coverage")


def overlapping(plans: DataFrame, commits: DataFrame) -> DataFrame:
    """``plan_id, commits``: how many commits changed any of a plan's files; plans without one are left out."""
    sets, of = _file_sets(plans)
    counted = _first_met(sets, commits, F.col("files")).groupBy("files").agg(F.count(F.lit(1)).alias("commits"))
    return of.join(counted, "files").select("plan_id", "commits")


def entities(records: DataFrame) -> DataFrame:
    """``kind, name, project`` with count and first and last time; a record counts a name once.

    Files and lower-cased keywords, and of records with a ``text`` its symbols and error codes.
    """
    from memspan.functions import text

    plain = lambda names: F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))
    kinds = {"file": plain(F.col("files")), "concept": plain(F.transform("keywords", lambda x: F.lower(F.trim(x))))}
    if "text" in records.columns:
        kinds |= {"symbol": plain(text.symbols(F.col("text"))), "error": plain(text.error_codes(F.col("text")))}
    listed = F.array(*(F.struct(F.lit(kind).alias("kind"), names.alias("names")) for kind, names in kinds.items()))
    named = records.select("project", "at_s", F.explode(listed).alias("k")).select("project", "at_s", "k.kind", F.explode("k.names").alias("name")).where("name <> ''")
    return named.groupBy("kind", "name", "project").agg(F.count(F.lit(1)).alias("n"), F.min("at_s").alias("first_s"), F.max("at_s").alias("last_s"))


def entities_merged(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entities after those of new records: counts add up, times widen."""
    both = known.select(fresh.columns).unionByName(fresh)
    return both.groupBy("kind", "name", "project").agg(F.sum("n").alias("n"), F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"))
