"""Ingest of hook events as a stream into a store.

A micro-batch is taken in by the ingest step (``pipelines.observe``), which reads and writes
the buckets of the batch's sessions, keys and days alone, and is committed with its number, so a
batch that comes again after a failure is skipped; events that come again in another
batch are known by their ids. What state there is, the last kept event of each key, open
runs, counters and seen ids, are tables of the store: it outlives the query, and batch and
stream may take turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memspan.functions import hooks
from memspan.operators import graph, lifecycle, pipelines
from memspan.sources.store import Commit, Store
from memspan.sources.tables import checkpoint

SOURCE = "hooks"


def take_in(store: Store, events: DataFrame, now_s: int, source: str = SOURCE, batch: int | None = None, ttl_us: int = lifecycle.TTL_US) -> None:
    """Takes a batch of events ``id, session_id, project, ts_us, hook, data`` into the store.

    Each session's events must come in order of time from batch to batch; late ones are taken
    in as what comes last. Without a number of the batch ids alone tell repeats.
    """
    if batch is not None and store.done(source, batch):
        return
    change = Commit()
    events = checkpoint(events)
    days = store.touched("seen", events)
    sessions = store.touched("run", events)
    given = F.coalesce(hooks.tool_input(F.col("data")), F.lit(""))
    keys = store.touched("dedup", events, [hooks.dedup_key(F.col("session_id"), hooks.tool_name(F.col("data")), given)])
    near = {name: store.read(name, sessions) for name in ("run", "session", "observation")}
    tables = {**store.tables(), **near, "seen": store.read("seen", days), "dedup": store.read("dedup", keys)}
    made = pipelines.observe(tables, events, now_s, ttl_us)
    told = checkpoint(made["commits"])
    for name in ("run", "session"):
        made[name] = checkpoint(made[name])
    if not told.isEmpty():
        # Commits are rare; they concern runs of these sessions, and memories, plans and core memory of their projects.
        after = {**tables, "run": made["run"], "observation": tables["observation"].unionByName(made["observation"])}
        more = pipelines.record_commits({**after, "memory": made.get("memory", tables["memory"])}, told, now_s)
        for name in ("plan", "core", "memory"):
            store.replace(change, name, checkpoint(more[name]))
        store.append(change, "commits", more["commits"])
        store.append(change, "summary", more["summary"])
        made["run"], made["edge"] = checkpoint(more["run"]), made["edge"].unionByName(more["edge"])
    elif "memory" in made:
        store.replace(change, "memory", checkpoint(made["memory"]))
    store.replace(change, "run", made["run"], sessions)
    store.replace(change, "session", made["session"], sessions)
    store.replace(change, "dedup", checkpoint(made["dedup"]), keys)
    store.append(change, "observation", made["observation"])
    store.append(change, "seen", made["seen"].join(pipelines.unseen(events, tables["seen"]).select("id", "ts_us"), "id"))
    store.merge(change, "edge", made["edge"], lambda old, new: graph.upsert(old.unionByName(new, allowMissingColumns=True)))
    store.commit(change, None if batch is None else source, batch or 0)


def ingest(events: DataFrame, store: Store, checkpoint_path: str, now: Callable[[], int], source: str = SOURCE, available_now: bool = False) -> StreamingQuery:
    """Starts a stream of hook events into a store; ``now`` tells the time of a batch in seconds."""

    def run(rows: DataFrame, batch: int) -> None:
        take_in(store, rows, now(), source, batch)

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
