"""A store of tables in Parquet whose writes touch the buckets of their keys alone.

Every table of the engine is laid into buckets: by a hash of the key that its writes go by, by
day, or into one. A bucket's rows lie in the folders of the versions that wrote them, which
never change. A manifest names, for each table and bucket, the versions that count; a
commit writes new folders and then one small manifest, so readers see all tables of a
step or none, and what a lost executor or driver left half-written counts for nothing.

* ``read`` opens a table, or only the buckets that some rows touch.
* ``append`` adds a version to the buckets of new rows.
* ``replace`` gives buckets new rows; ``merge`` computes them from the buckets' old rows and
  new ones (maxima of edges, counts of entities, marks on memories).
* A commit may name a batch of a source; a batch that was committed before is skipped.

There is one writer at a time; a commit on a manifest that another writer has passed raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspan.sources.schemas import SCHEMAS, conformed
from memspan.sources.tables import checkpoint

BUCKETS = 32
#: Versions of a bucket beyond which an append writes it as one.
MOST_VERSIONS = 16
DAY_US = 86_400_000_000
#: The columns by whose hash a table is dealt to buckets; tables of one session lie together. Others have one bucket.
KEYS = {
    "run": ("session_id",),
    "session": ("id",),
    "observation": ("session_id",),
    "dedup": ("key",),
    "edge": ("src", "dst"),
    "entity": ("kind", "name", "project"),
    "memory": ("id",),
    "reply": ("hash",),
}
#: Tables that are dealt to buckets by the day of a time in microseconds.
DAYS = {"seen": "ts_us"}
#: Columns that a table has here beside its schema.
MORE = {"seen": ", ts_us bigint"}


def bucket_of(name: str, buckets: int = BUCKETS, columns: Iterable[Column] | None = None) -> Column:
    """The bucket of a row, by its own columns or by given ones in their place."""
    if name in DAYS:
        at = next(iter(columns)) if columns else F.col(DAYS[name])
        return F.coalesce(F.floor(at / DAY_US), F.lit(-1)).cast("bigint")
    if name in KEYS:
        return F.pmod(F.xxhash64(*(columns or (F.col(c) for c in KEYS[name]))), F.lit(buckets)).cast("bigint")
    return F.lit(0).cast("bigint")


@dataclass
class Commit:
    """Changes of a step before they are seen: for each table the buckets that get other versions."""

    replaced: dict[str, set[int]] = field(default_factory=dict)
    added: set[tuple[str, int, str]] = field(default_factory=set)


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.sequence, self.live, self.batches = -1, set(), {}
        self._load()

    # Files, in whatever store they are

    def _fs(self, path: str) -> tuple[object, object]:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, path: str) -> list[str]:
        store, target = self._fs(path)
        return [s.getPath().getName() for s in store.listStatus(target)] if store.exists(target) else []

    def _load(self) -> None:
        found = [int(n.removeprefix("seq=")) for n in self._names(f"{self.path}/manifest") if n.startswith("seq=")]
        if found and max(found) != self.sequence:
            self.sequence = max(found)
            rows = self.spark.read.parquet(f"{self.path}/manifest/seq={self.sequence}").collect()  # a row for each bucket and version
            self.live = {(r["name"], r["bucket"], r["version"]) for r in rows if r["kind"] == "live"}
            self.batches = {r["name"]: r["bucket"] for r in rows if r["kind"] == "batch"}

    # Reading

    def _schema(self, name: str) -> str:
        return SCHEMAS[name] + MORE.get(name, "")

    def read(self, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """A table, or some of its buckets: no other file is opened."""
        wanted = None if only is None else set(only)
        paths = sorted(f"{self.path}/data/{name}/v={v}/bucket={b}" for t, b, v in self.live if t == name and (wanted is None or b in wanted))
        if not paths:
            return self.spark.createDataFrame([], self._schema(name))
        rows = self.spark.read.schema(self._schema(name)).parquet(*paths)
        return rows

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in SCHEMAS}

    def touched(self, name: str, rows: DataFrame, columns: Iterable[Column] | None = None) -> set[int]:
        """The buckets of a table that rows, or values of them, fall into: as many numbers as it has, at most."""
        return {r["b"] for r in rows.select(bucket_of(name, self.buckets, columns).alias("b")).distinct().collect()}

    # Writing

    def _write(self, name: str, rows: DataFrame) -> set[tuple[str, int, str]]:
        version = uuid.uuid4().hex[:16]
        shaped = rows.select(*self.spark.createDataFrame([], self._schema(name)).columns) if name in MORE else conformed(rows, name)
        placed = shaped.withColumn("bucket", bucket_of(name, self.buckets))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}/v={version}")
        return {(name, int(n.removeprefix("bucket=")), version) for n in self._names(f"{self.path}/data/{name}/v={version}") if n.startswith("bucket=")}

    def append(self, commit: Commit, name: str, rows: DataFrame) -> None:
        """Adds rows that are not there yet; a bucket of many versions is written as one."""
        added = self._write(name, rows)
        held: dict[int, int] = {}
        for t, b, _ in self.live:
            if t == name:
                held[b] = held.get(b, 0) + 1
        full = {b for _, b, _ in added if held.get(b, 0) >= MOST_VERSIONS}
        if full:
            self.replace(commit, name, self.read(name, full), full)
        commit.added |= added

    def replace(self, commit: Commit, name: str, rows: DataFrame, buckets: Iterable[int] | None = None) -> None:
        """Gives buckets, or all, new rows; rows must fall into these buckets."""
        gone = {b for t, b, _ in self.live if t == name} if buckets is None else set(buckets)
        commit.replaced.setdefault(name, set()).update(gone)
        commit.added |= self._write(name, rows)

    def merge(self, commit: Commit, name: str, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], columns: Iterable[Column] | None = None) -> set[int]:
        """Gives the buckets that new rows touch what ``combine(old rows of these buckets, new rows)`` makes; which they were."""
        new = checkpoint(new)
        some = self.touched(name, new, columns)
        self.replace(commit, name, combine(self.read(name, some), new), some)
        return some

    def commit(self, change: Commit, source: str | None = None, batch: int = 0) -> None:
        """Makes a step's changes seen, all at once."""
        kept = {(t, b, v) for t, b, v in self.live if b not in change.replaced.get(t, ())}
        batches = {**self.batches, **({source: batch} if source else {})}
        rows = [("live", t, b, v) for t, b, v in sorted(kept | change.added)] + [("batch", n, b, "") for n, b in batches.items()]
        made = self.spark.createDataFrame(rows or [("live", "", -1, "")], "kind string, name string, bucket bigint, version string").coalesce(1)
        draft, after = f"{self.path}/manifest/draft-{uuid.uuid4().hex}", f"{self.path}/manifest/seq={self.sequence + 1}"
        made.write.parquet(draft)
        store, target = self._fs(after)
        if store.exists(target) or not store.rename(self._fs(draft)[1], target):
            raise RuntimeError(f"another writer has made {after}")
        self.sequence, self.live, self.batches = self.sequence + 1, kept | change.added, batches

    def done(self, source: str, batch: int) -> bool:
        """Whether a batch of a source, or a later one, was committed."""
        return self.batches.get(source, -1) >= batch

    def save(self, changes: Mapping[str, DataFrame]) -> None:
        """Stores whole tables that a step returns."""
        change = Commit()
        for name, df in changes.items():
            if name in MORE and any(c not in df.columns for c in ("ts_us",)):
                df = df.withColumn("ts_us", F.lit(None).cast("bigint"))
            self.replace(change, name, df)
        self.commit(change)

    def vacuum(self) -> None:
        """Removes versions that do not count and older manifests; not while others read them."""
        for name in self._names(f"{self.path}/data"):
            for v in self._names(f"{self.path}/data/{name}"):
                for b in self._names(f"{self.path}/data/{name}/{v}"):
                    if b.startswith("bucket=") and (name, int(b.removeprefix("bucket=")), v.removeprefix("v=")) not in self.live:
                        store, target = self._fs(f"{self.path}/data/{name}/{v}/{b}")
                        store.delete(target, True)
        for name in self._names(f"{self.path}/manifest"):
            if name != f"seq={self.sequence}":
                store, target = self._fs(f"{self.path}/manifest/{name}")
                store.delete(target, True)
