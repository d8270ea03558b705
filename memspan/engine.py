"""One entry point: an engine over a store's tables.

Tables are DataFrames by name (``sources.schemas``). Reads return DataFrames; writes return
the tables that change, by name, which the caller stores. ``now_s`` is the time of asking
in seconds. Text indexes are built when a search first needs them, or given; an index of
vectors, and an adjacency store of edges, are built when they are asked for. Indexes go on with the store:
what a step adds to a table, or changes in it, is one more segment of its indexes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspan.functions import scores
from memspan.operators import context, graph, lifecycle, maintain, models, pipelines, plans, provenance
from memspan.operators import retrieval as R
from memspan.operators.adjacency import Adjacency
from memspan.operators.textindex import TextIndex
from memspan.operators.vectorindex import RECALL, VectorIndex
from memspan.sources import parsers, schemas

INDEXED = {"observation": ["title", "narrative"], "memory": ["title", "content"], "run": ["prompt", "lesson"]}


class Changes(dict):
    """Tables in their next version, by name, and of those that are indexed what is gone and what is new.

    A table without an entry in ``deltas`` is compared with its last version; ``None``
    says that nothing that is indexed has changed.
    """

    def __init__(self, tables: Mapping[str, DataFrame], deltas: Mapping[str, tuple[DataFrame | None, DataFrame | None] | None] | None = None):
        super().__init__(tables)
        self.deltas = dict(deltas or {})

    def with_tables(self, more: Mapping[str, DataFrame]) -> Changes:
        return Changes({**self, **more}, self.deltas)


def differing(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows by ``id`` that are gone and rows that are new, of two versions of a table; a changed row is both."""
    a, b = (df.select("id", *columns) for df in (before, after))
    told = b.select(*(F.col(c).alias(f"_{c}") for c in ("id", *columns)))
    same = lambda x, y: reduce(lambda p, q: p & q, (x[c].eqNullSafe(y[f"_{c}"]) for c in columns), x["id"] == y["_id"])
    back = a.select(*(F.col(c).alias(f"_{c}") for c in ("id", *columns)))
    return a.join(told, same(a, told), "left_anti"), b.join(back, same(b, back), "left_anti")


class Engine:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], now_s: int, indexes: Mapping[str, TextIndex] | None = None, vectors: Mapping[str, VectorIndex] | None = None, adjacency: Adjacency | None = None):
        self.spark, self.tables, self.now_s = spark, dict(tables), now_s
        self._indexes, self._vectors, self._adjacency = dict(indexes or {}), dict(vectors or {}), adjacency

    @classmethod
    def empty(cls, spark: SparkSession, now_s: int) -> Engine:
        """An engine over empty tables of every kind."""
        return cls(spark, {name: schemas.empty(spark, name) for name in schemas.SCHEMAS}, now_s)

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: Sequence[str], now_s: int) -> Engine:
        """An engine over Parquet tables of a folder."""
        return cls(spark, {name: spark.read.parquet(f"{folder}/{name}") for name in names}, now_s)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def after(self, changes: Mapping[str, DataFrame]) -> Engine:
        """An engine over the tables, some of them in their next version, and their indexes."""
        next_ = Engine(self.spark, {**self.tables, **changes}, self.now_s, self._indexes, self._vectors, self._adjacency)
        deltas = changes.deltas if isinstance(changes, Changes) else {}
        if self._adjacency and "edge" in changes:  # edges that did not just grow are laid out anew when they are asked for
            next_._adjacency = self._adjacency.grown(deltas["edge"][1]) if "edge" in deltas else None
        for held, columns in ((next_._indexes, INDEXED), (next_._vectors, {name: ["embedding", "project"] for name in self._vectors})):
            for name, index in list(held.items()):
                if name in changes and deltas.get(name, ()) is not None:
                    gone, new = deltas[name] if name in deltas else differing(self[name], changes[name], columns[name])
                    held[name] = index.changed(gone, new)
        return next_

    def _grown(self, changes: Mapping[str, DataFrame]) -> Changes:
        """Changes with the next version of tables that only grow, of which a step gives the new rows; a row that is there already is not added."""
        out = Changes(changes, changes.deltas if isinstance(changes, Changes) else {})
        for name, key in (("observation", "id"), ("commits", "sha"), ("summary", "id"), ("seen", "id")):
            if name in changes:
                known = self.tables.get(name, schemas.empty(self.spark, name))
                new = changes[name].join(known.select(key), key, "left_anti").select(*changes[name].columns)
                out[name] = known.unionByName(new, allowMissingColumns=True)
                if name in INDEXED:
                    out.deltas.setdefault(name, (None, new))
        if "edge" in changes:
            out["edge"] = graph.upsert(self["edge"].unionByName(changes["edge"], allowMissingColumns=True))
            out.deltas["edge"] = (None, changes["edge"])
        return out

    # Reads

    def index(self, name: str) -> TextIndex:
        if name not in self._indexes:
            self._indexes[name] = TextIndex.build(self[name], "id", INDEXED[name])
        return self._indexes[name]

    def vectors(self, name: str, recall: float = RECALL) -> VectorIndex:
        """The index of a table's embeddings, built and tuned to a recall if there is none; from then on searches and ``remember`` use it."""
        if name not in self._vectors:
            self._vectors[name] = VectorIndex.build(self[name], keep=["project"]).tuned(recall)
        return self._vectors[name]

    def _near(self, name: str, vector: Sequence[float], limit: int) -> DataFrame:
        return self._vectors[name].search(vector, limit) if name in self._vectors else R.nearest(self[name], vector, limit, "id", "embedding")

    def health(self) -> DataFrame:
        counts = [df.agg(F.lit(name).alias("t"), F.count(F.lit(1)).alias("n")) for name, df in sorted(self.tables.items())]
        return reduce(DataFrame.unionByName, counts)

    def get(self, table: str, key: int) -> DataFrame:
        return self[table].where(F.col("id") == key)

    def find(self, table: str, **key: object) -> DataFrame:
        """The row of a unique key: a commit's ``sha``, a plan's ``file_path``, a core memory's ``project``, an entity's ``kind, name, project``."""
        if tuple(key) != schemas.KEYS.get(table):
            raise ValueError(f"{table} has the key {schemas.KEYS.get(table)}")
        return self[table].where(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in key.items()))).limit(1)

    def listed(self, table: str, order: Sequence[Column | str], limit: int, **wanted: object) -> DataFrame:
        """Rows that agree with the values that are given; a value that is None or ``all`` asks for nothing."""
        given = [F.col(c) == v for c, v in wanted.items() if v not in (None, "all")]
        rows = self[table].where(reduce(lambda a, b: a & b, given)) if given else self[table]
        return rows.orderBy(*order).limit(limit)

    def search(self, query: str, mode: str = "hybrid", limit: int = 20, project: str | None = None, embed: models.Embedder = models.hashed_trigrams, config: R.Config = R.Config()) -> DataFrame:
        """``text``, ``semantic``, ``hybrid``, or ``agentic``, which also expands along edges."""
        indexes = lambda: R.Indexes(*(self.index(x) for x in ("observation", "memory", "run")))
        if mode == "text":
            return R.search_text(self["observation"], self["memory"], indexes(), query, limit, self.now_s)
        vector = [float(x) for x in embed([query])[0]]
        if mode == "semantic":
            near = self._near("observation", vector, limit)
            return self["observation"].select("id", "title").join(F.broadcast(near), "id")
        if mode not in ("hybrid", "agentic"):
            raise ValueError(f"unsupported mode {mode}")
        vectors = {}
        for kind, name in (("memory_vectors", "memory"), ("obs_vectors", "observation")):
            if "embedding" in self[name].columns:
                vectors[kind] = self._near(name, vector, limit)
        edges = self.memory_edges() if mode == "agentic" else None
        return R.search_hybrid(self["observation"], self["memory"], self["run"], indexes(), query, limit, self.now_s, edges=edges, project=project, config=config, **vectors)

    def memory_edges(self) -> DataFrame:
        """Edges between memories, by their keys."""
        key = lambda c: F.substring_index(c, ":", -1).cast("bigint").alias(c)
        both = self["edge"].where("src like 'memory:%' and dst like 'memory:%'")
        return both.select(key("src"), key("dst"), "relation", "via", "edge_score")

    def informed(self, hits: DataFrame, session: int) -> dict[str, DataFrame]:
        """After a search in a session: its open run has recalled the memories found, which have informed it."""
        mine = self["run"].where((F.col("session_id") == session) & F.col("ended_s").isNull()).orderBy(F.desc("started_s"), F.desc("id")).limit(1)
        found = hits.where(F.col("id").startswith("memory:")).select(F.substring_index("id", ":", -1).cast("bigint").alias("id"), "score")
        edges = provenance.informed_edges(found.join(F.broadcast(mine.select(F.col("id").alias("run_id")))), F.col("run_id"))  # one run
        ids = found.agg(F.array_sort(F.collect_list("id")).alias("_more"))  # as many as the search gave
        more = mine.select("id").join(F.broadcast(ids)).select("id", "_more")
        runs = self["run"].join(F.broadcast(more), "id", "left")
        runs = runs.withColumn("recalled", F.when(F.col("_more").isNotNull(), lifecycle.recalled(F.col("recalled"), F.col("_more"))).otherwise(F.col("recalled"))).drop("_more")
        return self._grown(Changes({"run": runs, "edge": schemas.conformed(edges.withColumn("created_s", F.lit(self.now_s).cast("bigint")), "edge")}, {"run": None}))

    def memories(self, query: str | None = None, project: str | None = None, category: str | None = None, limit: int = 50) -> DataFrame:
        return R.listed_memories(self["memory"], self.index("memory"), query, limit, project, category)

    def observations(self, query: str | None = None, session: int | None = None, limit: int = 100) -> DataFrame:
        return R.listed_observations(self["observation"], self.index("observation"), query, limit, session)

    def runs(self, query: str | None = None, project: str | None = None, limit: int = 20) -> DataFrame:
        return R.listed_runs(self["run"], self.index("run"), query, limit, project)

    def run(self, key: int) -> DataFrame:
        """A run's observations in order of time."""
        ids = self.get("run", key).select(F.explode("observation_ids").alias("id"))
        return self["observation"].join(ids, "id", "left_semi").orderBy("ts_us", "id")

    def sessions(self, limit: int = 20) -> DataFrame:
        return self.listed("session", [F.desc("started_s"), "id"], limit)

    def commits(self, project: str | None = None, branch: str | None = None, session: int | None = None, limit: int = 50) -> DataFrame:
        return self.listed("commits", [F.desc("at_s"), "id"], limit, project=project, branch=branch, session_id=session)

    def plans(self, status: str | None = None, project: str | None = None, limit: int = 20) -> DataFrame:
        return self.listed("plan", [F.desc("created_s"), "id"], limit, status=status, project=project)

    def timeline(self, session: int | None = None, limit: int = 100) -> DataFrame:
        if session is None:
            return self["observation"].orderBy(F.desc("ts_us"), "id").limit(limit)
        return self["observation"].where(F.col("session_id") == session).orderBy("ts_us", "id").limit(limit)

    def trace(self, start: str, hops: int = 2, direction: str = "both", relations: Sequence[str] | None = None) -> DataFrame:
        """Nodes around a node ``table:id`` with labels and times."""
        named = {name: df for name, df in self.tables.items() if "id" in df.columns}
        if self._adjacency:
            return self._adjacency.trace(start, named, hops, direction, relations)
        return graph.trace(self["edge"], start, named, hops, direction, relations)

    def adjacency(self) -> Adjacency:
        """The adjacency store of the edges, built if there is none; from then on ``trace`` uses it."""
        if not self._adjacency:
            self._adjacency = Adjacency.build(self["edge"])
        return self._adjacency

    def links(self, memory: int) -> DataFrame:
        mine = self.memory_edges().where(F.col("src") == memory)
        return mine.join(self["memory"].select(F.col("id").alias("dst"), "title", "category"), "dst", "left")

    def digest(self, project: str, newest: int = 200, limit: int = 20) -> DataFrame:
        """The most frequent keywords and files of a project's newest observations."""
        latest = self["observation"].where(F.col("project") == project).orderBy(F.desc("ts_us"), "id").limit(newest)
        kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("names")) for kind in ("keywords", "files")))
        named = latest.select(F.explode(kinds).alias("k")).select("k.kind", F.explode("k.names").alias("name"))
        counted = named.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("score"))
        window = lifecycle.Window.partitionBy("kind").orderBy(F.desc("score"), "name")
        return counted.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= limit).drop("_nth")

    def core(self, project: str) -> DataFrame:
        """``block``: the project's core memory as markdown."""
        return self.find("core", project=project).select("project", plans.rendered(*map(F.col, ("identity", *plans.SECTIONS))).alias("block"))

    def context(self, project: str, query: str | None = None, budget: int = 2000) -> DataFrame:
        """``section, pos, line`` of core memory, memories, facts, procedures, observations and runs that fit the budget.

        Without a query the project's most important observations make one; memories are
        searched with it if there is any, or ranked by recency and access.
        """
        asked = query if not R.plain(query) else self.synthesised(project)
        if asked:
            found = self.search(asked, "agentic", 20, project)
            hits = found.where(F.col("obs_type").startswith("memory:")).select(F.substring_index("id", ":", -1).cast("bigint").alias("id"), "score")
            ranked = self["memory"].join(hits, "id")
        else:
            age = scores.age_days(F.lit(self.now_s), F.col("created_s"))
            scope = self["memory"].where(F.col("is_latest") & F.col("project").isin(project, "global")).orderBy(F.desc("created_s"), "id").limit(100)
            ranked = R.top(scope.withColumn("score", scores.recency_access(F.col("strength"), age, F.col("retrieval_count"))), 20)
        told = R.first_of_each(ranked.withColumn("kw", F.get("keywords", F.lit(0))), ["category", "kw"], 10)
        parts = [context.core_lines(self.core(project)), context.memory_lines(told, [F.desc("score"), "id"]), context.fact_lines(self["fact"]), context.procedure_lines(self["procedure"]), context.observation_lines(self["observation"], project)]
        if asked:
            closed = self["run"].where((F.col("project") == project) & F.expr("ended_s is not null and lesson <> ''"))
            fused = R.fuse([self.index("run").top(field, asked, 8, closed) for field in INDEXED["run"]], 60, 8)
            parts.append(context.run_lines(self["run"].join(fused, "id"), project, [F.desc("score"), "id"]))
        else:
            parts.append(context.run_lines(self["run"], project))
        return context.packed_sections(reduce(DataFrame.unionByName, parts), budget)

    def synthesised(self, project: str) -> str | None:
        """A query of the project's name and the titles of its five most important observations."""
        few = self["observation"].where((F.col("project") == project) & (F.col("importance") >= 5)).orderBy(F.desc("importance"), "ts_us", "id").limit(5)
        titles = [row["title"] for row in few.select("title").collect()]
        return " ".join([project, *titles]) if titles else None

    def export(self, path: str, version: str, exported_at: str) -> None:
        parsers.export({name: self[name] for name in ("session", "observation", "memory", "run", "commits", "plan", "core") if name in self.tables}, path, version, exported_at)

    # Writes

    def observe(self, events: DataFrame, ttl_us: int = lifecycle.TTL_US, model: models.Model | None = None) -> Changes:
        """After hook events; the commits that they tell are recorded too."""
        changes = pipelines.observe(self.tables, events, self.now_s, ttl_us, model)
        told = changes.pop("commits")
        first = self._grown(Changes(changes, {"memory": None}))
        then = Engine(self.spark, {**self.tables, **first}, self.now_s)
        more = then._grown(pipelines.record_commits(then.tables, told, self.now_s))
        edges = first.deltas["edge"][1].unionByName(more.deltas["edge"][1])
        return Changes({**first, **more}, {**first.deltas, "memory": None, "edge": (None, edges)})

    def remember(self, rows: DataFrame, model: models.Embedder = models.hashed_trigrams) -> Changes:
        """After new memories, which are linked to their nearest ones, by the index of vectors if there is one."""
        changes, new = pipelines.remembered(self.tables, rows, self.now_s, model, vectors=self._vectors.get("memory"))
        return self._grown(Changes(changes, {"memory": (None, new)}))

    def record_commits(self, rows: DataFrame) -> Changes:
        return self._grown(Changes(pipelines.record_commits(self.tables, rows, self.now_s), {"memory": None}))

    def start_session(self, rows: DataFrame) -> dict[str, DataFrame]:
        """Sessions ``id, project, cwd`` begin, if they are not known."""
        new = rows.join(self["session"].select("id"), "id", "left_anti").dropDuplicates(["id"])
        made = new.select("id", "project", "cwd", F.lit(self.now_s).cast("bigint").alias("started_s"), F.lit("active").alias("status"), F.lit(0).cast("bigint").alias("observation_count"))
        return {"session": schemas.conformed(self["session"], "session").unionByName(schemas.conformed(made, "session"))}

    def end_sessions(self, ids: DataFrame) -> dict[str, DataFrame]:
        """Sessions end and get a name."""
        mine = self["session"].join(ids.select("id").distinct(), "id", "left_semi")
        names = lifecycle.session_names(mine, self["run"], self["observation"], self.now_s).withColumnRenamed("name", "_name")
        joined = self["session"].join(names, "id", "left")
        hit = F.col("_name").isNotNull()
        ended = {"name": F.coalesce("_name", "name"), "status": F.when(hit, "completed").otherwise(F.col("status")), "ended_s": F.when(hit, F.lit(self.now_s)).otherwise(F.col("ended_s")).cast("bigint")}
        return {"session": joined.withColumns(ended).drop("_name")}

    def save_plan(self, rows: DataFrame) -> dict[str, DataFrame]:
        """Plans ``id, file_path, title, content, project, ...`` by path; what is new or changed is active, as are its goals and files in core memory, and memories that its run recalled have motivated it."""
        made = schemas.conformed(rows, "plan").withColumn("status", F.coalesce("status", F.lit("active"))).withColumn("created_s", F.coalesce("created_s", F.lit(self.now_s).cast("bigint")))
        edges = provenance.motivated_edges(made.where("run_id is not null"), self["run"].select("id", "recalled")).withColumn("created_s", F.lit(self.now_s).cast("bigint"))
        active = made.where("status = 'active'")
        return self._grown({"plan": plans.upsert(self["plan"], made, ["file_path"], "created_s"), "core": plans.core_synced(self["core"], active, "add"), "edge": schemas.conformed(edges, "edge")})

    def set_plans(self, ids: DataFrame, status: str) -> dict[str, DataFrame]:
        """Plans become ``active``, ``completed`` or ``abandoned``; core memory follows."""
        if status not in ("active", "completed", "abandoned"):
            raise ValueError(f"unsupported status {status}")
        changed = self["plan"].join(ids.select("id").distinct(), "id", "left_semi")
        at = F.when((F.col("status") == "completed") & F.col("completed_s").isNull(), F.lit(self.now_s)).otherwise(F.col("completed_s")).cast("bigint")
        return {"plan": plans.status_set(self["plan"], changed, status).withColumn("completed_s", at), "core": plans.core_synced(self["core"], changed, "add" if status == "active" else "remove")}

    def delete(self, ids: DataFrame) -> Changes:
        """Without the memories of some ids."""
        gone = self["memory"].join(ids.select("id").distinct(), "id", "left_semi")
        return Changes({"memory": self["memory"].join(ids, "id", "left_anti")}, {"memory": (gone, None)})

    def bump(self, hits: DataFrame) -> Changes:
        return Changes({"memory": R.bump(self["memory"], hits, self.now_s)}, {"memory": None})

    def forget(self) -> DataFrame:
        """What garbage collection would do: ``action, id``."""
        return maintain.to_forget(self["memory"], self["observation"], self.now_s)

    def purge(self) -> dict[str, DataFrame]:
        return pipelines.purge(self.tables, self.now_s)

    def decay_uncommitted(self) -> Changes:
        """``observe`` does this for runs when they close; here it is done for all runs. Memories of files that uncommitted runs wrote are to be forgotten in 60 days, unless a commit covers them."""
        bad = self["run"].where("outcome = 'uncommitted'").select("project", F.explode("observation_ids").alias("id"))
        wrote = self["observation"].where(F.col("obs_type").isin("file_write", "file_edit")).select("id", F.explode("files").alias("file"))
        found = lifecycle.uncommitted_decay(self["memory"], bad.join(wrote, "id"), self["commits"].select("project", F.explode("files").alias("file")), self.now_s)
        joined = self["memory"].join(found.withColumnRenamed("forget_s", "_forget"), "id", "left")
        return Changes({"memory": joined.withColumn("forget_s", F.coalesce("_forget", "forget_s")).drop("_forget")}, {"memory": None})

    def consolidate(self, model: pipelines.Model | None = None) -> Changes:
        return self._grown(Changes(pipelines.consolidate(self.tables, self.now_s, model), {"memory": None}))

    def evolve(self, new: DataFrame, model: pipelines.Model, system: str = "Refine the notes. Answer in JSON.", version: str = "1") -> tuple[DataFrame, DataFrame, DataFrame]:
        """Memories, their new edges and the table of replies, after a language model saw each new memory beside its neighbours.

        It is asked in tasks, once for each new memory that has neighbours and was not asked
        about in these words before; a memory whose call failed is asked again the next time.
        """
        asked = pipelines.neighbours_asked(self["edge"], self["memory"], new)
        known = self.tables.get("reply", schemas.empty(self.spark, "reply"))
        answered = models.all_replies(known, models.replies(asked, model, system, known, version))
        good = answered.where("not failed").select("hash", "reply")
        told = asked.withColumn("hash", models.prompt_hash(F.col("prompt"), system, version)).join(good, "hash")
        updates = models.evolution(told.select("new_id", "allowed", "reply")).withColumn("id", F.col("id").cast("bigint"))
        return *models.evolve(self["memory"], updates), answered

    def reindex(self) -> dict[str, DataFrame]:
        texts = self["memory"].withColumn("_text", models.embed_text(F.col("title"), F.col("content"), F.col("keywords"), F.col("files")))
        return {"memory": models.embedded(texts, "_text").drop("_text")}

    def edit_core(self, project: str, field: str, op: str, value: str) -> dict[str, DataFrame]:
        return {"core": lifecycle.edit_core(self["core"], project, field, op, value)}
