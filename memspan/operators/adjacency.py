"""An adjacency store: edges laid out by node and best first, so that a traversal reads what it reaches.

Every edge lies at both of its ends. Nodes are dealt to buckets by a hash; in a bucket rows are
sorted by node, way, falling score and other end, with Bloom filters of nodes in the files.
The edges of a node with many of them lie in levels: its best 1024, the next 7168, and so
on, each level eight times as many as all before it. A hop of a frontier opens its
buckets alone; a search that stops at some number of results opens further levels only
while an edge there could still be among them.

New edges are one more segment, as an edge's score only rises and the best score counts;
many segments are written as one. Edges without a source, target or score, or with a
score that is no number, are left out: no search follows them. A repeated edge is one
(``graph.upsert``), and columns beyond those of edges are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from memspan.operators import graph
from memspan.sources.tables import checkpoint, discard, fresh_path, written

#: Edges of a node, in one way, in its first level; times as many up to the end of each next one.
LEVEL, GROWTH, LEVELS = 1024, 8, 14
BUCKETS = 64
#: Segments beyond which they are written as one.
MOST_SEGMENTS = 8
#: Nodes of a frontier that are told to the scan by name; a larger one is joined.
NAMED = 512
ENTRY = ("node", "outward", "other", "relation", "via", "edge_score", "created_s")
WAYS = {"out": [True], "in": [False], "both": [True, False]}


def _order() -> list[Column]:
    return [F.col("node"), F.col("outward"), F.desc("edge_score"), F.col("other"), F.col("relation"), F.col("via")]


def _entries(edges: DataFrame) -> DataFrame:
    """Both ends of each edge."""
    given = set(edges.columns)
    via, at = (F.col(c) if c in given else F.lit(None) for c in ("via", "created_s"))
    told = edges.select("src", "dst", F.col("relation").cast("string"), via.cast("string").alias("via"), F.col("edge_score").cast("double"), at.cast("bigint").alias("created_s"))
    known = told.where("src is not null and dst is not null and edge_score is not null and not isnan(edge_score)")
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("outward"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("outward"), F.col("src").alias("other")))
    return graph.upsert(known).withColumn("_end", F.explode(ends)).select("_end.*", "relation", "via", "edge_score", "created_s")


def _level_of(rank: Column, level: int) -> Column:
    found = F.when(rank < level, 0)
    for k in range(1, LEVELS):
        found = found.when(rank < level * GROWTH**k, k)
    return found.otherwise(LEVELS)


def _ranked(entries: DataFrame, level: int, scratch: str) -> DataFrame:
    """Entries with ``level``, and ``n``, the entries of the node and way if they are more than one level holds, else 0.

    Only entries of such nodes are ranked: they are sorted by ranges, which cut through nodes,
    and a rank is the place in the range and the number of the node's entries in ranges before it.
    """
    key = ["node", "outward"]
    many = written(entries.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > level), f"{scratch}/many")
    few = entries.join(many, key, "left_anti").withColumns({"n": F.lit(0).cast("bigint"), "level": F.lit(0)})
    crowded = entries.join(many, key)
    placed = written(crowded.repartitionByRange(*_order()).sortWithinPartitions(*_order()).withColumn("_at", F.monotonically_increasing_id()), f"{scratch}/placed")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a node
    starts = placed.groupBy(*key, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held")).withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    ranks = placed.join(starts.drop("_held"), [*key, "_range"])
    told = ranks.withColumn("level", _level_of(F.col("_at") - F.col("_first") + F.col("_before"), level))
    return few.unionByName(told.select(few.columns))


class Adjacency:
    """Segments of entries; ``kind`` is the type of nodes."""

    def __init__(self, spark: SparkSession, paths: Sequence[str], kind: str, buckets: int = BUCKETS, level: int = LEVEL):
        self.spark, self.paths, self.kind, self.buckets, self.level = spark, list(paths), kind, buckets, level
        shape = f"node {kind}, outward boolean, other {kind}, relation string, via string, edge_score double, created_s bigint, n bigint, bucket int, level int"
        self.segments = [spark.read.schema(shape).parquet(p) for p in self.paths]  # files are listed once

    @classmethod
    def build(cls, edges: DataFrame, buckets: int = BUCKETS, level: int = LEVEL) -> Adjacency:
        """The store of edges ``src, dst, relation, edge_score`` and maybe ``via, created_s``; ``src`` and ``dst`` are of one type.

        There should be as many buckets as make one of them some hundred megabytes.
        """
        spark = edges.sparkSession
        return cls(spark, [cls._segment(edges, buckets, level)], edges.schema["src"].dataType.simpleString(), buckets, level)

    @staticmethod
    def _segment(edges: DataFrame, buckets: int, level: int) -> str:
        spark = edges.sparkSession
        path, scratch = fresh_path(spark), fresh_path(spark)
        entries = written(_entries(edges), f"{scratch}/entries")
        placed = _ranked(entries, level, scratch).withColumn("bucket", _bucket(buckets))
        order = [F.col("bucket"), F.col("level"), *_order()]
        rows = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        rows.write.option("parquet.bloom.filter.enabled#node", "true").partitionBy("bucket", "level").parquet(path)
        discard(spark, scratch)
        return path

    def grown(self, edges: DataFrame) -> Adjacency:
        """With new edges, or known ones with higher scores."""
        if len(self.paths) < MOST_SEGMENTS:
            return Adjacency(self.spark, [*self.paths, self._segment(edges, self.buckets, self.level)], self.kind, self.buckets, self.level)
        columns = ["src", "dst", "relation", "via", "edge_score", "created_s"]
        known = self.edges()
        return Adjacency.build(known.unionByName(edges.select(*(c for c in columns if c in edges.columns)), allowMissingColumns=True), self.buckets, self.level)

    def edges(self) -> DataFrame:
        """All edges, each once."""
        return graph.upsert(_turned(self._all().where("outward")))

    def _all(self) -> DataFrame:
        out = None
        for number, rows in enumerate(self.segments):
            part = rows.withColumn("segment", F.lit(number))
            out = part if out is None else out.unionByName(part)
        return out

    def entries(self, ids: DataFrame, direction: str = "out", level: int | None = None) -> DataFrame:
        """Entries of the nodes ``id`` in one direction or both, up to a level: their buckets alone are opened.

        Few nodes are told to the scan by name, for files' statistics and Bloom filters; many are joined.
        """
        wanted = ids.select(F.col("id").cast(self.kind).alias("node")).where("node is not null").distinct()
        few = wanted.withColumn("bucket", _bucket(self.buckets)).limit(NAMED + 1).collect()
        rows = self._all().where(F.col("outward").isin(WAYS[direction]))
        if level is not None:
            rows = rows.where(F.col("level") <= level)
        if len(few) <= NAMED:
            return rows.where(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("node").isin([r["node"] for r in few]))
        touched = [r["b"] for r in wanted.select(_bucket(self.buckets).alias("b")).distinct().collect()]  # as many numbers as there are buckets
        return rows.where(F.col("bucket").isin(sorted(touched))).join(wanted, "node", "left_semi")

    def _bound(self, read: DataFrame, level: int, min_score: float) -> Row | None:
        """The place ``s, other`` in the order of falling scores and ends before which no unread entry lies; None if all that count were read."""
        last = F.max(F.struct((-F.col("edge_score")).alias("s"), "other"))
        cut = read.where(F.col("n") > self.level * GROWTH**level).groupBy("segment", "node", "outward").agg(last.alias("l")).where(-F.col("l.s") >= min_score)
        return cut.agg(F.min("l").alias("l")).head()["l"]

    def expand(self, seeds: DataFrame, max_hops: int = 2, relations: Sequence[str] | None = None, min_score: float = 0.0, direction: str = "out", max_results: int | None = None) -> DataFrame:
        """What ``graph.expand`` gives for the edges.

        With ``max_results`` a hop reads levels of its frontier until so many nodes were reached
        that all edges that are left come after them; without it, all levels.
        """

        def reach(frontier: DataFrame, visited: DataFrame, hop: int, wanted: int | None) -> DataFrame:
            level = None if wanted is None else 0
            while True:
                read = self.entries(frontier.withColumnRenamed("node", "id"), direction, level)
                steps = read.where(F.col("edge_score") >= min_score)
                if relations:
                    steps = steps.where(F.col("relation").isin(list(relations)))
                met = steps.select(F.col("node").alias("src"), F.col("other").alias("dst"), "relation", "edge_score")
                layer = graph.layer_of(met, visited, hop)
                cut = None if level is None else self._bound(read, level, min_score)
                if cut is None:
                    return layer
                sure = layer.where((F.col("edge_score") > -cut["s"]) | ((F.col("edge_score") == -cut["s"]) & (F.col("node") < F.lit(cut["other"]))))
                if sure.count() >= wanted:
                    return sure
                level += 1

        return graph.layered(seeds.select(F.col("id").cast(self.kind).alias("id")), reach, max_hops, max_results)

    def fetched(self, ids: DataFrame, direction: str = "both", relations: Sequence[str] | None = None, min_score: float = 0.0) -> DataFrame:
        """Edges that leave, enter or touch the given ids, each once."""
        rows = self.entries(ids, direction).where(F.col("edge_score") >= min_score)
        if relations:
            rows = rows.where(F.col("relation").isin(list(relations)))
        return graph.upsert(_turned(rows))  # an edge between two of the ids was found at both

    def trace(self, start: str, tables: Mapping[str, DataFrame], hops: int = 2, direction: str = "both", relations: Sequence[str] | None = None, max_results: int = 100) -> DataFrame:
        """What ``graph.trace`` gives for the edges."""
        seeds = self.spark.createDataFrame([(start,)], "id string")
        found = self.expand(seeds, hops, relations, direction=graph.way_of(direction), max_results=max_results)
        return graph.labelled(seeds, found, tables)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int")


def _turned(entries: DataFrame) -> DataFrame:
    """Entries as edges."""
    ends = [F.when(F.col("outward"), F.col(a)).otherwise(F.col(b)).alias(name) for a, b, name in (("node", "other", "src"), ("other", "node", "dst"))]
    return entries.select(*ends, "relation", "via", "edge_score", "created_s")
