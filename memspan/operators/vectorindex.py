"""An inverted file of vectors: stored by cell, quantised for a first pass, re-ranked exactly.

Cells are those of k-means centroids and codes those of product quantisation of what a
vector differs from its centroid, both fitted on a bounded sample; every row is indexed. A
search reads the codes of the cells that it probes and nothing else, and then the
vectors of few rows: the best by code. An exact search goes on where that could miss
something: a code's error is stored, so a row's cosine has bounds, and a cell's radius
bounds what its rows can reach; what the bounds cannot rule out is compared.

Rows lie in Parquet folders by cell. Later rows go into the same cells as further files;
rows that are replaced or deleted are hidden by a table of ids and the generation before
which they count for nothing, until ``compact`` writes what is alive.

Recall is measured (``audit``) by a bounded number of stored vectors that are asked for and
compared with all rows; ``tuned`` probes more cells until a stated recall is reached.

Defined cases: null vectors, those without a direction (zero, or with a null or non-finite
component) and those of another length than most have no cosine and are not found. Rows
that repeat an id are rows of their own, which are deleted together. An index of no rows
finds nothing; the length of its vectors is then that of the first rows that are added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspan.functions import scores
from memspan.sources.tables import checkpoint, fresh_path, written

#: Rows that centroids and codes are fitted on, rows meant for a cell, cells at most.
SAMPLE, CELL_ROWS, MAX_CELLS = 16_384, 500, 4096
#: Parts of a vector with a code of a byte each, and rounds of k-means.
PARTS, CODES, FITS = 16, 256, 8
#: Rows whose vectors are compared for each row that is wanted, vectors that are asked for in an audit, and the recall that is meant.
RERANK, AUDIT, RECALL = 10, 64, 0.95
#: Queries of one pass.
BLOCK = 256
#: Rows of a cell that one group of a join holds.
GROUP_ROWS = 20_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-300)


def _kmeans(x: np.ndarray, k: int, rounds: int = FITS) -> np.ndarray:
    """Centroids of a sample that fits the driver, from its first distinct rows."""
    centers = np.unique(x[: 4 * k], axis=0)
    centers = centers[np.random.default_rng(k).permutation(len(centers))[:k]]
    for _ in range(rounds):
        near = (x @ centers.T - (centers * centers).sum(axis=1) / 2).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centers))
        centers = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centers)
    return centers


@dataclass(frozen=True)
class Model:
    """Centroids of cells and, of each part of what is left, its code book."""

    centers: np.ndarray
    books: tuple[np.ndarray, ...]

    @property
    def cuts(self) -> list[tuple[int, int]]:
        ends = np.cumsum([0, *(b.shape[1] for b in self.books)])
        return list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int) -> Model:
        x = _unit(sample)
        centers = _kmeans(x, max(1, cells))
        rest = x - centers[cls(centers, ()).cells(x)]
        books = tuple(_kmeans(np.ascontiguousarray(part), CODES) for part in np.array_split(rest, min(PARTS, x.shape[1]), axis=1))
        return cls(centers, books)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centers.T - (self.centers * self.centers).sum(axis=1) / 2).argmax(axis=1)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: the cell, the code, its error, and the distance to the centroid (both rounded up)."""
        cell = self.cells(x)
        rest = x - self.centers[cell]
        code, told = np.zeros((len(x), len(self.books)), np.uint8), np.zeros_like(rest)
        for s, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            code[:, s] = (rest[:, a:b] @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1)
            told[:, a:b] = book[code[:, s]]
        up = lambda d: np.sqrt((d * d).sum(axis=1)) * (1 + 1e-6) + 1e-9
        return cell, code, up(rest - told), up(rest)

    def asked(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A unit query's products with the centroids and with the entries of each code book."""
        table = np.zeros((len(self.books), CODES))
        for s, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            table[s, : len(book)] = book @ query[a:b]
        return self.centers @ query, table


def _coder(model: Model, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds cell, code, error and distance to rows whose vector is column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, model.centers.shape[1]).astype(np.float64)
            cell, code, err, far = model.coded(_unit(x))
            more = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err), pa.array(far)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "code", "err", "far"])

    return run


@dataclass
class _Asked:
    """A query in a first pass: its products, its cells, and what a row must reach."""

    products: np.ndarray
    table: np.ndarray
    cells: set[int]
    least: float = -2.0


def _first_pass(asked: list[_Asked], most: int, exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``query, id, cell, low, high`` by code: the ``most`` best ones of a task for each query, or all that can be among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in asked]
        kind = pa.int64()

        def trimmed(q: int) -> tuple:
            ids, cell, low, high = (np.concatenate(x) for x in zip(*held[q], strict=True))
            bound = asked[q].least
            if len(low) > most:
                bound = max(bound, float(np.partition(low, -most)[-most]))
            keep = high >= bound
            return ids[keep], cell[keep], low[keep], high[keep]

        for batch in batches:
            kind = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            ids = np.array(batch.column(0).to_pylist(), object)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            err, cell = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for q, ask in enumerate(asked):
                rows = np.flatnonzero(np.isin(cell, list(ask.cells)))
                if not len(rows):
                    continue
                score = ask.products[cell[rows]] + ask.table[np.arange(code.shape[1])[None, :], code[rows]].sum(axis=1)
                slack = err[rows] if exact else 0.0
                held[q].append((ids[rows], cell[rows], score - slack, score + slack))
                if len(held[q]) > 8:
                    held[q] = [trimmed(q)]
        for q in range(len(asked)):
            if held[q]:
                found = trimmed(q)
                n = len(found[0])
                columns = [pa.array(np.full(n, q, np.int32)), pa.array(found[0].tolist(), kind), pa.array(found[1].astype(np.int32)), pa.array(found[2]), pa.array(found[3])]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "cell", "low", "high"])

    return run


def _all_nearest(queries: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``query, id, score``: the best rows of a task for each query, by comparing all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            near = queries @ _unit(x).T
            some = min(k, batch.num_rows)
            best = np.argpartition(-near, some - 1, axis=1)[:, :some] if some else np.zeros((len(queries), 0), np.int64)
            columns = [pa.array(np.repeat(np.arange(len(queries), dtype=np.int32), some)), batch.column(0).take(pa.array(best.ravel())), pa.array(np.take_along_axis(near, best, 1).ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score"])

    return run


def _places(model: Model, far: Sequence[float], parts: Sequence[int], p: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``query, asked, least``, once for each part of the cells they go to: the ``p`` nearest ones, or those that can reach ``least``."""
    held = np.array(parts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                products = _unit(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)) @ model.centers.T
                if batch.column(2).null_count:
                    row, cell = np.repeat(np.arange(len(products)), p), np.argsort(-products, axis=1, kind="stable")[:, :p].ravel()
                else:
                    row, cell = np.nonzero(products + np.array(far) >= batch.column(2).to_numpy()[:, None] - 1e-7)
                n = held[cell]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                some = batch.take(pa.array(np.repeat(row, n)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.repeat(cell, n).astype(np.int32)), pa.array(part.astype(np.int32))], names=[*some.schema.names, "cell", "part"])

    return run


def _met(k: int, bounds: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Queries with a part of a cell: their ``k`` highest cosines there, or the rows that may be among the ``k`` nearest."""

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return _unit(column.combine_chunks().flatten().to_numpy().reshape(len(column), -1).astype(np.float64))

    def few(rows: np.ndarray, ids: list, x: np.ndarray) -> np.ndarray:
        """Of equal vectors those of the ``k`` smallest ids: their cosines are equal."""
        held: dict[bytes, int] = {}
        out = []
        for r in sorted(rows.tolist(), key=lambda r: ids[r]):
            key = x[r].tobytes()
            held[key] = held.get(key, 0) + 1
            if held[key] <= k:
                out.append(r)
        return np.array(out, np.int64)

    def run(asking: pa.Table, stored: pa.Table) -> pa.Table:
        at, found, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if asking.num_rows and stored.num_rows:
            x, ids, least = matrix(stored["v"]), stored["id"].to_pylist(), asking["least"].to_numpy()
            some = min(k, len(x))
            for start in range(0, asking.num_rows, BLOCK):
                near = matrix(asking["asked"].slice(start, BLOCK)) @ x.T
                best = -np.partition(-near, some - 1, axis=1)[:, :some]
                if bounds:
                    at.append(np.repeat(np.arange(start, start + len(near)), some))
                    score.append(best.ravel())
                    continue
                for q, scores_of in enumerate(near):
                    bound = max(least[start + q], best[q].min() if some == k else -2.0) - 1e-9
                    rows = np.flatnonzero(scores_of >= bound)
                    found.append(few(rows, ids, x) if len(rows) > k else rows)
                    at.append(np.full(len(found[-1]), start + q))
        rows = pa.array(np.concatenate(at))
        if bounds:
            return pa.table({"query": asking["query"].take(rows), "score": np.concatenate(score)})
        chosen = pa.array(np.concatenate(found))
        return pa.table({"query": asking["query"].take(rows), "asked": asking["asked"].take(rows), "id": stored["id"].take(chosen), "v": stored["v"].take(chosen)})

    return run


def _ranked(df: DataFrame, k: int, by: str) -> DataFrame:
    window = Window.partitionBy("query").orderBy(F.desc(by), "id")
    return df.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= k).drop("_nth")


@dataclass(frozen=True)
class VectorIndex:
    """An index under ``path``; a changed index is another object over the same folder."""

    spark: SparkSession
    path: str
    model: Model | None
    kinds: str
    keep: tuple[str, ...]
    far: tuple[float, ...] = ()
    generation: int = 0
    hides: bool = False
    probes: int = 8
    recall: float | None = None

    # Writing

    @classmethod
    def build(cls, df: DataFrame, id_col: str = "id", vector_col: str = "embedding", keep: Sequence[str] = (), path: str | None = None, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fits a model on ``sample`` rows at most, and indexes all.

        ``keep`` names columns that are stored beside the vectors, for searches within a scope.
        """
        rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v"), *(F.col(f"`{c}`") for c in keep))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        index = cls(df.sparkSession, path or fresh_path(df.sparkSession), None, kinds, tuple(keep))
        return index._fitted(rows, cells, sample)._appended(rows)

    def _fitted(self, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        sizes = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
        if not sizes:
            return self
        sound = self._sound(rows, sizes[0]["n"])
        # Half as many again are drawn as are taken, so tasks do not each send as many as that.
        drawn = sound.sample(fraction=min(1.0, 1.5 * sample / sizes[0]["rows"]), seed=5) if sizes[0]["rows"] > sample else sound
        few = np.array([r["v"] for r in drawn.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], np.float64)
        if not len(few):
            return self
        meant = cells or min(MAX_CELLS, max(1, round(sizes[0]["rows"] / CELL_ROWS)), max(1, len(few) // 4))
        model = Model.fit(few, meant)
        told = [("center", i, 0, c.tolist()) for i, c in enumerate(model.centers)] + [("book", s, i, c.tolist()) for s, book in enumerate(model.books) for i, c in enumerate(book)]
        self.spark.createDataFrame(told, "kind string, a int, b int, x array<double>").coalesce(1).write.parquet(f"{self.path}/model")
        return replace(self, model=model, far=(0.0,) * len(model.centers), probes=min(8, len(model.centers)))

    @classmethod
    def open(cls, spark: SparkSession, path: str, kinds: str, keep: Sequence[str] = (), probes: int = 8) -> VectorIndex:
        """An index that was written before; ``kinds`` is the schema of id, vector ``v`` and kept columns."""
        told = spark.read.parquet(f"{path}/model").orderBy("kind", "a", "b").collect()  # bounded by the model's size
        centers = np.array([r["x"] for r in told if r["kind"] == "center"])
        books = {r["a"]: [] for r in told if r["kind"] == "book"}
        for r in told:
            if r["kind"] == "book":
                books[r["a"]].append(r["x"])
        model = Model(centers, tuple(np.array(books[s]) for s in sorted(books)))
        index = cls(spark, path, model, kinds, tuple(keep), hides=True, probes=probes)
        told = [df.agg(F.max("gen")).head()[0] for df in (index.stored(), spark.read.schema("gen int").parquet(f"{path}/hidden"))]
        return replace(index, generation=max((g or 0 for g in told), default=0), far=index._radii())

    @staticmethod
    def _sound(rows: DataFrame, dims: int) -> DataFrame:
        finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))
        return rows.where((F.size("v") == dims) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))

    def _appended(self, rows: DataFrame) -> VectorIndex:
        index = self if self.model is not None else self._fitted(rows)
        if index.model is None:
            index.spark.createDataFrame([], "id string, gen int").write.mode("append").parquet(f"{index.path}/hidden")
            return index
        sound = index._sound(rows, index.model.centers.shape[1])
        coded = sound.mapInArrow(_coder(index.model, 1), f"{index.kinds}, cell int, code binary, err double, far double").withColumn("gen", F.lit(index.generation))
        coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("append").partitionBy("cell").parquet(f"{index.path}/rows")
        if index.generation == 0:
            index.spark.createDataFrame([], f"id {index.kinds.split('` ')[1].split(',')[0]}, gen int").write.mode("append").parquet(f"{index.path}/hidden")
        return replace(index, far=index._radii())

    def _radii(self) -> tuple[float, ...]:
        """The distance of each cell's farthest row: a number for each cell."""
        found = {r["cell"]: r["m"] for r in self.stored().groupBy("cell").agg(F.max("far").alias("m")).collect()}
        return tuple(found.get(i, 0.0) for i in range(len(self.model.centers)))

    def changed(self, gone: DataFrame | None, new: DataFrame | None, id_col: str = "id", vector_col: str = "embedding") -> VectorIndex:
        """The index without the rows of the ids in ``gone``, and with those of ``new``. Only these are written."""
        index = replace(self, generation=self.generation + 1, recall=None)
        if gone is not None:
            hidden = gone.select(F.col(f"`{id_col}`").alias("id")).distinct().withColumn("gen", F.lit(index.generation))
            hidden.write.mode("append").parquet(f"{index.path}/hidden")
            index = replace(index, hides=True)
        if new is not None:
            index = index._appended(new.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v"), *(F.col(f"`{c}`") for c in self.keep)))
        return index

    def compact(self, path: str | None = None, cells: int | None = None) -> VectorIndex:
        """The rows that are alive as an index of their own, with a model fitted anew."""
        fresh = VectorIndex(self.spark, path or fresh_path(self.spark), None, self.kinds, self.keep)
        if self.model is None:
            return fresh._appended(self.spark.createDataFrame([], self.kinds))
        rows = self.live(["v", *self.keep]).select("id", "v", *self.keep)
        return fresh._fitted(rows, cells)._appended(rows)

    # Reading

    def stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.kinds}, code binary, err double, far double, gen int, cell int").parquet(f"{self.path}/rows")

    def live(self, columns: Sequence[str], cells: Sequence[int] | None = None, where: Column | None = None, scope: DataFrame | None = None) -> DataFrame:
        """Rows of some cells that are not hidden, within a predicate on kept columns and a table of ids."""
        rows = self.stored()
        if cells is not None:
            rows = rows.where(F.col("cell").isin([int(c) for c in cells]))
        if where is not None:
            rows = rows.where(where)
        rows = rows.select("id", "gen", "cell", *columns)
        if self.hides:
            hidden = self.spark.read.parquet(f"{self.path}/hidden").groupBy(F.col("id").alias("_id")).agg(F.max("gen").alias("_gen"))
            rows = rows.join(hidden, (F.col("id") == F.col("_id")) & (F.col("gen") < F.col("_gen")), "left_anti")
        if scope is not None:
            rows = rows.join(scope.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi")
        return rows.drop("gen")

    def _none(self) -> DataFrame:
        kind = self.kinds.split("` ")[1].split(",")[0]
        return self.spark.createDataFrame([], f"query int, id {kind}, score double")

    def search_block(self, queries: Sequence[Sequence[float]], k: int, probes: int | None = None, exact: bool = False, where: Column | None = None, scope: DataFrame | None = None) -> DataFrame:
        """``query, id, score``: the ``k`` rows of highest cosine for each query, by place in the list.

        Without ``exact`` the rows of the ``probes`` nearest cells, best by code, are compared.
        """
        if len(queries) > BLOCK:
            raise ValueError(f"{len(queries)} queries: at most {BLOCK} in one pass")
        x = np.array(queries, np.float64).reshape(len(queries), -1)
        if self.model is None or not len(x) or x.shape[1] != self.model.centers.shape[1]:
            return self._none()
        x = _unit(x)
        told = [self.model.asked(q) for q in x]
        reach = np.array([products + np.array(self.far) for products, _ in told])
        p = min(probes or self.probes, reach.shape[1])
        asked = [_Asked(products, table, set(np.argsort(-products, kind="stable")[:p].tolist())) for products, table in told]
        if exact and p < reach.shape[1]:
            # What the probed cells give bounds what any row must reach; cells that cannot reach it are not read.
            least = {r["query"]: r["least"] for r in self._compared(asked, x, k, False, where, scope).groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()}
            for q, ask in enumerate(asked):
                ask.least = least.get(q, -2.0) - 1e-7
                ask.cells = set(np.flatnonzero(reach[q] >= ask.least).tolist())
        return self._compared(asked, x, k, exact, where, scope)

    def _compared(self, asked: list[_Asked], x: np.ndarray, k: int, exact: bool, where: Column | None, scope: DataFrame | None) -> DataFrame:
        cells = sorted(set().union(*(a.cells for a in asked)))
        kind = self.kinds.split("` ")[1].split(",")[0]
        coded = self.live(["code", "err"], cells, where, scope).select("id", "code", "err", "cell")
        most = k if exact else k * RERANK
        found = coded.mapInArrow(_first_pass(asked, most, exact), f"query int, id {kind}, cell int, low double, high double")
        if exact:
            found = checkpoint(found)
            bound = _ranked(found, k, "low").groupBy("query").agg(F.min("low").alias("_low"), F.count(F.lit(1)).alias("_n"))
            few = found.join(F.broadcast(bound), "query").where((F.col("_n") < k) | (F.col("high") >= F.col("_low") - 1e-9))  # a row for each query
        else:
            few = _ranked(found, most, "high")
        # Vectors are read from the same cells; the few rows tell which.
        vectors = self.live(["v"], cells, where, scope)
        near = vectors.join(few.select("query", "id", "cell").distinct(), ["id", "cell"])
        said = self.spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(x)], "query int, asked array<double>")
        scored = near.join(F.broadcast(said), "query").select("query", "id", scores.cosine(F.col("v"), F.col("asked")).alias("score"))
        return _ranked(scored, k, "score")

    def search(self, query: Sequence[float], k: int, **more: object) -> DataFrame:
        """``id, score``: the rows of highest cosine to one query."""
        return self.search_block([query], k, **more).select("id", "score")

    def nearest_join(self, asking: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", probes: int | None = None, where: Column | None = None, scope: DataFrame | None = None) -> DataFrame:
        """``query, id, score``: the ``k`` rows of highest cosine, exactly, for each id of a table of queries, however long.

        Queries meet the rows of a cell in tasks: first in the cells that they probe, which tells
        what a row must reach, then in all cells that can reach it. Crowded cells are cut into
        parts. The driver sees a number for each cell, and no query and no row. Queries without
        a direction, or of another length, find nothing.
        """
        kind = self.kinds.split("` ")[1].split(",")[0]
        asked = asking.select(F.col(f"`{id_col}`").alias("query"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        of = asked.schema["query"].dataType.simpleString()
        if self.model is None:
            return self.spark.createDataFrame([], f"query {of}, id {kind}, score double")
        asked = self._sound(asked, self.model.centers.shape[1]).select("query", F.col("v").alias("asked"))
        rows = self.live(["v"], None, where, scope)
        held = {r["cell"]: r["n"] for r in self.stored().groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as the index has cells, at most
        parts = [max(1, -(-held.get(i, 0) // GROUP_ROWS)) for i in range(len(self.model.centers))]
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(F.lit(parts), F.col("cell") + 1)).cast("int"))
        p = min(probes or self.probes, len(parts))

        def met(queries: DataFrame, bounds: bool, schema: str) -> DataFrame:
            placed = queries.mapInArrow(_places(self.model, self.far, parts, p), f"query {of}, asked array<double>, least double, cell int, part int")
            return placed.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInArrow(_met(k, bounds), schema)

        near = met(asked.withColumn("least", F.lit(None).cast("double")), True, f"query {of}, score double")
        best = near.groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query", F.coalesce(F.get("s", F.lit(k - 1)), F.lit(-2.0)).alias("least"))
        bound = asked.join(best, "query", "left").select("query", "asked", F.coalesce("least", F.lit(-2.0)).alias("least"))
        found = met(bound, False, f"query {of}, asked array<double>, id {kind}, v array<float>")
        return _ranked(found.select("query", "id", scores.cosine(F.col("v"), F.col("asked")).alias("score")), k, "score")

    def probed(self, asking: DataFrame, id_col: str = "id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
        """Asking rows, once for each ``cell`` that they probe; rows without a direction probe none."""
        if self.model is None:
            return asking.withColumn("cell", F.lit(0)).limit(0)
        model, p = self.model, min(probes or self.probes, len(self.model.centers))

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.array(batch.tolist(), np.float64).reshape(len(batch), -1)
                yield pd.Series(np.argsort(-(_unit(x) @ model.centers.T), axis=1, kind="stable")[:, :p].tolist())

        near = F.pandas_udf(run, "array<int>")  # type: ignore[call-overload]
        rows = asking.withColumn("v", F.col(f"`{vector_col}`").cast("array<float>")) if vector_col != "v" else asking
        sound = self._sound(rows, model.centers.shape[1])
        return sound.withColumn("cell", F.explode(near("v")))

    # Recall

    def audit(self, k: int = 20, queries: int = AUDIT, probes: int | None = None) -> float:
        """The share of the true ``k`` nearest rows that searches find, asked with stored vectors of the smallest hashes of ids; 1 if there are no rows."""
        if self.model is None:
            return 1.0
        few = [r["v"] for r in self.live(["v"]).orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(min(queries, BLOCK)).select("v").collect()]
        if not few:
            return 1.0
        kind = self.kinds.split("` ")[1].split(",")[0]
        every = self.live(["v"]).select("id", "v").mapInArrow(_all_nearest(_unit(np.array(few, np.float64)), k), f"query int, id {kind}, score double")
        true = _ranked(every, k, "score").select("query", "id")
        got = self.search_block(few, k, probes).select("query", "id")
        both = true.join(got.withColumn("hit", F.lit(1)), ["query", "id"], "left").groupBy("query").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
        return both.agg(F.avg("share").alias("recall")).head()["recall"]

    def tuned(self, recall: float = RECALL, k: int = 20) -> VectorIndex:
        """The index with as many probes as an audit needs; it tells the recall measured, and probes all cells if less does not do."""
        index = self
        while True:
            found = index.audit(k)
            index = replace(index, recall=found)
            if found >= recall or index.model is None or index.probes >= len(index.model.centers):
                return index
            index = replace(index, probes=min(2 * index.probes, len(index.model.centers)))
