"""Ranked lexical search: WAND over shards of documents, whose heaps are merged.

Two passes over the texts where they lie. The first counts documents, terms and, for terms
that are asked for, documents that hold them. In the second a task gathers its documents to
shards of a bounded number of postings and searches each for every query:

* A term's postings are sorted by document; its largest impact in the shard bounds what it
  can add to a score.
* Documents are gone through in blocks. Lists are sorted by their largest impact. Those first
  lists whose bounds add up to less than the heap's threshold cannot make a pivot, so a
  block's pivots are looked for in the other lists alone; the first ones are only probed at
  documents that could still reach the threshold. A pivot is a document for which the
  bounds of the lists that hold it reach the threshold; it alone is scored.
* A query's heap holds the best documents of the task so far; its last score is the
  threshold, and goes on to the next shard of the task.

The heaps, at most ``limit`` documents for each query and task, are merged in two steps, first
by query and a salt, then by query. Queries are a stated set that is held against all
documents: blocks of a bounded number and length of text, one after the other.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z
lower-cased and nothing else. Weights are computed in doubles, all else in integers.

Defined cases: a null text, or one without terms, is no document of the statistics and is
never found; a query without terms, or none of whose terms is in a document, finds nothing.
A term counts once for a query. Rows that repeat a document's id are documents of their own;
rows that repeat a query's id and text are one query, those with another text one more. Equal
scores go by ascending id, null ids last. A weight of zero finds nothing. An empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspan.llm.common import slices, small_batches
from memspan.sources.tables import written

LIMIT = 50
#: Queries of a block, and characters of their texts (a longer one is a block of its own).
BLOCK_QUERIES, BLOCK_CHARS = 1024, 4 << 20
#: Postings at which a shard is searched, documents of a block of pivots, bytes of texts that are read at once.
SHARD_POSTINGS, PIVOT_DOCS, READ_BYTES = 2_000_000, 4096, 4 << 20
#: Parts into which a query's heaps are dealt before they are merged.
SALTS = 64

#: A byte of a text as a byte of terms: A-Z lower-cased, what separates terms as a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for part in slices(batch, column, READ_BYTES):
        yield part, part.column(column).cast(pa.binary()).to_pylist()


@dataclass
class Block:
    """Queries by place, their distinct terms as numbers, and the numbers of all terms."""

    keys: list[object]
    queries: list[list[int]]
    vocabulary: dict[bytes, int]


@dataclass
class Weights:
    """A block's queries with what all documents say: a weight for each term, and what a document's length adds."""

    block: Block
    weight: np.ndarray
    docs: int
    terms: int

    def length_part(self, n: int) -> int:
        return 100 - 50 + (50 * n * self.docs) // self.terms


def blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The distinct queries in blocks; the driver holds one at a time."""
    rows = queries.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull()).distinct()
    keys, texts, held = [], [], 0

    def made() -> Block:
        vocabulary: dict[bytes, int] = {}
        told = [sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(x)}) for x in texts]
        return Block(list(keys), told, vocabulary)

    for row in rows.toLocalIterator():
        if keys and (len(keys) >= BLOCK_QUERIES or held + len(row["text"]) > BLOCK_CHARS):
            yield made()
            keys, texts, held = [], [], 0
        keys.append(row["key"])
        texts.append(row["text"].encode())
        held += len(row["text"])
    if keys:
        yield made()


def _counter(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's number of documents (term -1) and of terms (-2), and documents by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, terms = Counter(), 0, 0
        for batch in batches:
            for _, texts in _texts(batch, 0):
                for found in map(terms_of, texts):
                    docs += bool(found)
                    terms += len(found)
                    df.update(vocabulary.keys() & set(found))
        rows = [(-1, docs), (-2, terms), *((vocabulary[t], n) for t, n in df.items())]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["term", "n"])

    return run


def weights(texts: DataFrame, block: Block) -> Weights:
    """A pass over all texts; the driver gets a row for each term of the block."""
    found = texts.mapInArrow(_counter(block.vocabulary), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {row["term"]: row["n"] for row in found}
    docs, terms = n.get(-1, 0), n.get(-2, 0)
    weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * n.get(t, 0) + 1))) for t in range(len(block.vocabulary))]
    return Weights(block, np.array(weight, np.int64), docs, terms)


@dataclass
class Heap:
    """The best documents of a query so far, by falling score and then id."""

    limit: int
    rows: list[tuple[int, object]] = field(default_factory=list)

    def threshold(self) -> int:
        """The least score that a further document needs; an equal one may have a smaller id."""
        return self.rows[-1][0] if len(self.rows) == self.limit else 1

    def add(self, rows: list[tuple[int, object]]) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[: self.limit]


@dataclass
class Shard:
    """Postings of some documents: of each term its documents (ascending places) and impacts."""

    ids: list[object]
    first: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, ids: list[object], docs: list[int], terms: list[int], tfs: list[int], lengths: list[int], w: Weights) -> Shard:
        doc, term, tf = np.array(docs, np.int64), np.array(terms, np.int64), np.array(tfs, np.int64)
        m = np.array([w.length_part(n) for n in lengths], np.int64)
        impact = w.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.argsort(term, kind="stable")  # places ascend within a term
        term, doc, impact = term[order], doc[order], impact[order]
        first = np.searchsorted(term, np.arange(len(w.weight) + 1))
        most = np.zeros(len(w.weight), np.int64)
        held = np.flatnonzero(np.diff(first))
        if len(held):
            most[held] = np.maximum.reduceat(impact, first[held])
        return cls(ids, first, doc, impact, most)

    def search(self, terms: list[int], heap: Heap) -> int:
        """Adds the shard's documents that belong into the heap; how many were scored."""
        lists = sorted((int(self.most[t]), t) for t in terms if self.most[t] > 0)
        bounds = np.array([b for b, _ in lists], np.int64)
        below = np.concatenate([[0], np.cumsum(bounds)])  # what the first lists can add together
        docs = [self.docs[self.first[t] : self.first[t + 1]] for _, t in lists]
        impacts = [self.impacts[self.first[t] : self.first[t + 1]] for _, t in lists]
        edges = np.arange(0, len(self.ids) + PIVOT_DOCS, PIVOT_DOCS)
        cuts = [np.searchsorted(d, edges) for d in docs]
        scored = 0
        for b, low in enumerate(edges[:-1]):
            least = heap.threshold()
            if below[-1] < least:
                break
            # The first lists together do not reach the threshold: a pivot lies in one of the others.
            rest = int(np.searchsorted(below, least, side="left")) - 1
            reach = np.zeros(PIVOT_DOCS, np.int64)
            for x in range(rest, len(lists)):
                reach[docs[x][cuts[x][b] : cuts[x][b + 1]] - low] += bounds[x]
            pivots = np.flatnonzero(reach)
            for x in range(rest - 1, -1, -1):
                pivots = pivots[reach[pivots] + below[x + 1] >= least]
                if not len(pivots):
                    break
                mine = docs[x][cuts[x][b] : cuts[x][b + 1]] - low
                at = np.searchsorted(mine, pivots)
                held = pivots[mine[np.minimum(at, len(mine) - 1)] == pivots] if len(mine) else mine
                reach[held] += bounds[x]
            pivots = pivots[reach[pivots] >= least]
            if not len(pivots):
                continue
            scored += len(pivots)
            score = np.zeros(len(pivots), np.int64)
            for x in range(len(lists)):
                mine = docs[x][cuts[x][b] : cuts[x][b + 1]] - low
                if len(mine):
                    at = np.minimum(np.searchsorted(mine, pivots), len(mine) - 1)
                    hit = mine[at] == pivots
                    score[hit] += impacts[x][cuts[x][b] + at[hit]]
            good = np.flatnonzero(score >= least)
            if len(good) > heap.limit:  # all that tie with the last one stay, as ids decide
                good = good[score[good] >= np.partition(score[good], -heap.limit)[-heap.limit]]
            heap.add([(int(score[i]), self.ids[low + pivots[i]]) for i in good])
        return scored


def _searcher(w: Weights, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kind = w.block.vocabulary, pa.int64()
        heaps = [Heap(limit) for _ in w.block.queries]
        ids, docs, terms, tfs, lengths = [], [], [], [], []

        def flush() -> None:
            if docs:
                shard = Shard.of(ids, docs, terms, tfs, lengths, w)
                for query, heap in zip(w.block.queries, heaps, strict=True):
                    shard.search(query, heap)
            for x in (ids, docs, terms, tfs, lengths):
                x.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            for part, texts in _texts(batch, 1):
                for key, found in zip(part.column(0).to_pylist(), map(terms_of, texts), strict=True):
                    counts = Counter(found)
                    held = vocabulary.keys() & counts.keys()
                    if held:
                        docs.extend([len(ids)] * len(held))
                        terms.extend(vocabulary[t] for t in held)
                        tfs.extend(counts[t] for t in held)
                        ids.append(key)
                        lengths.append(len(found))
                if len(docs) >= SHARD_POSTINGS:
                    flush()
        flush()
        rows = [(q, key, score) for q, heap in enumerate(heaps) for score, key in heap.rows]
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score"])

    return run


def merged(heaps: DataFrame, limit: int) -> DataFrame:
    """The best of all heaps ``query, id, score`` with their rank; a query's rows are dealt to salts first."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    salted = heaps.withColumn("_salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
    few = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("query", "_salt").orderBy(*order))).where(F.col("_nth") <= limit).drop("_salt", "_nth")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= limit)


def search(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``query_id, rank, id, score``: of each query the ``limit`` documents with the highest scores above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), queries.schema[query_col].dataType.simpleString()
    out: list[DataFrame] = []
    for block in blocks(queries, query_col, query_text_col):
        if out:  # with several blocks each one's result is a table, so that none keeps its queries
            out[-1] = written(out[-1])
        w = weights(rows.select("text"), block)
        best = merged(rows.mapInArrow(_searcher(w, limit), f"query int, id {kinds[0]}, score bigint"), limit)
        keys = spark.createDataFrame(list(enumerate(block.keys)), f"query int, query_id {kinds[1]}")
        out.append(best.join(F.broadcast(keys), "query").select("query_id", "rank", "id", "score"))
    if not out:
        return spark.createDataFrame([], f"query_id {kinds[1]}, rank int, id {kinds[0]}, score bigint")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
