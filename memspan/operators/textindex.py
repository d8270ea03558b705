"""Inverted indexes of text fields: stemmed tokens of any script, stored by term, in segments.

Texts are analysed as tokens (runs of letters, or of digits), lower-cased and stemmed for
English. A segment is a table of postings ``field, term, block, id, tf, dl`` laid out by
bucket and term, what it adds to each term's number of texts and to the number and length
of texts, and the ids that it hides in older segments. A search reads the buckets and row
groups of its own terms only, whatever the size of the texts. Statistics are those of the
whole table; scopes are applied to what is found.

A change writes one small segment: postings of new rows, and counts with the old rows' taken
off, so scores are those of an index built at once. Segments of about one size are merged
when there are ``FAN`` of them, so there are few, and a posting is written again only a
logarithmic number of times. Old segments stay for those who still read them, until ``vacuum``.

For the best hits alone, texts are dealt to blocks by a hash of their id, and of terms that
many texts hold the largest frequency and smallest length in each block are stored. They
bound what a text of a block can score. The blocks with the highest bounds are scored
first; the last of their best hits is a threshold, and of the other blocks only those are
read whose bound reaches it.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspan.functions import text
from memspan.functions.stem import stem
from memspan.sources.tables import checkpoint, fresh_path, written

K1, B = 1.2, 0.75
#: Folders that postings are laid into by a hash of their term.
BUCKETS = 32
#: Texts meant for a block, and blocks at most.
BLOCK_TEXTS, MAX_BLOCKS = 256, 1 << 16
#: Blocks whose postings are written together: of a term that many texts hold each task has so many blocks.
SLICE_BLOCKS, MAX_SLICES = 1024, 64
#: Postings that a task sends on at once, and frequent terms up to which they are told to all tasks.
BATCH_POSTINGS, TOLD_TERMS = 1 << 17, 1 << 20
#: Words whose stems a task keeps.
KNOWN_WORDS = 1 << 18
#: Postings of a segment from which a term's blocks are described; of fewer all are read.
FREQUENT = 1024
#: Postings up to which a search reads all that its terms have; blocks that give a threshold.
READ_ALL, FIRST_BLOCKS = 1 << 18, 16
#: Blocks that are named to the reader, which then skips what lies between.
NAMED_BLOCKS = 2000
#: Terms of a query up to which each has a sum of its own.
SUMMED_APART = 64
#: Segments of about one size that are merged, and how many times larger the next size is.
FAN = 8
_TOKEN, _ASCII_TOKEN = regex.compile(text.TOKEN), re.compile("[a-z]+|[0-9]+")
#: Lower-cased text in UTF-8, with blanks for ASCII characters that no token has.
_BLANKS = bytes(b if b >= 0x80 or chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 0x20 for b in range(256))


@lru_cache(1 << 17)
def _stem(word: str) -> str:
    return stem(word)


def terms(value: str) -> list[str]:
    """The stems of a text's tokens, in order."""
    return [_stem(token) for token in _TOKEN.findall(value.lower())]


def _stems(word: bytes) -> tuple[str, ...]:
    """The stems in what stands between blanks and ASCII marks, as tokens hold neither."""
    told = word.decode()
    if word.isalpha():
        return (stem(told),)
    return tuple(stem(token) for token in (_ASCII_TOKEN if word.isascii() else _TOKEN).findall(told))


def term_counts(value: str, known: dict[bytes, tuple[str, ...]] | None = None) -> dict[str, int]:
    """How often a text has each stem; a word is looked at once, however often it stands there, and not at all if it is known."""
    out: dict[str, int] = {}
    known = {} if known is None else known
    for word, n in Counter(value.lower().encode().translate(_BLANKS).split()).items():
        found = known.get(word)
        if found is None:
            found = known[word] = _stems(word)
        for term in found:
            out[term] = out.get(term, 0) + n
    return out


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order."""
    return list(dict.fromkeys(terms(query)))


def _post(fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of rows ``id, block`` and texts, some at a time and in the order in which they are stored."""

    def made(name: str, rows: list[pa.Array], start: int, counts: list[dict[str, int]]) -> pa.RecordBatch:
        held = np.array([len(c) for c in counts], np.int64)
        size = np.array([sum(c.values()) for c in counts], np.int64)
        found = pa.array(list(chain.from_iterable(counts)), pa.string()).dictionary_encode()
        bucket = np.fromiter((zlib.crc32(t.encode()) % BUCKETS for t in found.dictionary.to_pylist()), np.int8, len(found.dictionary))
        by_term = pc.array_sort_indices(found.dictionary).to_numpy()
        place = np.empty(len(bucket), np.int32)
        place[by_term[np.argsort(bucket[by_term], kind="stable")]] = np.arange(len(bucket), dtype=np.int32)
        code = place[found.indices.to_numpy()]
        tfs = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, len(code))
        order = np.argsort(code, kind="stable")
        at = np.repeat(np.arange(start, start + len(counts)), held)[order]
        columns = [pa.repeat(name, len(code)), found.dictionary.take(found.indices.take(pa.array(order))), *(r.take(pa.array(at)) for r in rows), pa.array(tfs[order]), pa.array(np.repeat(size, held)[order])]
        return pa.RecordBatch.from_arrays(columns, names=["field", "term", "id", "block", "tf", "dl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[str, ...]] = {}
        for batch in batches:
            batch = batch.sort_by([("block", "ascending"), ("id", "ascending")])
            for k, name in enumerate(fields):
                counts, start, held = [], 0, 0
                for value in batch.column(k + 2).to_pylist():
                    counts.append(term_counts(value, known) if value else {})
                    if len(known) > KNOWN_WORDS:
                        known.clear()
                    held += len(counts[-1])
                    if held >= BATCH_POSTINGS:
                        yield made(name, batch.columns[:2], start, counts)
                        counts, start, held = [], start + len(counts), 0
                yield made(name, batch.columns[:2], start, counts)

    return run


def _placed(docs: DataFrame, id_col: str, fields: Sequence[str], blocks: int) -> DataFrame:
    """``field, term, id, block, tf, dl`` of every text, in one pass and without an exchange."""
    key = F.col(id_col).alias("id")
    rows = docs.select(key, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), *(F.col(f).cast("string").alias(f"_{i}") for i, f in enumerate(fields)))
    return rows.mapInArrow(_post(list(fields)), f"field string, term string, id {rows.schema['id'].dataType.simpleString()}, block int, tf long, dl long")


def postings(docs: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """``field, term, id, tf, dl`` of every text, in one pass and without an exchange."""
    return _placed(docs, id_col, fields, 1).drop("block")


@dataclass(frozen=True)
class Segment:
    """A part of an index: its folder's name, its place in the order of changes, its postings, and whether it hides any id."""

    name: str
    number: int
    size: int
    hides: bool = False

    @property
    def tier(self) -> int:
        """Segments of one tier differ in size by less than ``FAN`` times."""
        return len(np.base_repr(max(1, self.size // 1024), FAN))



@lru_cache(256)
def _told(index: TextIndex, wanted: tuple[str, ...]) -> dict[str, list[tuple]]:
    """What an index knows of a query's terms, by field; an index never changes."""
    out: dict[str, list[tuple]] = {}
    for r in index._known(wanted).collect():
        out.setdefault(r["field"], []).append((r["term"], r["df"], r["n"], r["avgdl"]))
    return out


@dataclass(frozen=True)
class TextIndex:
    """Segments under ``path``. A changed index is another object over the same folder."""

    spark: SparkSession
    path: str
    id_type: str
    fields: tuple[str, ...]
    blocks: int
    segments: tuple[Segment, ...] = field(default=())

    # Writing

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, fields: Sequence[str], path: str | None = None, blocks: int | None = None) -> TextIndex:
        """Writes an index under ``path``, or in the shared folder."""
        spark = docs.sparkSession
        kind = docs.schema[id_col].dataType.simpleString()
        count = blocks or min(MAX_BLOCKS, max(1, docs.count() // BLOCK_TEXTS))
        index = cls(spark, path or fresh_path(spark), kind, tuple(fields), count)
        return index._with(docs.select(F.col(id_col).alias("id"), *fields), None)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        """An index that was written before, as its last change left it."""
        rows = spark.read.parquet(f"{path}/manifest")
        last = rows.where(F.col("version") == rows.agg(F.max("version")).head()[0]).orderBy("number").collect()  # a row for each segment
        return cls(spark, path, last[0]["id_type"], tuple(last[0]["fields"]), last[0]["blocks"], tuple(Segment(r["name"], r["number"], r["size"], r["hides"]) for r in last))

    def changed(self, gone: DataFrame | None, new: DataFrame | None, id_col: str = "id") -> TextIndex:
        """The index without the rows ``gone`` and with the rows ``new``; a row that changed is in both, as it was and as it is.

        Both have the id and the indexed fields. Rows that are gone must be those indexed, each once.
        """
        pick = lambda df: df.select(F.col(id_col).alias("id"), *self.fields)
        made = self._with(pick(new) if new is not None else None, pick(gone) if gone is not None else None)
        while len(few := made._mergeable()) >= FAN:
            made = made._merged(few)
        return made

    def _with(self, new: DataFrame | None, gone: DataFrame | None) -> TextIndex:
        spark, name = self.spark, uuid.uuid4().hex[:12]
        cores = spark.sparkContext.defaultParallelism
        tables = []
        for docs, sign in ((new, 1), (gone, -1)):
            if docs is not None:
                # A few files, which few tasks would read, are dealt to all cores; the many of a large table are not moved.
                if len(docs.inputFiles()) < cores:
                    docs = docs.repartition(cores, "id")
                tables.append((sign, docs, _placed(docs, "id", self.fields, self.blocks)))
        return self._listed((*self.segments, self._written(name, tables)))

    def _written(self, name: str, tables: list[tuple[int, DataFrame, DataFrame]]) -> Segment:
        """A segment of new rows (sign 1) and rows that are gone (-1). Texts are analysed once; what is counted of new ones is read from what was stored."""
        counts, sizes, hides, held = [], [], False, None
        for sign, docs, found in tables:
            if sign > 0:
                self._laid(name, found)
                held = self._held(name)
                counts.append(held)
            else:
                hides = True
                docs.select("id").distinct().write.parquet(f"{self.path}/hidden/part={name}")
                counts.append(found.groupBy("field", "term").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("tf")))
            sizes.append(docs.agg((sign * F.count(F.lit(1))).alias("docs")))
        both = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
        if held is None:
            self._laid(name, tables[0][2].limit(0))
        self._counted(name, both, sizes[0] if len(sizes) == 1 else sizes[0].unionByName(sizes[1]))
        size = self._described(name, held)
        return Segment(name, 1 + max((s.number for s in self.segments), default=0), size, hides)

    def _held(self, name: str) -> DataFrame:
        """``field, term, df, tf`` of a segment's postings: a row for each term, stored with it."""
        path = f"{self.path}/held/part={name}"
        return written(self._read("postings", [name]).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")), path)

    def _laid(self, name: str, rows: DataFrame) -> None:
        """Postings are dealt by bucket and by slice of blocks, so a term that many texts hold is dealt to several tasks, and each writes its own by term.

        Ranges of terms would need a look at all postings before these are dealt. They come in runs
        of this order, which the sort has only to merge.
        """
        placed = rows.withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int"))
        slices = min(MAX_SLICES, -(-self.blocks // SLICE_BLOCKS))
        dealt = placed.repartition("bucket", F.pmod(F.col("block"), F.lit(slices)))
        dealt.sortWithinPartitions("bucket", "term", "field", "block", "id").write.partitionBy("bucket").parquet(f"{self.path}/postings/part={name}")

    def _dealt(self, table: str, name: str, rows: DataFrame, order: Sequence[str]) -> None:
        """Tables of a row or a few for each term are even enough to be dealt by bucket, which takes no look at their ranges."""
        placed = rows.withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int"))
        placed.repartition("bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.path}/{table}/part={name}")

    def _counted(self, name: str, counts: DataFrame, docs: DataFrame) -> None:
        """What a segment adds to each term, and to the number and length of texts."""
        summed = counts.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        self._dealt("terms", name, summed, ("field", "term"))
        lengths = self._read("terms", [name]).groupBy("field").agg(F.sum("tf").alias("tokens"))
        told = self.spark.createDataFrame([(f,) for f in self.fields], "field string")
        total = docs.agg(F.sum("docs").alias("docs"))
        told.join(lengths, "field", "left").crossJoin(total).select("field", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs")).coalesce(1).write.parquet(f"{self.path}/stats/part={name}")  # a row for each field

    def _described(self, name: str, held: DataFrame | None) -> int:
        """Writes the blocks of a segment's frequent terms; its number of postings."""
        told = held.agg(F.sum("df").alias("n"), F.count(F.when(F.col("df") >= FREQUENT, 1)).alias("frequent")).head() if held is not None else None
        if told and told["frequent"]:
            frequent = held.where(F.col("df") >= FREQUENT).select("field", "term")
            frequent = F.broadcast(frequent) if told["frequent"] <= TOLD_TERMS else frequent  # of at least ``FREQUENT`` postings each
            shown = self._read("postings", [name]).join(frequent, ["field", "term"], "left_semi").groupBy("field", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
            self._dealt("maxima", name, shown, ("field", "term", "block"))
        else:
            self.spark.createDataFrame([], "field string, term string, block int, n bigint, tf bigint, dl bigint, bucket int").write.partitionBy("bucket").parquet(f"{self.path}/maxima/part={name}")
        return (told["n"] if told else 0) or 0

    def _listed(self, segments: Sequence[Segment]) -> TextIndex:
        made = replace(self, segments=tuple(sorted(segments, key=lambda s: s.number)))
        version = uuid.uuid1().time  # later changes have greater ones
        rows = [(version, s.name, s.number, s.size, s.hides, self.id_type, list(self.fields), self.blocks) for s in made.segments]
        self.spark.createDataFrame(rows, "version bigint, name string, number int, size bigint, hides boolean, id_type string, fields array<string>, blocks int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return made

    def _mergeable(self) -> list[Segment]:
        """The newest segments that are no larger than a tier of which there are ``FAN``."""
        out: list[Segment] = []
        for tier in sorted({s.tier for s in self.segments}):
            run = []
            for s in reversed(self.segments):
                if s.tier > tier:
                    break
                run.append(s)
            if len(run) >= FAN:
                out = run
        return out[::-1]

    def _merged(self, few: Sequence[Segment]) -> TextIndex:
        """The index with neighbouring segments as one; ids hidden in still older segments stay hidden."""
        name, names = uuid.uuid4().hex[:12], [s.name for s in few]
        whole = replace(self, segments=tuple(few))
        self._laid(name, whole._live(whole._read("postings")).select("field", "term", "id", "tf", "dl", "block"))
        hides = any(s.hides for s in few) and few[0] != self.segments[0]
        if hides:
            self._read("hidden", [s.name for s in few if s.hides]).select("id").distinct().write.parquet(f"{self.path}/hidden/part={name}")
        counts = self._read("terms", names).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df <> 0 or tf <> 0")
        docs = self._read("stats", names).where(F.col("field") == self.fields[0]).select("docs")
        self._counted(name, counts, docs)
        made = Segment(name, few[-1].number, self._described(name, self._held(name)), hides)
        return self._listed((*(s for s in self.segments if s not in few), made))

    def vacuum(self) -> None:
        """Removes segments that this index does not have: those that merges have replaced."""
        jvm, spark = self.spark.sparkContext._jvm, self.spark
        live = {s.name for s in self.segments}
        for table in ("postings", "held", "terms", "maxima", "stats", "hidden"):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for found in store.listStatus(folder) if store.exists(folder) else ():
                if found.getPath().getName().removeprefix("part=") not in live:
                    store.delete(found.getPath(), True)

    # Reading

    def _schema(self, table: str) -> str:
        """With their schema, as an index of no texts has no files."""
        return {
            "postings": f"field string, term string, id {self.id_type}, tf bigint, dl bigint, block int, part string, bucket int",
            "terms": "field string, term string, df bigint, tf bigint, part string, bucket int",
            "maxima": "field string, term string, block int, n bigint, tf bigint, dl bigint, part string, bucket int",
            "stats": "field string, tokens bigint, docs bigint, part string",
            "hidden": f"id {self.id_type}, part string",
        }[table]

    def _read(self, table: str, names: Sequence[str] | None = None) -> DataFrame:
        names = [s.name for s in self.segments] if names is None else names
        return self.spark.read.schema(self._schema(table)).option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/part={n}" for n in names))

    def _number(self, part: Column) -> Column:
        found = F.lit(None).cast("int")
        for s in self.segments:
            found = F.when(part == s.name, s.number).otherwise(found)
        return found

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows ``part, id`` that no later segment hides."""
        if not (names := [s.name for s in self.segments[1:] if s.hides]):
            return rows
        hidden = self._read("hidden", names).groupBy(F.col("id").alias("_id")).agg(F.max(self._number(F.col("part"))).alias("_until"))
        return rows.join(hidden, (F.col("id") == F.col("_id")) & (self._number(F.col("part")) < F.col("_until")), "left_anti")

    @property
    def postings(self) -> DataFrame:
        """``field, term, id, tf, dl`` of all texts that are not hidden."""
        return self._live(self._read("postings")).select("field", "term", "id", "tf", "dl")

    @property
    def terms(self) -> DataFrame:
        """``field, term, df, n, avgdl`` of all terms."""
        sizes = self._read("stats").groupBy("field").agg(F.sum("docs").cast("double").alias("n"), F.sum("tokens").alias("tokens"))
        counted = self._read("terms").groupBy("field", "term").agg(F.sum("df").cast("double").alias("df")).where("df > 0")
        return counted.join(F.broadcast(sizes), "field").select("field", "term", "df", "n", (F.col("tokens") / F.col("n")).alias("avgdl"))  # a row for each field

    def _of(self, table: DataFrame, fields: Sequence[str], wanted: Sequence[str]) -> DataFrame:
        buckets = sorted({zlib.crc32(term.encode()) % BUCKETS for term in wanted})
        return table.where(F.col("bucket").isin(buckets) & F.col("field").isin(list(fields)) & F.col("term").isin(list(wanted)))

    def _known(self, wanted: Sequence[str]) -> DataFrame:
        """``field, term, df, n, avgdl`` of a query's terms: at most a row for each and field."""
        sizes = self._read("stats").groupBy("field").agg(F.sum("docs").cast("double").alias("n"), F.sum("tokens").alias("tokens"))
        counted = self._of(self._read("terms"), self.fields, wanted).groupBy("field", "term").agg(F.sum("df").cast("double").alias("df")).where("df > 0")
        return counted.join(F.broadcast(sizes), "field").select("field", "term", "df", "n", (F.col("tokens") / F.col("n")).alias("avgdl"))  # a row for each field

    @staticmethod
    def _weight() -> Column:
        idf = F.ln(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return idf * F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], f"id {self.id_type}, score double")

    def bm25(self, field: str, query: str, every: bool = False) -> DataFrame:
        """``id, score`` of texts with any (or every) term of the query."""
        wanted = query_terms(query)
        if not wanted:
            return self._none()
        return self._summed(self._of(self._read("postings"), [field], wanted), F.broadcast(self._known(wanted).where(F.col("field") == field).drop("field")), wanted, len(wanted) if every else 0)

    def _summed(self, rows: DataFrame, known: DataFrame, wanted: Sequence[str], least: int = 0) -> DataFrame:
        """Weights are added in the order of the query's terms, so texts of the same weights have the same score to the last digit."""
        rows = self._live(rows.select("term", "id", "tf", "dl", "part")).join(known, "term")
        held = F.count(F.lit(1)).alias("held")
        if len(wanted) <= SUMMED_APART:
            each = [F.coalesce(F.sum(F.when(F.col("term") == t, self._weight())), F.lit(0.0)) for t in wanted]
            found = rows.groupBy("id").agg(reduce(Column.__add__, each).alias("score"), held)
        else:
            place = F.array_position(F.lit(list(wanted)), F.col("term"))
            listed = F.array_sort(F.collect_list(F.struct(place.alias("at"), self._weight().alias("w"))))
            found = rows.groupBy("id").agg(F.aggregate(listed, F.lit(0.0), lambda total, x: total + x["w"]).alias("score"), held)
        return (found.where(F.col("held") == least) if least else found).select("id", "score")

    def top(self, field: str, query: str, limit: int, scope: DataFrame | None = None, read_all: int = READ_ALL, report: dict | None = None) -> DataFrame:
        """``id, score``: the best hits of any term, within a table of ids if given; equal scores go to the smaller id.

        ``report`` is told how many postings the terms have and how many of them were read.
        """
        wanted = query_terms(query)
        within = lambda hits: hits if scope is None else hits.join(scope.select("id"), "id", "left_semi")
        best = lambda hits: within(hits).orderBy(F.desc("score"), "id").limit(limit)
        if not wanted:
            return self._none()
        told = _told(self, tuple(wanted)).get(field, [])
        total = int(sum(df for _, df, _, _ in told))
        if report is not None:
            report |= {"postings": total, "read": total}
        known = F.broadcast(self.spark.createDataFrame(told, "term string, df double, n double, avgdl double"))
        rows = self._of(self._read("postings"), [field], wanted)
        if total <= read_all:
            return best(self._summed(rows, known, wanted))
        shown = self._of(self._read("maxima"), [field], wanted).select("part", "term", "block", "n", "tf", "dl")
        described = shown.select("part", "term").distinct()
        rare = rows.join(F.broadcast(described), ["part", "term"], "left_anti").groupBy("part", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        held = shown.unionByName(rare).withColumnRenamed("n", "held").join(known, "term")
        # Blocks: as many as the index has, for each segment.
        bounds = checkpoint(held.groupBy("part", "block").agg(F.sum(self._weight()).alias("most"), F.sum("held").alias("held")))
        first = bounds.orderBy(F.desc("most"), "part", "block").limit(FIRST_BLOCKS).select("part", "block").collect()
        found = best(self._summed(self._in(rows, first), known, wanted)).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).head()
        least = found["least"] - 1e-9 if found["n"] == limit else -1.0
        reached = bounds.where(F.col("most") >= least)
        if report is not None:
            report["read"] = reached.agg(F.sum("held")).head()[0] or 0
        some = reached.select("part", "block").limit(NAMED_BLOCKS + 1).collect()
        return best(self._summed(self._in(rows, some) if len(some) <= NAMED_BLOCKS else rows.join(F.broadcast(reached.select("part", "block")), ["part", "block"], "left_semi"), known, wanted))

    @staticmethod
    def _in(rows: DataFrame, blocks: Sequence) -> DataFrame:
        """Rows of a few blocks, by segment: a predicate that reaches the reader."""
        by: dict[str, list[int]] = {}
        for r in blocks:
            by.setdefault(r["part"], []).append(r["block"])
        wanted = F.lit(False)
        for part, some in by.items():
            wanted = wanted | ((F.col("part") == part) & F.col("block").isin(some))
        every = sorted({r["block"] for r in blocks})
        return rows.where(F.col("block").isin(every) & wanted) if every else rows.limit(0)

    def matching(self, fields: Sequence[str], query: str) -> DataFrame:
        """``id`` of texts of which one field holds every term."""
        wanted = query_terms(query)
        rows = self._live(self._of(self._read("postings"), fields, wanted).select("id", "field", "part"))
        held = rows.groupBy("id", "field").agg(F.count(F.lit(1)).alias("held"))
        return held.where(F.col("held") == len(wanted)).select("id").distinct()
