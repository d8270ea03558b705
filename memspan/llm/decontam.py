"""Benchmark decontamination by a prefix-filtered set join [native].

An item's windows are runs of ten words, or all its words if it has fewer. A window is
a set of shingles of five words (of all its words, if it has fewer), and a document holds it
if it holds them all in place. Shingles are ordered by rarity, that is how often documents
hold them; as all of a window's shingles are needed, its prefix is its rarest one, and
only that is joined. An item shingle that no document holds rules its windows out before
anything is joined.

A match of a prefix tells where the window would begin (positional bound) and end
(length bound); what is left is verified word by word against that stretch of the document.
Windows that several items share are one window.

Two passes over the texts: one that finds item shingles and counts them, whose matches are
a table in the shared folder, and one that verifies. Documents meet their candidates by id
and a hash of their text; texts are exchanged only where the candidates are too many to be
broadcast. Item shingles are broadcast up to a stated number; beyond it rows meet them under
a salt, so a shingle of a third of all documents is dealt to many tasks.

Words are the runs of digits, letters and characters beyond ASCII, with A-Z lower-cased and
nothing else.

Defined cases: a null text has no words; a document without words, or one without an
item's window, has no hits; items without words have no windows. Rows that repeat an item
id are one item with the windows of all; an item without id counts, its id being empty
text. Rows that repeat a document's id are judged each. A word that several windows cover
is hit once. An empty table of documents gives no rows; without items nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspan.llm.common import ascii_lower, let
from memspan.sources.tables import written

WINDOW, SHINGLE = 10, 5
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles of items up to which they are broadcast: some tens of bytes each.
BROADCAST_ROWS = 1 << 18
#: Parts into which the rows of a shingle are dealt beyond that.
SALTS = 32


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingles(words: Column, sizes: list[int]) -> Column:
    """``pos, h`` of all shingles of the given sizes; the size is part of the hash."""

    def hashed(at: Column) -> Column:
        run = lambda size: F.transform(F.slice(at, 1, F.greatest(F.size(at) - (size - 1), F.lit(0))), lambda w, i: F.struct(i.alias("pos"), F.xxhash64(F.lit(size), w, *(F.get(at, i + k) for k in range(1, size))).alias("h")))
        return F.flatten(F.array(*(run(size) for size in sizes))) if len(sizes) != 1 else run(sizes[0])

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``w, items``: the distinct windows, as words, and the ids (as text) of the items that hold each."""
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), words_of(F.col(f"`{text_col}`")).alias("at")).where(F.size("at") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("at") - (window - 1), F.lit(1)))
    cut = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("at", i, window))).alias("w"))
    return cut.groupBy("w").agg(F.collect_set("item").alias("items"))


def _met(rows: DataFrame, few: DataFrame, fits: bool) -> DataFrame:
    """Rows that meet ``few`` on ``h``: a broadcast if that is known to fit, else under a salt."""
    if fits:
        return rows.join(F.broadcast(few), "h")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id", "row", "pos"), F.lit(SALTS)))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, ["h", "_salt"]).drop("_salt")


def contaminated(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``id, n_words, spans, items``: the words of each document, the starts and lengths of windows found in it, and the sorted ids of their items."""
    known = written(item_windows(items, item_col, item_text_col, window))
    lengths = known.select(F.least(F.size("w"), F.lit(shingle)).alias("n")).distinct().collect()  # shingle sizes: five at most
    sizes = sorted(row["n"] for row in lengths) or [shingle]
    # Windows of one size of shingle each: the largest that the window has.
    parts = [known.where(F.least(F.size("w"), F.lit(shingle)) == size).select("w", "items", F.explode(shingles(F.col("w"), [size])).alias("s")) for size in sizes]
    wanted = parts[0]
    for part in parts[1:]:
        wanted = wanted.unionByName(part)
    wanted = written(wanted.select("w", "items", F.col("s.pos").alias("offset"), F.col("s.h").alias("h")))
    asked = wanted.select("h").distinct()
    fits = wanted.count() <= broadcast_rows

    row = F.xxhash64(F.col(f"`{text_col}`"))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    seen = keyed.select("id", "row", words_of(F.col("text")).alias("at")).where(F.size("at") >= sizes[0])
    seen = seen.select("id", "row", F.size("at").alias("n"), F.explode(shingles(F.col("at"), sizes)).alias("s")).select("id", "row", "n", "s.pos", "s.h")
    hits = written(_met(seen, asked, fits))

    counted = hits.groupBy("h").agg(F.count(F.lit(1)).alias("freq"))
    # A window of which a shingle is nowhere cannot be held; of the others the rarest shingle is the prefix.
    ranked = wanted.join(counted, "h", "left").groupBy("w", "items").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "offset", "h")).alias("p"))
    prefix = ranked.where("p.freq > 0").select(F.col("p.h").alias("h"), F.col("p.offset").alias("offset"), "w", "items")
    placed = _met(hits, prefix, fits).withColumn("start", F.col("pos") - F.col("offset"))
    placed = placed.where((F.col("start") >= 0) & (F.col("start") + F.size("w") <= F.col("n")))
    candidates = written(placed.groupBy("id", "row").agg(F.collect_set(F.struct("start", "w", "items")).alias("cands")))

    told = candidates.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "cands")
    both = keyed.join(told, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    verified = lambda at: F.struct(F.size(at).cast("long").alias("n"), F.filter("cands", lambda c: F.slice(at, c["start"] + 1, F.size(c["w"])) == c["w"]).alias("found"))
    judged = both.select("id", let(words_of(F.col("text")), verified).alias("v"))
    spans = F.array_sort(F.array_distinct(F.transform("v.found", lambda c: F.struct(c["start"].alias("start"), F.size(c["w"]).alias("length")))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("v.found", lambda c: c["items"]))))
    none = F.array().cast("array<struct<start:int,length:int>>")
    return judged.select("id", F.col("v.n").alias("n_words"), F.coalesce(spans, none).alias("spans"), F.coalesce(ids, F.array().cast("array<string>")).alias("items"))


def words_hit(spans: Column) -> Column:
    """How many words the spans cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).cast("long")
