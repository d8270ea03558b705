"""Document fingerprints by a threshold-scaled sketch [native].

A sketch keeps every shingle hash below a fixed fraction of the hash range. Sketches
of any two documents, however unequal, are samples of their shingles at one rate, so
likeness and containment are estimated from them, and the sketch of a union is the
union of sketches. The rate is the same for texts of every length: of a small text few
hashes or none are kept. A sketch also has one hash of all words in order, so texts of the
same words are known to be alike, however short. Where no hash of either text (for
containment: of the first) is kept although there are shingles, and the words differ,
nothing is known and the estimate is null.

A fingerprint is the hash of all words and the sorted kept hashes, in hex, behind a mark of
whether the text has words. Words are what blanks separate, lower-cased; shingles have five
words; a shorter text is one shingle.

Defined cases: a null or empty text, or one without words, has an empty sketch; two
such have likeness 1, and one of them and another text 0. Texts with the same words have
likeness and containment 1. Ids are integers or strings (in the order of their bytes); rows
that repeat an id follow each other by text hash; a table of one row has itself as its next
row. Null ids come first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspan.llm.common import let

WORDS = 5
#: Hashes have 48 bits; those below a quarter of the range are kept.
BITS = 48
FRACTION = 4
#: Rows that one range of neighbours is meant to hold, ranges at most, and rows for each range by which bounds are chosen.
RANGE_ROWS, MAX_RANGES, CUT_ROWS = 2000, 16_384, 12
#: Below every id.
LEAST = -(1 << 63)


def sketches(df: DataFrame, text_col: str, out_col: str, words: int = WORDS, fraction: int = FRACTION) -> DataFrame:
    """``df`` with ``out_col``, a struct of ``some`` (whether there is a shingle), ``whole`` (a hash of all words) and the kept ``hashes`` of the text column."""
    names = [F.col(f"`{c}`") for c in df.columns]
    limit = (1 << BITS) // fraction
    parts = F.array_remove(F.split(F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), "[ \t\n\x0b\f\r]+"), "")
    small = lambda h: F.shiftrightunsigned(h, 64 - BITS)
    run = lambda at: F.transform(F.slice(at, 1, F.size(at) - (words - 1)), lambda w, i: small(F.xxhash64(w, *(F.get(at, i + k) for k in range(1, words)))))
    none = F.array().cast("array<bigint>")
    shingles = lambda at: F.when(F.size(at) >= words, run(at)).when(F.size(at) > 0, F.array(small(F.xxhash64(at)))).otherwise(none)
    kept = lambda at: let(shingles(at), lambda hashes: F.struct((F.size(hashes) > 0).alias("some"), F.xxhash64(at).alias("whole"), F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < limit))).alias("hashes")))
    return df.select(*names, let(F.transform(parts, lambda w: F.xxhash64(w)), kept).alias(out_col))


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: equal sketches have equal texts."""
    return F.concat(F.when(sketch["some"], "1:").otherwise("0:"), F.lower(F.hex(sketch["whole"])), F.lit(":"), F.array_join(F.transform(sketch["hashes"], lambda h: F.lower(F.hex(h))), "."))


def compared(a: Column, b: Column) -> Column:
    """The number of hashes on which a likeness rests."""
    return F.size(F.array_union(a["hashes"], b["hashes"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; null where nothing is known."""
    both, union = F.size(F.array_intersect(a["hashes"], b["hashes"])), compared(a, b)
    return F.when(a["whole"] == b["whole"], 1.0).when(a["some"] & b["some"], F.when(union > 0, both / union)).otherwise(F.when(a["some"] | b["some"], 0.0).otherwise(1.0)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second one has; null where nothing is known."""
    both, mine = F.size(F.array_intersect(a["hashes"], b["hashes"])), F.size(a["hashes"])
    return F.when(a["whole"] == b["whole"], 1.0).when(a["some"] & b["some"], F.when(mine > 0, both / mine)).otherwise(F.when(a["some"], 0.0).otherwise(1.0)).cast("double")


def merge(a: Column, b: Column) -> Column:
    """The sketch of both documents' shingles together; of different words there is no hash of all."""
    return F.struct((a["some"] | b["some"]).alias("some"), F.when(a["whole"] == b["whole"], a["whole"]).alias("whole"), F.sort_array(F.array_union(a["hashes"], b["hashes"])).alias("hashes"))


def _range_of(key: Column, tie: Column, firsts: list[tuple]) -> Column:
    """The index of the last of ``firsts`` that is not above key and tie, by binary search."""
    keys, ties = F.lit([k for k, _ in firsts]), F.lit([t for _, t in firsts])
    steps = F.lit([1 << k for k in reversed(range(max(1, len(firsts).bit_length())))])
    below = lambda i: (F.get(keys, i) < key) | ((F.get(keys, i) == key) & (F.get(ties, i) <= tie))
    found = F.aggregate(steps, F.lit(-1), lambda at, step: F.when((at + step < len(firsts)) & below(at + step), at + step).otherwise(at))
    return F.greatest(found, F.lit(0))


def _range_key(df: DataFrame, id_col: str) -> tuple[Column, object]:
    """What orders as the id does, nulls first, without a null; and the least of it."""
    name, kind = F.col(f"`{id_col}`"), df.schema[id_col].dataType
    if isinstance(kind, T.IntegralType):
        return F.coalesce(name.cast("long"), F.lit(LEAST)), LEAST
    if not isinstance(kind, T.StringType):
        raise TypeError(f"ids must be integers or strings, not {kind.simpleString()}")
    return F.when(name.isNull(), "").otherwise(F.concat(F.lit("1"), name)), ""


def with_next(df: DataFrame, *, id_col: str = "doc_id", tie: Column | None = None, carry: tuple[str, ...] = (), made: Callable[[DataFrame], DataFrame] | None = None, carry_made: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``next_<name>`` of the following row for each carried column; the first row follows the last.

    Rows are dealt to ranges of ids and ties (integers or short strings), so rows of one id are
    split too. The first rows of a range also go to the range
    before it, so no range waits for another and each stays small. ``made`` may then derive
    columns where the rows lie, ``carry_made`` of which are carried without another exchange.
    """
    key, least = _range_key(df, id_col)
    tied = F.lit(0) if tie is None else tie
    told = isinstance(df.select(tied.alias("t")).schema["t"].dataType, T.StringType)
    tied, least_tie = (F.coalesce(tied, F.lit("")), "") if told else (F.coalesce(tied.cast("long"), F.lit(LEAST)), LEAST)
    pairs = df.select(key.alias("k"), tied.alias("t"))
    total = pairs.count()
    ranges = min(MAX_RANGES, -(-total // RANGE_ROWS))
    firsts: list[tuple] = []
    if ranges:
        # Bounds are chosen by a sample of about ``CUT_ROWS`` rows for each range; they hold all rows apart, those of one id too.
        coded, plain = (lambda x: x.encode() if isinstance(x, str) else x), (lambda x: x.decode() if isinstance(x, bytes) else x)
        sample = sorted((coded(r["k"]), coded(r["t"])) for r in pairs.sample(fraction=min(1.0, CUT_ROWS * ranges / total), seed=3).collect())
        cuts = sorted({sample[i * len(sample) // ranges] for i in range(ranges)}) if sample else [(coded(least), coded(least_tie))]
        rough = [(plain(k), plain(t)) for k, t in cuts]
        found = pairs.groupBy(_range_of(F.col("k"), F.col("t"), rough).alias("r")).agg(F.min(F.struct("k", "t")).alias("first")).orderBy("r").collect()  # a row for each range
        firsts = [(r["first"]["k"], r["first"]["t"]) for r in found]
    firsts = firsts or [(least, least_tie)]
    at = F.col("_range")
    is_first = (F.get(F.lit([k for k, _ in firsts]), at) == F.col("_key")) & (F.get(F.lit([t for _, t in firsts]), at) == F.col("_tie"))
    own = F.struct(at.alias("r"), F.lit(0).alias("guest"))
    before = F.when((at > 0) & is_first, F.struct((at - 1).alias("r"), F.lit(1).alias("guest")))
    around = F.when((at == 0) & is_first, F.struct(F.lit(len(firsts) - 1).alias("r"), F.lit(2).alias("guest")))
    names = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.select(*names, F.col(f"`{id_col}`").alias("_id"), key.alias("_key"), _range_of(key, tied, firsts).alias("_range"), tied.alias("_tie"))
    places = ["_r", "_guest", "_key", "_id", "_tie"]
    placed = keyed.select("*", F.explode(F.array_compact(F.array(own, before, around))).alias("_at")).select(*names, F.col("_at.r").alias("_r"), F.col("_at.guest").alias("_guest"), *places[2:])
    window = Window.partitionBy("_r").orderBy(*places[1:])
    following = lambda rows, what: rows.select("*", *(F.lead(F.col(f"`{c}`")).over(window).alias(f"next_{c}") for c in what))
    found = following(placed, carry)
    if made is not None:
        found = following(made(found), carry_made)
    return found.where("_guest = 0").drop(*places)
