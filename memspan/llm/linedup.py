"""Removal of lines that many documents share [native].

Lines are exploded and hashed; distinct documents are counted for each hash of a
line's key; lines whose key reaches the threshold go; the others are reassembled by
position. Only hashes, document ids and positions are shuffled, until the positions to
drop meet their document.

A key is a line without blanks at both ends and with A-Z lower-cased. Two independent
64-bit hashes stand for it.

Defined cases: a null or empty text is one empty line. Keys shorter than ``min_chars``
never go. Rows that repeat an id count as one document and each keeps its own result. A
text that loses all lines becomes empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspan.llm.common import BLANKS, ascii_lower

THRESHOLD = 10
#: Parts into which the rows of a key are dealt.
SALTS = 32


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_common_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = 1) -> DataFrame:
    """All columns of ``df``, its text without common lines, and ``n_lines`` and ``n_dropped``.

    The text column is replaced; lines that stay are joined by a line feed. Columns of
    ``df`` that are named like the two counts give way to them.
    """
    names = [f"`{c}`" for c in df.columns]
    # A row is its id and a hash of its text: rows that repeat an id keep their own lines.
    row = F.xxhash64(F.col(f"`{text_col}`"))
    keyed = df.select(F.col(f"`{id_col}`").alias("id"), row.alias("row"), F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n").alias("lines"))
    lines = (
        keyed.select("id", "row", F.posexplode("lines").alias("pos", "line"))
        .select("id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "row", "pos", F.xxhash64(F.lit(1), "key").alias("a"), F.xxhash64(F.lit(2), "key").alias("b"))
    )
    common = lines.select("a", "b", "id").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).select("a", "b")
    # A line of a third of all documents is a hot key: its rows are salted and meet a copy of the key for each salt.
    copies = common.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(SALTS)).cast("int"))
    gone = salted.join(copies, ["a", "b", "salt"], "left_semi").select("id", "row", "pos").distinct().groupBy("id", "row").agg(F.collect_list("pos").alias("gone"))
    parts = df.select(F.struct(*names).alias("doc"), F.col(f"`{id_col}`").alias("id"), row.alias("row"))
    joined = parts.join(gone.select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row"), "gone"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")
    text = F.col(f"doc.`{text_col}`")
    split = joined.select("doc", "gone", F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(stays, lambda i: F.get(F.col("lines"), i)), "\n"))
    out = split.select("doc", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in df.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
