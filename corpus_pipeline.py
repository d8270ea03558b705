"""A corpus pipeline of five stages, each of one operator.

Every stage works on all that the one before kept. Language ID drops documents in no
known language; line dedup takes common lines out of texts; SimHash near-dedup keeps one
document of each group; secret scans replace secrets by a mark; packing lays the texts
out in sequences. Stages that change a text set ``n_chars`` anew.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspan.llm import langid, linedup, secrets, simhash
from memspan.llm.queries import language_model, packed
from memspan.sources.tables import discard, fresh_path, read_table, written


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``n_chars``, if it is one, as the text has it."""
    n = F.length("text")
    return docs.select(*(n.cast(like.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in like.columns))


def _unused(docs: DataFrame, name: str) -> str:
    """The name, with as many marks as make it none of the columns'."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is none of those learned."""
    pred = _unused(docs, "_lang_pred")
    found = langid.annotate(docs, language_model(docs), pred_col=pred, score_col=_unused(docs, "_lang_score"))
    return found.where(F.col(pred) != langid.UNKNOWN).select(*(f"`{c}`" for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that many documents share."""
    # The operator's own counts stay apart from columns of these names.
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))) if len(docs.columns) > 2 else F.struct(F.lit(0))
    found = linedup.drop_common_lines(docs.select("doc_id", "text", others.alias("others")))
    back = found.select(*(F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in docs.columns))
    return _counted(back, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates, once.

    A document is its id and a hash of its text, so texts with null or equal ids are told
    apart; documents without id come last. Of rows with one id and text the one with the
    least other columns stays, whatever the order of input. Documents meet what is kept by a
    struct, in which nulls are equal, and are told from repeats where they are then, so
    texts are exchanged once.
    """
    # The cast makes all fields nullable, as they come back, so that the join casts nothing and one exchange serves both.
    kind = f"struct<no_id:boolean,doc_id:{docs.schema['doc_id'].dataType.simpleString()},row:bigint>"
    keyed = docs.select(F.struct("*").alias("_doc"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("row")).cast(kind).alias("_key"), "text")
    found = simhash.near_duplicates(keyed, id_col="_key")
    first = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("_key"))
    others = [F.col("_doc")[f.name] for f in docs.schema.fields if f.name != "text" and not re.search("map<|variant", f.dataType.simpleString())]
    kept = keyed.drop("text").join(first.distinct(), "_key", "left_semi").groupBy("_key").agg(F.min_by("_doc", F.struct(*others)).alias("_doc"))
    return kept.select("_doc.*")


def secret_marks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark."""
    return _counted(secrets.redact(docs), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays documents out in sequences."""
    return packed(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_marks),
    ("packing", sequences),
]

#: SQL cannot express the language model, the fingerprints and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each stage's result is a table that the next one reads.

    A stage's table is removed when the next one is written; the last one stays, as the result reads it.
    """
    docs, held = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = fresh_path(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if held:
            discard(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
