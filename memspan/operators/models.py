"""Pluggable models and the structured replies that language models give.

A model is a function of a list of texts; the defaults are deterministic and need no
files. Replies are parsed and applied by column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspan.functions import text
from memspan.sources.tables import checkpoint

DIMENSION = 64
#: Texts that an embedder is given at once.
BATCH = 64
#: Trigrams that are hashed together.
TRIGRAMS = 1 << 18
REPLY = (
    "new_note struct<keywords:array<string>,tags:array<string>,context:string>, "
    "neighbour_updates array<struct<id:string,keywords_add:array<string>,keywords_remove:array<string>,tags_add:array<string>,tags_remove:array<string>,context_rewrite:string,"
    "link_to_new:struct<`create`:boolean,relation:string,score:double>,supersedes_new:boolean,superseded_by_new:boolean>>"
)
Embedder = Callable[[Sequence[str]], np.ndarray]
#: A language model: a system prompt and what it is told, to its reply.
Model = Callable[[str, str], str]
#: What a model is asked to make of a hook event; the tags are those that ``compression`` reads.
COMPRESS_ASKED = (
    "An event of a coding session follows as JSON. Describe it in XML tags: type, title, subtitle, narrative, one fact, keyword or file tag for each "
    "fact, keyword and file, and importance from 1 to 10."
)


def _crc_steps() -> np.ndarray:
    """What CRC-32 makes of each byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    return step


_CRC = _crc_steps()


def _trigram_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of every three neighbouring characters of UTF-8 bytes; ``starts`` has the place of each character, and the end."""
    first, size = starts[:-3], starts[3:] - starts[:-3]
    crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
    for k in range(int(size.max(initial=0))):
        some = slice(None) if k < 3 else np.flatnonzero(size > k)  # a character has a byte at least
        crc[some] = _CRC[(crc[some] ^ data[first[some] + k]) & 0xFF] ^ (crc[some] >> 8)
    return ~crc


def hashed_trigrams(texts: Sequence[str], dimension: int = DIMENSION) -> np.ndarray:
    """The default embedder: unit vectors of signed hashes of character trigrams, hashed together."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, value in zip(out, texts, strict=True):
        data = np.frombuffer(f"  {value.lower()}  ".encode(), np.uint8)
        starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        held = np.zeros(2 * dimension, np.int64)
        for i in range(0, len(starts) - 3, TRIGRAMS):
            h = _trigram_hashes(data, starts[i : i + TRIGRAMS + 3])
            held += np.bincount(h % dimension * 2 + ((h >> 16) & 1), minlength=2 * dimension)
        row[:] = held[1::2] - held[::2]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def embedded(df: DataFrame, text_col: str, out_col: str = "embedding", model: Embedder = hashed_trigrams) -> DataFrame:
    """Rows with vectors of their text; rows that have one keep it, so this is also the reindexing of what lacks one.

    Equal texts of a batch are embedded once; a model gets ``BATCH`` texts at a time.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            codes, texts = pd.factorize(batch.fillna(""))
            made = [v for i in range(0, len(texts), BATCH) for v in model(list(texts[i : i + BATCH]))]
            yield pd.Series([made[c] for c in codes])

    vectors = F.pandas_udf(run, "array<float>")  # type: ignore[call-overload]
    made = vectors(F.col(text_col))
    if out_col not in df.columns:
        return df.withColumn(out_col, made)
    have = df.where(F.col(out_col).isNotNull())
    return have.unionByName(df.where(F.col(out_col).isNull()).withColumn(out_col, made))


def prompt_hash(prompt: Column, system: str, version: str) -> Column:
    """What an answer is known by: the model's version, the system prompt and the prompt."""
    return F.sha2(F.concat_ws("\x1f", F.lit(version), F.lit(system), prompt), 256)


def replies(asked: DataFrame, model: Model, system: str, known: DataFrame, version: str = "1", prompt_col: str = "prompt") -> DataFrame:
    """``hash, reply, failed`` of prompts that are not answered yet: each distinct one is asked once, in tasks.

    A model that raises, or gives no text, leaves a row that has failed, which is asked
    again the next time; the others are not. Prompts that are null are not asked.
    """
    hashed = asked.select(F.col(prompt_col).alias("prompt")).where("prompt is not null").distinct().withColumn("hash", prompt_hash(F.col("prompt"), system, version))
    todo = hashed.join(known.where("not failed").select("hash"), "hash", "left_anti").select("hash", "prompt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for prompt in batch["prompt"]:
                try:
                    reply = model(system, prompt)
                except Exception:  # whatever a model raises, the other rows have their answers
                    reply = None
                told.append(reply if isinstance(reply, str) else None)
            yield pd.DataFrame({"hash": batch["hash"], "reply": pd.Series(told, dtype=object), "failed": [r is None for r in told]})

    return checkpoint(todo.mapInPandas(run, "hash string, reply string, failed boolean"))


def all_replies(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table of replies after more were given: one row for each hash, an answer before a failure."""
    both = known.select("hash", "reply", "failed").unionByName(fresh)
    return both.groupBy("hash").agg(F.min_by("reply", F.struct("failed", "reply")).alias("reply"), F.bool_and("failed").alias("failed"))


def compressed(seen: DataFrame, answered: DataFrame, version: str = "1") -> DataFrame:
    """Observations by a model's reply ``hash, reply``, and by rules where it has failed or tells no type and title.

    ``seen`` has the columns that rules make and the ``prompt``.
    """
    told = answered.where("not failed").select(F.col("hash").alias("_hash"), compression(F.col("reply")).alias("_told"))
    both = seen.join(told, prompt_hash(F.col("prompt"), COMPRESS_ASKED, version) == F.col("_hash"), "left")
    good = (F.col("_told.obs_type") != "") & (F.col("_told.title") != "")
    names = ("obs_type", "title", "subtitle", "narrative", "facts", "keywords", "files", "importance", "confidence")
    made = {c: F.when(good, F.col(f"_told.{c}")).otherwise(F.col(c) if c in seen.columns else F.lit(None)) for c in names}
    return both.withColumns(made).drop("_hash", "_told", "prompt")


def embed_text(title: Column, body: Column, keywords: Column, files: Column) -> Column:
    """What of a record is embedded: title, body, and its keywords and files if there are any."""
    listed = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, ", ")))
    return F.concat_ws("\n", title, body, listed("keywords", keywords), listed("files", files))


def compression(reply: Column) -> Column:
    """An observation that a model told in tags; importance 5 and confidence 0.8 by default."""
    one = lambda tag: F.trim(F.get(text.xml_all(reply, tag), F.lit(0)))
    listed = lambda tag: F.filter(F.transform(text.xml_all(reply, tag), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        one("type").alias("obs_type"),
        one("title").alias("title"),
        one("subtitle").alias("subtitle"),
        one("narrative").alias("narrative"),
        listed("fact").alias("facts"),
        listed("keyword").alias("keywords"),
        listed("file").alias("files"),
        F.coalesce(one("importance").try_cast("int"), F.lit(5)).alias("importance"),
        F.lit(0.8).alias("confidence"),
    )


def procedures(reply: Column) -> Column:
    """Procedures with a name, a trigger and steps; those without steps are left out."""
    parts = F.regexp_extract_all(reply, F.lit(r'(?s)(<procedure\s.*?</procedure>)'), F.lit(1))
    made = F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, 'name="([^"]*)"', 1).alias("name"),
            F.regexp_extract(p, 'trigger="([^"]*)"', 1).alias("trigger_condition"),
            F.filter(F.transform(text.xml_all(p, "step"), lambda s: F.trim(s)), lambda s: s != "").alias("steps"),
        ),
    )
    return F.filter(made, lambda p: F.size(p["steps"]) > 0)


def evolution(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Replies ``new_id, allowed`` with the parsed updates of allowed neighbours, a row each."""
    parsed = replies.select("new_id", "allowed", F.from_json(text.json_slice(F.col(reply_col)), REPLY).alias("r"))
    updates = parsed.select("new_id", "allowed", F.explode("r.neighbour_updates").alias("u")).where(F.array_contains("allowed", F.col("u.id")))
    return updates.select("new_id", "u.*")


def evolve(memory: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next version of memories after updates, and the edges to the new ones.

    Of several updates of one memory that of the smallest new id counts.
    """
    first = updates.groupBy("id").agg(F.min_by(F.struct(*(c for c in updates.columns if c != "id")), "new_id").alias("u"))
    none = F.array().cast("array<string>")
    old = memory.join(first, "id", "left")

    def merged(name: str) -> Column:
        kept = F.array_except(F.col(name), F.coalesce(F.col(f"u.{name}_remove"), none))
        return F.when(F.col("u").isNotNull(), F.array_distinct(F.concat(kept, F.coalesce(F.col(f"u.{name}_add"), none)))).otherwise(F.col(name)).alias(name)

    gone = F.coalesce(F.col("u.superseded_by_new"), F.lit(False))
    changed = {
        "keywords": merged("keywords"),
        "tags": merged("tags"),
        "context": F.coalesce("u.context_rewrite", "context").alias("context"),
        "is_latest": (F.col("is_latest") & ~gone).alias("is_latest"),
        "superseded_by": F.when(gone, F.col("u.new_id")).otherwise(F.col("superseded_by")).alias("superseded_by"),
    }
    after = old.select(*(changed.get(c, F.col(c)) for c in memory.columns))
    linked = updates.where(F.col("link_to_new.create"))
    edges = linked.select(
        F.col("id").alias("src"), F.col("new_id").alias("dst"), F.coalesce("link_to_new.relation", F.lit("similar_to")).alias("relation"), F.lit("llm").alias("via"), F.coalesce("link_to_new.score", F.lit(0.5)).alias("edge_score")
    )
    return after, edges
