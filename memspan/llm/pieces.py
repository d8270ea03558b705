"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of a model that marks white space in front of words holds a mark after
another character, so a merge never crosses from one marked word into the next.
Each distinct marked word is segmented once for a task's table, and a text's ids are its
words' ids joined by position. A table of all tasks would have to be joined with every word,
which moves several times the input; a task's own table moves nothing.

Defined cases: a null or empty text has no ids and decodes to an empty string.
Repeated rows and ids give repeated result rows; an empty table gives none. Texts
of any length are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memspan.llm.common import columns, slices, small_batches

MARK = "▁"
#: Chunks held by a task's table before it starts afresh: this bounds memory, not the result.
TABLE_CHUNKS = 200_000
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


def chunk_keys(text: str) -> list[str]:
    """The text's marked words, each without its first mark."""
    if not text:
        return []
    plain = text.replace(MARK, " ")
    if "  " not in plain and plain[0] != " " and plain[-1] != " ":
        return plain.split(" ")
    return [chunk[1:] for chunk in _MARKED.findall(MARK + plain.replace(" ", MARK))]


class ChunkTable:
    """Ids and decoded text of distinct marked words."""

    def __init__(self, model: str, limit: int = TABLE_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        crossing = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces of {model} cross white-space marks, as {crossing[0]!r} does")
        self.limit = limit
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}

    def learn(self, keys: set[str]) -> None:
        """Segments the words that the table does not hold."""
        fresh = keys - self.ids.keys()
        if fresh and len(self.ids) + len(fresh) > self.limit:
            self.ids.clear()
            self.texts.clear()
            fresh = keys
        if "" in fresh:
            self.ids[""] = np.array([self.model.piece_to_id(MARK)], "<i4").tobytes()
            self.texts[""] = " "
        words = [key for key in fresh if key]
        if not words:
            return
        coded = self.model.encode([word.replace(MARK, " ") for word in words], num_threads=1)
        for word, ids, text in zip(words, coded, self.model.decode(coded, num_threads=1), strict=True):
            self.ids[word] = np.array(ids, "<i4").tobytes()
            self.texts[word] = f" {text}"


def _round_trip(model: str, decoded: bool, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model, limit)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                keys = [chunk_keys(text) for text in part.column(1).to_pylist()]
                table.learn(set().union(*keys))
                coded = [b"".join([table.ids[key] for key in words]) for words in keys]
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int64)
                ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4"))).cast(pa.list_(pa.int32()))
                out = [part.column(0), ids]
                if decoded:
                    out.append(pa.array(["".join([table.texts[key] for key in words])[1:] for words in keys], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded"][: len(out)])

    return run


def round_trip(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True, table_chunks: int = TABLE_CHUNKS) -> DataFrame:
    """``id``, ``ids`` (without begin or end ids) and, if asked for, the text they decode to."""
    small_batches(df.sparkSession)
    rows = columns(df, id=id_col, text=text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded
    return rows.mapInArrow(_round_trip(model, decoded, table_chunks), schema)


def encode(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the ``ids`` of each whole text."""
    return round_trip(df, model, id_col=id_col, text_col=text_col, decoded=False)


def decode(df: DataFrame, model: str, *, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id`` and the ``decoded`` text of each list of ids; a null list decodes to an empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    small_batches(df.sparkSession)
    rows = columns(df, id=id_col, ids=ids_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, decoded string")
