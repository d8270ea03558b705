"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers which strings that text
contains. A text is parsed greedily into phrases, each the longest match in the
language's text. The more a text is like that text, the fewer phrases it needs; their
number, times the bits that name a place in the labelled text, over the text's length,
estimates its entropy under the language. The least entropy wins.

Texts are lower-cased and all but letters between two words is one blank; the symbols are
the bytes of that in UTF-8, so scripts of any size are told apart. Texts are parsed whole:
many segments of them are stepped through together, and a segment that a phrase reaches
into is parsed again from that phrase's end, up to where both parses meet.

The model is fitted on a bounded sample of labelled rows: of each language the
``docs_per_lang`` rows with the smallest hash among its rows of at most ``max_chars``
characters, whole; of a language that has longer rows only, the shortest one. Languages
are a small vocabulary: over ``MAX_LANGS`` of them are refused. The automata are built
once and broadcast as edges, about 20 bytes a character of the sample; a task's tables
take four bytes for each state and byte value that occurs, some 7 MB a language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Rows with
a null language or text do not take part in fitting. With no labelled rows every text is
``und``. Ties go to the first language by name, with score 0. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspan.llm.common import columns, slices, small_batches

MAX_LANGS = 200
SEGMENT = 512
UNKNOWN = "und"
#: Languages, and bytes of texts, that are parsed at once: some 60 bytes of memory for a byte and language.
TOGETHER, PART_BYTES = 8, 1 << 20
#: Marks transitions by which a phrase starts: the sign of an entry.
STARTS = np.int32(-(1 << 31))
#: Bound of the sample: rows of a language, and characters of a row that may be one of them.
DOCS_PER_LANG, MAX_CHARS = 24, 4000


class Automaton:
    """The automaton of all substrings of a list of symbols, as the edges of its states; state 0 is the start."""

    def __init__(self, text: list[int], width: int):
        edges = _suffix_edges(text)
        self.size, self.states, self.width = len(text), len(edges), width
        self.owner = np.repeat(np.arange(len(edges), dtype=np.int32), [len(e) for e in edges])
        self.symbol = np.fromiter((c for e in edges for c in e), np.uint16, len(self.owner))
        self.target = np.fromiter((t for e in edges for t in e.values()), np.int32, len(self.owner))

    def parser(self, at: int = 0) -> np.ndarray:
        """A table by place of a state plus symbol: the next state's place, with ``STARTS`` if the symbol starts a phrase.

        Where a match ends, the symbol starts the next one; where none starts with it, it is
        a phrase alone. State 0 has the place ``at``, and each further one is a width apart.
        """
        place = lambda state: state * np.int32(self.width) + np.int32(at)
        root = np.zeros(self.width, np.int32)
        first = self.owner == 0
        root[self.symbol[first]] = self.target[first]
        table = np.tile(place(root) | STARTS, (self.states, 1))
        table[self.owner[~first], self.symbol[~first]] = place(self.target[~first])
        return table.ravel()


def _suffix_edges(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton, built symbol by symbol."""
    go: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in text:
        new = len(length)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


@dataclass
class Model:
    """Languages, the automata of their labelled text, and the symbol of each byte; the last symbol is in no text."""

    langs: list[str]
    automata: list[Automaton]
    coding: np.ndarray


@lru_cache(1)
def _are_letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def words_of(text: str) -> np.ndarray:
    """UTF-8 of the text's letters in lower case, with one blank between words and none around them."""
    found = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(found):
        return np.zeros(0, np.uint8)
    word = _are_letters()[found]
    keep = word.copy()
    keep[:-1] |= word[1:]  # a blank right in front of a letter
    found = np.where(word, found, 32)[keep].astype("<u4").tobytes().decode("utf-32-le")
    return np.frombuffer(found.removeprefix(" ").encode(), np.uint8)


class Parsers:
    """The tables of several automata, one behind the other, so that all parse a text at once."""

    def __init__(self, automata: list[Automaton]):
        self.roots, parts, at = [], [], 0
        for automaton in automata:
            self.roots.append(at)
            parts.append(automaton.parser(at))
            at += len(parts[-1])
        self.table = np.concatenate(parts)

    def phrases(self, coded: list[np.ndarray], segment: int = SEGMENT) -> np.ndarray:
        """The number of phrases of each text (rows) by each automaton (columns)."""
        sizes = np.array([len(x) for x in coded] * len(self.roots), np.int64)
        pieces = -(-sizes // segment)
        begins = np.cumsum(pieces) - pieces
        root = np.repeat(np.repeat(np.array(self.roots, np.int32), len(coded)), pieces)
        nth = np.arange(len(root)) - np.repeat(begins, pieces)
        low = np.arange(len(root)) * segment
        last = np.repeat(begins * segment + sizes, pieces)
        lanes = len(root) // len(self.roots)
        inside = np.arange(lanes * segment) < np.repeat(last[:lanes], segment)
        flat = np.zeros(lanes * segment, np.int32)
        flat[inside] = np.concatenate(coded)
        starts = self._starts(np.tile(flat, len(self.roots)), np.tile(inside, len(self.roots)), root, nth, low, last, segment)
        held = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(starts, out=held[1:])
        counts = held[begins * segment + sizes] - held[begins * segment]
        return counts.reshape(len(self.roots), len(coded)).T

    def _starts(self, flat: np.ndarray, inside: np.ndarray, root: np.ndarray, nth: np.ndarray, low: np.ndarray, last: np.ndarray, segment: int) -> np.ndarray:
        """Where phrases start: texts lie in whole numbers of segments, of which ``nth`` counts a text's."""
        table, high = self.table, np.minimum(low + segment, last)
        marks = np.zeros((segment, len(low)), np.bool_)
        state = root.copy()
        for t, symbol in enumerate(np.ascontiguousarray(flat.reshape(-1, segment).T)):
            state = table.take(state + symbol)
            np.less(state, 0, out=marks[t])
            state &= ~STARTS
        starts = np.ascontiguousarray(marks.T).ravel() & inside

        after = high.copy()  # where the first phrase behind a segment starts
        live = np.flatnonzero(high < last)
        state, pos = state[live], high[live]
        while len(live):  # phrases that reach beyond their segment
            more = table.take(state + flat[pos])
            ended = more < 0
            after[live[ended]] = pos[ended]
            live, state, pos = live[~ended], more[~ended], pos[~ended] + 1
            done = pos == last[live]
            if done.any():
                after[live[done]] = pos[done]
                live, state, pos = live[~done], state[~done], pos[~done]

        begin = low.copy()
        while True:  # segments that a phrase reaches into
            want = np.where(nth > 0, np.concatenate([low[:1], after[:-1]]), low)
            live = np.flatnonzero(want != begin)
            if not len(live):
                return starts
            for i in live[want[live] > begin[live]]:
                starts[begin[i] : min(want[i], high[i])] = False
            begin[live] = pos = want[live]
            state = root[live]
            while len(live):
                done = pos == last[live]
                if done.any():
                    after[live[done]] = pos[done]
                    live, state, pos = live[~done], state[~done], pos[~done]
                more = table.take(state + flat[pos])
                fresh, within = more < 0, pos < high[live]
                met = fresh & within & starts[pos]
                beyond = fresh & ~within
                after[live[beyond]] = pos[beyond]
                starts[pos[within]] = fresh[within]
                on = ~(met | beyond)
                live, state, pos = live[on], (more & ~STARTS)[on], pos[on] + 1


def fit(
    df: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    where: Column | None = None,
    order: Column | None = None,
    docs_per_lang: int = DOCS_PER_LANG,
    max_chars: int = MAX_CHARS,
) -> Model:
    """Learns from the labelled rows for which ``where`` holds; ``order`` is the hash that picks the sample."""
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    order = F.xxhash64(text) if order is None else order
    known = df if where is None else df.where(where)
    known = known.select(text.alias("text"), lang.alias("lang"), order.alias("h"), F.length(text).alias("n")).where(lang.isNotNull() & text.isNotNull())
    short = F.col("n") <= max_chars
    counts = {row["lang"]: row for row in known.groupBy("lang").agg(F.count_if(short).alias("short"), F.min("n").alias("least")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    if not counts:
        return learned({})
    share, longest, most = F.lit(0.0), F.lit(max_chars), F.lit(docs_per_lang)
    for name, row in counts.items():  # rows that hold the smallest hashes, with room to spare
        mine = F.col("lang") == name
        share = F.when(mine, F.lit(min(1.0, (3 * docs_per_lang + 50) / row["short"]) if row["short"] else 1.0)).otherwise(share)
        if not row["short"]:
            longest, most = F.when(mine, F.lit(row["least"])).otherwise(longest), F.when(mine, F.lit(1)).otherwise(most)
    part = F.pmod(F.col("h"), F.lit(1_000_000))
    few = known.where((part / 1_000_000 <= share) & (F.col("n") <= longest)).select("lang", part.alias("p"), "h", "text")
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("p", "h", "text"))).where(F.col("rank") <= most)
    texts: dict[str, str] = {}
    for row in sorted(few.select("lang", "rank", "text").collect()):
        texts[row["lang"]] = f"{texts.get(row['lang'], '')} {row['text']}"
    return learned(texts)


def learned(texts: dict[str, str]) -> Model:
    """The model of a labelled text for each language; languages without a letter are left out."""
    told = {name: words for name in sorted(texts) if len(words := words_of(texts[name]))}
    used = sorted(set().union(*map(np.unique, told.values())))
    coding = np.full(256, len(used), np.uint16)
    coding[used] = np.arange(len(used))
    return Model(list(told), [Automaton(coding[words].tolist(), len(used) + 1) for words in told.values()], coding)


def _predict(shared: Broadcast, text_at: int, made: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        groups = [Parsers(model.automata[i : i + TOGETHER]) for i in range(0, len(model.automata), TOGETHER)]
        bits = np.array([math.log2(automaton.size + 1) for automaton in model.automata])
        for batch in batches:
            for part in slices(batch, text_at, PART_BYTES):
                coded = [model.coding[words_of(text or "")] for text in part.column(text_at).to_pylist()]
                sizes = np.array([len(x) for x in coded], np.int64)
                counts = [group.phrases(coded) for group in groups]
                cost = np.concatenate(counts, axis=1) * bits / np.maximum(sizes, 1)[:, None] if groups else np.zeros((len(sizes), 0))
                names, scores = [], []
                for n, row in zip(sizes, cost, strict=True):
                    if not n or not len(row):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(row))
                    names.append(model.langs[best])
                    scores.append(1.0 if len(row) == 1 else float(1 - row[best] / np.partition(row, 1)[1]))
                found = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*part.schema.names, *made])

    return run


def predict(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred`` and ``score``, the relative margin to the second language (0 to 1)."""
    rows = columns(df, id=id_col, text=text_col)
    return annotate(rows, model).drop("text")


def annotate(df: DataFrame, model: Model, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the prediction and its score, in one pass; columns of these names give way."""
    small_batches(df.sparkSession)
    rows = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in (pred_col, score_col)))
    schema = T.StructType([*rows.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared, rows.columns.index(text_col), (pred_col, score_col)), schema)
