"""Packing of tokenised documents into sequences by balanced attention cost.

A document of n tokens costs about ``n + n * n / balance``: linear work plus
quadratic attention. A task packs windows of its documents. Full sequences are cut
from the long ones; what is left is assigned, dearest first, to the cheapest
sequence that has room for it, and is cut only where no sequence has. A window has
just as many sequences as its tokens need, so all its padding is less than one sequence.

No window leaves its task, so there is no shuffle. A lost task is packed again to the same
sequences if its rows come in the same order, as those of a file do; rows that come from
a shuffle are to be written or checkpointed before.

Defined cases: a null or empty text is the end token alone. Repeated rows and ids are
packed as often as they occur, each row whole. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memspan.llm.common import columns, slices, small_batches

LENGTH = 1024
#: Tokens of a window: about a thousand sequences, with less padding than one of them.
WINDOW_TOKENS = 1 << 20
#: Chunks of a generation of a task's table.
TABLE_CHUNKS = 150_000
_SPACE_IN_RUN = re.compile(r" \s")


class ChunkIds(dict):
    """Ids of distinct chunks as bytes; those of the last two generations are held, which bounds memory, not the result."""

    def __init__(self, encode: Callable[[str], list[int]], limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            ids = self.encode(f" {word}")
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = found
        return found


class ByteCoder:
    """Ids of texts as little-endian 32-bit bytes, by a table of distinct chunks.

    The pre-tokeniser never joins a character to a blank behind it. Where no blank is
    followed by white space, a cut in front of every blank thus changes nothing, and each
    distinct chunk is tokenised once. Other texts are tokenised whole.
    """

    def __init__(self, tokenizer: str, ranks: str | None, limit: int = TABLE_CHUNKS):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.plain: Callable[[str], list[int]] = lambda text: self.whole.encode(text, add_special_tokens=False).ids
        if ranks:
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.table = ChunkIds(self.plain, limit)

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _SPACE_IN_RUN.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.plain(first), "<u4").tobytes() + b"".join(map(self.table.__getitem__, rest))


def assign(lengths: list[int], length: int = LENGTH, balance: float = 4096.0) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths."""
    pieces, left, full = [], [], 0
    for i, n in enumerate(lengths):
        whole = n // length
        pieces += [(i, k * length, length, full + k, 0) for k in range(whole)]
        full += whole
        if n % length:
            left.append((n % length, i, whole * length))
    left.sort(key=lambda x: (-x[0], x[1]))
    count = -(-sum(n for n, _, _ in left) // length)
    used, cost = [0] * count, [0.0] * count
    cheapest = [(0.0, s) for s in range(count)]
    for n, i, start in left:
        aside = []
        while n:
            target = None
            while cheapest:
                c, s = heapq.heappop(cheapest)
                if c != cost[s] or used[s] == length:
                    continue
                if used[s] + n <= length:
                    target = s
                    break
                aside.append((c, s))
            take = n
            if target is None:  # none has room for all of it: the roomiest takes what it can
                c, target = min(aside, key=lambda x: (used[x[1]], x))
                aside.remove((c, target))
                take = length - used[target]
            pieces.append((i, start, take, full + target, used[target]))
            used[target] += take
            cost[target] += take + take * take / balance
            start, n = start + take, n - take
            aside.append((cost[target], target))
            for entry in aside:
                heapq.heappush(cheapest, entry)
            aside = []
    return pieces


def _pack(tokenizer: str, ranks: str | None, end_id: int, length: int, window: int, balance: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, end = ByteCoder(tokenizer, ranks), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        ids: list[pa.Scalar] = []
        held: list[bytes] = []
        tokens = 0

        def packed() -> pa.RecordBatch:
            nonlocal sequence, tokens
            pieces = assign([len(x) // 4 for x in held], length, balance)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i].as_py() for i, *_ in pieces], ids[0].type),
                    pa.array([start for _, start, *_ in pieces], pa.int64()),
                    pa.array([n for _, _, n, *_ in pieces], pa.int64()),
                    pa.array([held[i][4 * start : 4 * (start + n)] for i, start, n, *_ in pieces], pa.binary()),
                    pa.array([len(held[i]) // 4 for i, *_ in pieces], pa.int64()),
                    pa.array([sequence + s for *_, s, _ in pieces], pa.int64()),
                    pa.array([offset for *_, offset in pieces], pa.int64()),
                ],
                names=["id", "start", "length", "ids_le", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += 1 + max(s for *_, s, _ in pieces)
            ids.clear()
            held.clear()
            tokens = 0
            return out

        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                for key, text in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    ids.append(key)
                    held.append((coder.encode(text) if text else b"") + end)
                    tokens += len(held[-1]) // 4
                    if tokens >= window:
                        yield packed()
        if held:
            yield packed()

    return run


def pack(
    df: DataFrame,
    tokenizer: str,
    *,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    length: int = LENGTH,
    window_tokens: int = WINDOW_TOKENS,
    balance: float = 4096.0,
) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``length`` tokens.

    ``tokenizer`` is a file of the tokenizers library; ``ranks`` may name the same
    vocabulary as tiktoken ranks, which is faster. ``ids_le`` has a piece's ids as
    little-endian unsigned 32-bit integers. ``balance`` is the number of tokens from which
    attention is dearer than the linear work.
    """
    small_batches(df.sparkSession)
    rows = columns(df, id=id_col, text=text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_le binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_pack(tokenizer, ranks, end_id, length, window_tokens, balance), schema)
