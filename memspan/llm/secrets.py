"""Secret scans: patterns, and strings that a primed compressor finds novel.

Base kinds are patterns. Beyond them, a candidate is a long mixed string that follows a
sensitive word closely. Its marginal cost is what zstandard needs for it when primed with
a dictionary of the surrounding text and of common identifiers; names and paths cost
little, random strings nearly all their bytes. Other occurrences of the candidate do not
prime, so a secret that stands twice is found twice. Candidates that cost nearly what a
random string of their alphabet and length costs are reported as ``novel``.

The context of a candidate holds for those that follow it with nothing but separators
between (parts of a token, lines of a key), and for all of a private key's block.

Twenty letters are too few for a compressor to tell words from noise, so names, paths and
camel case are told by their parts: a candidate is made of words if most of it is runs of
three letters or more of one case whose pairs of letters are likelier in words (of the
text itself, of the identifiers and of common English) than in random strings. Random
strings of letters of one case are not, and are reported by their cost like others.

Defined cases: a null or empty text has no spans. Repeated rows give repeated results; an
empty table gives none. Texts are scanned whole; offsets are code points.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspan.llm.common import columns, slices, small_batches

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_SENSITIVE = re.compile(r"passw|passphrase|secret|token|api.?key|private|credential|auth|bearer|signature|access.?key|session", re.IGNORECASE | re.ASCII)
#: Code points before a candidate that count as its context, and those on each side that prime the compressor.
CONTEXT, SURROUNDING = 48, 512
#: Share of a random string's cost that a candidate must cost to be reported.
NOVELTY = 0.8
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: How much likelier than by chance a pair of letters of words is meant to be (a mean logarithm), and the share of a candidate that its words are to have.
LIKELY, WORDED = 0.1, 0.5
#: Letters that a pair is taken to have followed before any was seen.
PRIOR = 13
#: Alphabets of keys, smallest first; others are of base64.
ALPHABETS = (_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _LOWER.upper(), _LOWER + "234567", _LOWER.upper() + "234567", _DIGITS + _LOWER, _DIGITS + _LOWER.upper(), _DIGITS + _LOWER + _LOWER.upper() + "+/")
#: What may stand between a candidate and one that shares its context, and a private key's block.
_BETWEEN = re.compile(r"(?:[\s.,:;\"'\\]|\\[nr]){1,8}")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END|\Z)", re.DOTALL)
_TAIL = re.compile(r"(?:\s|\\[nr])([A-Za-z0-9+/]{1,19}={0,2})(?:\s|\\[nr])*\Z")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,15}(?![A-Za-z0-9+/_=-])")
#: Common English words, which tell what pairs of letters words have.
ENGLISH = (
    "the of and to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their "
    "if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its "
    "now find long down day did get come made may part over new sound take only little work know place year live me back give most very after thing our just name good sentence man think say great "
    "where help through much before line right too mean old any same tell boy follow came want show also around form three small set put end does another well large must big even such because turn "
    "user account primary email address resource backup path server client request response service manager handler update delete create select message content title value key index store table"
)
#: Identifiers that prime the compressor besides the surrounding text.
IDENTIFIERS = (
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 return function class import export const static public private "
    b"string integer boolean true false null none self this config configuration environment variable default example placeholder "
    b"username password_reset session_identifier access_token_url authorization_endpoint client_secret_expires private_key_path "
    b"credentials_provider https://www.example.com/api/v1/users application/json content-type user-agent 00000000000000000000 "
)
_HEX_BYTES = bytes(49 if b in b"0123456789abcdef" else 48 for b in range(256))
_CANDIDATE_BYTES = bytes(49 if re.match(rb"[A-Za-z0-9+/_=-]", bytes([b])) else 48 for b in range(256))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the patterns, leftmost and non-overlapping within a kind, that are long enough."""
    spans = []
    low = text.lower()
    if any(word in low for word in _WORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"1" * 24 in text.encode().translate(_HEX_BYTES):
        spans += [("hex", *m.span()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def marginal_bytes(candidate: str, surrounding: str) -> int:
    """Compressed bytes that the candidate adds to what its surroundings and the identifiers tell."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + surrounding.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    cost = lambda data: len(zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False).compress(data))
    return cost(candidate.encode()) - cost(b"")


def surroundings(text: str, start: int, end: int) -> str:
    """Text on both sides of a candidate, in which blanks stand for its other occurrences and those of its values."""
    candidate = text[start:end]
    reach = SURROUNDING + len(candidate)  # an occurrence that the reach cuts ends outside of what is given
    before, after = text[max(0, start - reach) : start], text[end : end + reach]
    for part in sorted({candidate, *(x for x in candidate.split("=") if len(x) >= 8)}, key=len, reverse=True):
        before, after = before.replace(part, " " * len(part)), after.replace(part, " " * len(part))
    return before[-SURROUNDING:] + after[:SURROUNDING]


@lru_cache(4096)
def random_bytes(alphabet: str, length: int) -> int:
    """Compressed bytes of a random string of an alphabet."""
    return marginal_bytes("".join(Random(length).choices(alphabet, k=length)), "")


def novelty_of(candidate: str, surrounding: str) -> float:
    """The candidate's cost as a share of what a random string of its alphabet and length costs."""
    used = set(max(candidate.split("="), key=len))
    alphabet = next((x for x in ALPHABETS if used <= set(x)), ALPHABETS[-1])
    return marginal_bytes(candidate, surrounding) / random_bytes(alphabet, len(candidate))


class Words:
    """Pairs of letters of words: how often each was seen, in common words and in a text."""

    def __init__(self, text: str):
        self.pairs: Counter[str] = Counter()
        told = [*_WORD.findall(IDENTIFIERS.decode().replace("_", " ")), *ENGLISH.split(), *_WORD.findall(text)]
        for word, n in Counter(w.lower() for w in told).items():
            for i in range(len(word) - 1):
                self.pairs[word[i : i + 2]] += min(n, 50)  # a word that a text repeats does not stand for all
        self.firsts: Counter[str] = Counter()
        for pair, n in self.pairs.items():
            self.firsts[pair[0]] += n

    def likelihood(self, parts: list[str]) -> float:
        """The mean logarithm of how much likelier than by chance each letter follows the one before."""
        told = [math.log(26 * (self.pairs[p[i : i + 2]] + PRIOR / 26) / (self.firsts[p[i]] + PRIOR)) for p in parts for i in range(len(p) - 1)]
        return sum(told) / len(told) if told else -1.0

    def make(self, candidate: str) -> bool:
        """Whether a candidate, or the longest of its parts between equals signs, is made of words."""
        candidate = max(candidate.split("="), key=len)
        parts = [p.lower() for p in _PART.findall(candidate)]
        long = [p for p in parts if len(p) >= 3]
        size = sum(map(len, long))
        return size >= WORDED * len(candidate) and size >= 0.6 * sum(map(len, parts)) and self.likelihood(long) > LIKELY


def novel_spans(text: str, known: list[tuple[str, int, int]], novelty: float = NOVELTY) -> list[tuple[str, int, int]]:
    """Incompressible strings in a sensitive context that no known span touches."""
    if b"1" * 20 not in text.encode().translate(_CANDIDATE_BYTES):
        return []
    blocks = [m.span(1) for m in _KEY_BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    spans, last, words = [], None, None
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        touched = [kind for kind, s, e in known if s < end and start < e]
        follows = last is not None and start - last <= 8 and _BETWEEN.fullmatch(text, last, start)
        if touched:
            last = end if follows or "assign" in touched or "access" in touched else None
            continue
        if not (follows or any(s <= start < e for s, e in blocks) or _SENSITIVE.search(text[max(0, start - CONTEXT) : start])):
            continue
        last = end
        words = words or Words(text)
        if not words.make(m[0]) and novelty_of(m[0], surroundings(text, start, end)) >= novelty:
            spans.append(("novel", start, end))
    for low, high in blocks:
        tail = _TAIL.search(text, low, high)
        if tail and any(low <= s < high for _, s, _ in spans) and not any(s < tail.end(1) and tail.start(1) < e for _, s, e in known):
            spans.append(("novel", *tail.span(1)))
    return sorted(spans, key=lambda s: s[1])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part in slices(batch, 1, 1 << 20):
            rows = []
            for text in part.column(1).to_pylist():
                base = base_spans(text) if text else []
                spans = sorted(base + novel_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0]))) if text else []
                rows.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["id", "spans"])


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``spans``, an array of (kind, start, end) by start, then kind."""
    small_batches(df.sparkSession)
    rows = columns(df, id=id_col, text=text_col)
    return rows.mapInArrow(_scan, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, *, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The same columns with every span of the text replaced by ``mark``; spans that overlap give one mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text) if text else []
                out, last = [], 0
                for _, start, end in sorted(base + novel_spans(text, base), key=lambda s: s[1]) if text else []:
                    if start >= last:
                        out += [text[last:start], mark]
                    last = max(last, end)
                texts.append(text if not last else "".join([*out, text[last:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 :]], schema=batch.schema)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
