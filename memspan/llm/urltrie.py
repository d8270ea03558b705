"""URL filters: a trie over reversed host labels and path segments.

Rules are ``(verdict, "host/path")``. A rule fits its host and all subdomains, if the
url's path starts with the rule's path. Of the rules that fit, the longest text wins;
between texts of one length block wins, and then the text that sorts last. The trie is
broadcast while its rules stay under a stated size; a larger rule table is joined on host
suffix and path segments instead, with the same order of rules.

Defined cases: a null url, or one without ``://``, has an empty host and path, which no
rule fits, so it gets the default verdict. Repeated rows give repeated results; an empty
table gives none; urls of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspan.llm.common import UPPER, columns, small_batches

#: Bytes of rule texts up to which the trie is broadcast.
BROADCAST_BYTES = 4 << 20

Rules = Sequence[tuple[str, str]]
_LOWER = str.maketrans(UPPER, UPPER.lower())


class Node:
    """Rules that end below one folder of a path, by the start of the next segment, and further folders."""

    __slots__ = ("folders", "lengths", "rests")

    def __init__(self) -> None:
        self.folders: dict[str, Node] = {}
        self.rests: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []

    def find(self, segment: str) -> tuple[str, str] | None:
        """The rule with the longest start of the segment: a look-up for each length that occurs here."""
        for n in self.lengths:
            if n <= len(segment) and (found := self.rests.get(segment[:n])):
                return found
        return None


class Trie:
    """Host labels from the right, then path segments from the left, then prefixes of the next segment."""

    def __init__(self, rules: Rules):
        self.hosts: dict = {}
        for verdict, text in rules:
            host, slash, path = text.partition("/")
            if verdict not in ("allow", "block") or not slash or not host:
                raise ValueError(f"not a rule: {verdict} {text}")
            labels = self.hosts
            for label in reversed(host.translate(_LOWER).split(".")):
                labels = labels.setdefault(label, {})
            node = labels.setdefault("/", Node())  # a label has no slash
            *segments, rest = path.split("/")
            for segment in segments:
                node = node.folders.setdefault(segment, Node())
            old = node.rests.get(rest)
            node.rests[rest] = max((verdict, text), old or (verdict, text), key=precedence)
            if old is None:
                node.lengths = sorted({*node.lengths, len(rest)}, reverse=True)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that fits and goes first, as (verdict, text)."""
        best = None
        if not host or not path.startswith("/"):
            return None
        segments = path[1:].split("/")
        labels = self.hosts
        for label in reversed(host.split(".")):
            labels = labels.get(label)
            if labels is None:
                break
            node = labels.get("/")
            for segment in segments:
                if node is None:
                    break
                found = node.find(segment)
                if found and (best is None or precedence(found) > precedence(best)):
                    best = found
                node = node.folders.get(segment)
        return best


def precedence(rule: tuple[str, str]) -> tuple[int, bool, str]:
    """What of a rule decides between several that fit; the greatest wins."""
    verdict, text = rule
    return len(text), verdict == "block", text


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: The trie of the last rules that this Python process was sent: its tasks share it.
_built: dict[tuple, Trie] = {}


def _walk(shared: Broadcast, default: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        if rules not in _built:
            _built.clear()
            _built[rules] = Trie(rules)
        trie = _built[rules]
        for batch in batches:
            found = [trie.find(host, path) for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            out = [*batch.columns, pa.array([x and x[1] for x in found], pa.string()), pa.array([x[0] if x else default for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "host", "path", "rule", "verdict"])

    return run


def judge(df: DataFrame, rules: Rules, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id, host, path, rule, verdict`` of each url; ``rule`` is null and the verdict ``default`` where none fits."""
    Trie(rules)  # refuses what is not a rule
    rows = columns(df, id=id_col, url=url_col).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if sum(len(text.encode()) for _, text in rules) > broadcast_bytes:
        table = df.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
        return judge_by_join(rows, table, default)
    small_batches(df.sparkSession, 4096)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    shared = df.sparkSession.sparkContext.broadcast(tuple((verdict, text) for verdict, text in rules))
    return rows.mapInArrow(_walk(shared, default), schema)


def judge_by_join(rows: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for rule tables of any size: rules meet urls on a host suffix and on whole leading segments."""
    table = rules.select(
        "verdict",
        "rule",
        F.translate(F.substring_index("rule", "/", 1), UPPER, UPPER.lower()).alias("suffix"),
        F.expr("substr(rule, instr(rule, '/'))").alias("start"),
    ).withColumn("folder", F.regexp_extract("start", "(?s)^.*/", 0))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/")))
    distinct = rows.select("host", "path").distinct()
    reach = distinct.where("host <> '' and path like '/%'").select("host", "path", F.explode(suffixes).alias("suffix"), folders.alias("folders"))
    reach = reach.select("host", "path", "suffix", F.explode("folders").alias("folder"))
    fits = reach.join(table, ["suffix", "folder"]).where(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
