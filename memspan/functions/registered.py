"""Functions for SQL: scalar ones that Catalyst inlines, and table functions of model replies."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Scalar functions are SQL expressions, so a plan that uses them has no Python node.
SCALARS = {
    "cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": """aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)
        / sqrt(aggregate(a, CAST(0 AS DOUBLE), (s, x) -> s + x * x) * aggregate(b, CAST(0 AS DOUBLE), (s, x) -> s + x * x))""",
    "jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE CAST(0 AS DOUBLE) END",
    "recency_boost(base DOUBLE, age_days DOUBLE, retrievals BIGINT) RETURNS DOUBLE": "base * exp(-age_days / 30) * (1 + CAST(0.1 AS DOUBLE) * least(greatest(retrievals, 0), 20))",
    "strengthened(strength DOUBLE) RETURNS DOUBLE": "least(strength * CAST(1.15 AS DOUBLE), CAST(1 AS DOUBLE))",
    "token_estimate(line STRING) RETURNS BIGINT": "octet_length(line) DIV 4",
}


@udtf(returnType="fact string, confidence double")
class ReplyFacts:
    """Facts of a language model's reply, a row each; 0.5 where a confidence is no number, nothing of a null reply."""

    def eval(self, reply: str) -> Iterator[tuple[str, float]]:
        for told, fact in regex.findall(r'(?s)<fact confidence="([^"]*)">(.*?)</fact>', reply or ""):
            try:
                confidence = float(told)
            except ValueError:
                confidence = 0.5
            if fact.strip():
                yield fact.strip(), confidence


@udtf(returnType="name string, trigger_condition string, pos int, step string")
class ReplySteps:
    """Steps of the procedures of a reply, a row each, numbered from 0."""

    def eval(self, reply: str) -> Iterator[tuple[str, str, int, str]]:
        for head, body in regex.findall(r"(?s)<procedure(\s[^>]*)>(.*?)</procedure>", reply or ""):
            told = dict(regex.findall(r'(\w+)="([^"]*)"', head))
            steps = [s.strip() for s in regex.findall(r"(?s)<step>(.*?)</step>", body) if s.strip()]
            for pos, step in enumerate(steps):
                yield told.get("name", ""), told.get("trigger", ""), pos, step


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL: ``cosine_sim``, ``jaccard``, ``recency_boost``, ``strengthened``, ``token_estimate``, ``reply_facts``, ``reply_steps``."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("reply_facts", ReplyFacts)
    spark.udtf.register("reply_steps", ReplySteps)
