"""What pairs of sets cost: likeness is found and rounded for two sets, not for each pair, and cells keep their tasks."""

import re

import pytest

from memspan.operators import graph
from memspan.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["keyword_jaccard_edges", "entity_edges", "entity_links", "reflect_pairs"])
def test_pairs_are_not_rounded_one_by_one(spark, sf, name):
    plan = plan_of(catalogue.queries()[name](spark, sf))
    assert "round(" in plan and plan.index("Generate") < plan.index("round(")


def test_entity_links_intersect_sets_once(spark, sf):
    lines = plan_of(catalogue.queries()["entity_links"](spark, sf)).splitlines()
    found = [x.count("array_intersect(") for x in lines if "array_intersect(" in x]
    assert found == [1, 1]  # new rows with stored ones, and new ones with each other


@pytest.mark.parametrize("scope", [None, "s"])
def test_keyword_jaccard_edges_keep_their_tasks(spark, scope):
    items = spark.createDataFrame([(i, "s", [f"a{i % 3}", f"b{i % 5}"]) for i in range(30)], "id long, s string, k array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(graph.shared_tokens(items, "k", 0.4, scope))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt_again = r"ENSURE_REQUIREMENTS[^\n]*\n[^\n]*REPARTITION_BY_NUM"
    assert "REPARTITION_BY_NUM" in plan and not re.search(dealt_again, plan)
