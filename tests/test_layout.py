import ast
import pathlib

from memspan.operators import graph
from memspan.plans import graphs
from memspan.plans.lens import Lens

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_the_core_does_not_import_the_corpus_operators():
    for path in (ROOT / "memspan").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    assert "llm" not in [part for name in (getattr(node, "module", None) or "", *(x.name for x in node.names)) for part in name.split(".")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_on_sets_and_vectors_pair_nothing_needlessly(spark, sf):
    t = Lens(spark, sf)
    items = graphs.tagged(t)
    for made in (graph.shared_tokens(items, "keywords", 0.4), graph.tokens_shared_with(items.where("id = 3"), items, "keywords", "project"), graph.knn_pairs(t.embeddings, 5, "label")):
        text = plan(made)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_reach_the_scan(spark, sf):
    text = plan(Lens(spark, sf).orders.where("o_orderkey = 7").select("o_custkey"))
    assert "EqualTo(o_orderkey,7)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
