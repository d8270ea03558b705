"""Boundary cases of functions and operators."""

import math

import pytest
from pyspark.sql import functions as F

from memspan.functions import hooks, scores, text, times
from memspan.operators import context, lifecycle, retrieval
from memspan.operators.graph import knn_pairs, shared_tokens
from memspan.operators.maintain import clusters
from memspan.operators.metrics import per_query
from memspan.sources import parsers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(("age", "n", "expected"), [(30.0, 0, math.exp(-1)), (0.0, 100, 3.0), (0.0, 0, 1.0)])
def test_recency_access(spark, age, n, expected):
    assert one(spark, scores.recency_access(F.lit(1.0), F.lit(age), F.lit(n))) == pytest.approx(expected)


def test_unknown_time_has_age_zero(spark):
    assert one(spark, scores.age_days(F.lit(10), F.lit(None).cast("long"))) == 0.0


@pytest.mark.parametrize(("days", "expected"), [(30.0, 1.0), (31.0, 0.9), (60.0, 0.81), (3000.0, 0.1)])
def test_decay(spark, days, expected):
    assert one(spark, scores.decayed(F.lit(1.0), F.lit(days), 30)) == pytest.approx(expected)


def test_jaccard(spark):
    array = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, scores.jaccard(array("a", "b", "c"), array("b", "c", "d"))) == 0.5
    assert one(spark, scores.jaccard(array("a"), array("b"))) == 0.0
    assert one(spark, scores.jaccard(array(), array())) == 0.0


@pytest.mark.parametrize(
    ("command", "expected"),
    [
        ("git commit --dry-run", False),
        ("git commit -n -m x", False),
        ("git commit -m x", True),
        ("git commit -am x", True),
        ("git commit", True),
        ("git status", False),
        ("git log", False),
        ("cd a && git commit -m x", True),
        ("ls; git commit -m x", True),
        ("", False),
        ("echo git", False),
    ],
)
def test_commit_command(spark, command, expected):
    assert one(spark, hooks.is_commit_command(F.lit(command))) is expected


@pytest.mark.parametrize(
    ("output", "expected"),
    [
        ("[main abc1234] fix it", ("main", "abc1234", "fix it")),
        ("[main (root-commit) abc1234] first", ("main", "abc1234", "first")),
        ("before\n[feature/x-1 abcdef1234] two words", ("feature/x-1", "abcdef1234", "two words")),
        ("nothing to commit", (None, None, None)),
        ("[main xyz] no", (None, None, None)),
    ],
)
def test_commit_output(spark, output, expected):
    parts = hooks.commit_parts(F.lit(output))
    assert tuple(spark.range(1).select(*(p.alias(f"p{i}") for i, p in enumerate(parts))).head()) == expected


def test_symbols_and_errors(spark):
    assert one(spark, text.symbols(F.lit("fn run_all() def the class Thing"))) == ["run_all", "Thing"]
    assert one(spark, text.error_codes(F.lit("E0308 then 502 and 200"))) == ["E0308", "502"]


def test_listwise_order_must_be_a_permutation(spark):
    order = lambda *x: text.permutation_scores(F.array(*map(F.lit, x)), F.lit(3))
    assert [tuple(s) for s in one(spark, order(2, 0, 1))] == [(2, 1.0), (0, pytest.approx(2 / 3)), (1, pytest.approx(1 / 3))]
    for bad in ((0, 0, 1), (0, 1, 3), (0, 1)):
        assert one(spark, order(*bad)) is None
    assert one(spark, text.json_slice(F.lit('so {"order":[1]} ok'))) == '{"order":[1]}'
    assert one(spark, text.json_slice(F.lit("none"))) is None


def test_rules_compress_both_spellings(spark):
    rows = spark.createDataFrame([('{"toolName":"Edit","toolInput":{"filePath":"/home/me/app/core/x.rs"}}', "post_tool_use")], "data string, hook string")
    row = hooks.observed(rows).head()
    assert (row.title, row.obs_type, row.importance) == ("Edit: x.rs", "file_edit", 6)
    assert row.keywords == ["app", "core", "rs", "edit"]


@pytest.mark.parametrize(("gap", "kept"), [(0, 1), (299_999_000, 1), (300_000_000, 2), (301_000_000, 2)])
def test_dedup_window(spark, gap, kept):
    rows = spark.createDataFrame([("a", 0, 1), ("a", gap, 2)], "key string, t long, id long")
    assert lifecycle.ttl_dedup(rows, "key", "t", "id").count() == kept


def test_duplicates_do_not_extend_the_window(spark):
    rows = spark.createDataFrame([("a", t * 100_000_000, t) for t in range(7)], "key string, t long, id long")
    assert sorted(r.id for r in lifecycle.ttl_dedup(rows, "key", "t", "id").collect()) == [0, 3, 6]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id long, score double")
    b = spark.createDataFrame([(2, 9.0), (1, 8.0)], "id long, score double")
    fused = {r.id: r.score for r in retrieval.fuse([a, b], 10, 5).collect()}
    assert fused[1] == pytest.approx(1 / 11 + 1 / 12, abs=1e-9)


def test_results_without_a_session_are_exempt(spark):
    rows = spark.createDataFrame([(i, None, 1.0) for i in range(5)] + [(10 + i, 1, 1.0) for i in range(5)], "id long, session_id long, score double")
    assert retrieval.diversify(rows).count() == 8


def test_frequent_tokens_can_be_left_out(spark):
    rows = spark.createDataFrame([(i, ["all", f"p{i // 2}"]) for i in range(6)], "id long, k array<string>")
    assert sorted(map(tuple, shared_tokens(rows, "k", 0.0, most_df=3).select("src", "dst").collect())) == [(0, 1), (2, 3), (4, 5)]


def test_greedy_clusters(spark):
    rows = [(i, 100 - i, ["x", "y", f"u{i}"] if i < 4 else [f"a{i}", f"b{i}"]) for i in range(9)]
    found = clusters(spark.createDataFrame(rows, "id long, created_s long, keywords array<string>")).collect()
    assert sorted((r.cluster, r.id) for r in found) == [(0, 0), (0, 1), (0, 2), (0, 3)]


def test_core_edit_refuses_other_ops(spark):
    core = spark.createDataFrame([("p", ["a"])], "project string, goals array<string>")
    with pytest.raises(ValueError, match="unsupported"):
        lifecycle.edit_core(core, "p", "goals", "set", "b")
    with pytest.raises(ValueError, match="unsupported"):
        lifecycle.edit_core(core, "p", "plans", "add", "b")


def test_metrics(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, id long, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 99)], "query_id long, id long")
    rows = {r.query_id: r for r in per_query(results, gold, 5).collect()}
    assert rows[1].mrr == 0.5
    assert rows[1].ndcg == pytest.approx(1 / math.log2(3))
    assert (rows[2].recall_any, rows[2].ndcg, rows[2].mrr) == (0.0, 0.0, 0.0)


def test_parsers(spark, tmp_path):
    lines = spark.createDataFrame([("c", "1\t2\ta.rs"), ("c", "-\t-\tb.png"), ("c", "junk")], "sha string, line string")
    row = parsers.numstat(lines, "sha", "line").head()
    assert (sorted(row.files), row.insertions, row.deletions) == (["a.rs", "b.png"], 1, 2)
    diff = spark.createDataFrame([("c", "diff --git a b\n--- a\n+++ b\n@@ 1 @@\n+x\n-y\n z\ndiff --git c d")], "sha string, t string")
    assert [(r.kind, r.file_no) for r in parsers.diff_lines(diff, "sha", "t").orderBy("pos").collect()] == [("file", 1), ("meta", 1), ("meta", 1), ("hunk", 1), ("add", 1), ("del", 1), ("ctx", 1), ("file", 2)]
    env = tmp_path / "env"
    env.write_text("# no\nA='1'\nB=two\n")
    assert {k: v for k, v in parsers.settings(str(env), {"A": "0", "C": "3"}).items()} == {"A": "1", "B": "two", "C": "3"}


def test_benchmark_source_and_export(spark, tmp_path):
    import json

    rows = [
        {"question_id": "1", "question_type": "t", "question": "q", "answer_session_ids": ["s2"], "haystack_session_ids": ["s1", "s2"], "haystack_sessions": [[{"role": "user", "content": "a"}], [{"role": "user", "content": "b"}, {"role": "assistant", "content": "c"}]]},
        {"question_id": "2", "question_type": "t_abs", "question": "q", "answer_session_ids": [], "haystack_session_ids": [], "haystack_sessions": []},
    ]
    (tmp_path / "b.json").write_text(json.dumps(rows))
    found = parsers.read_benchmark(spark, str(tmp_path / "b.json")).orderBy("session_id").collect()
    assert [(r.question_id, r.session_id, r.content) for r in found] == [("1", "s1", "user: a"), ("1", "s2", "user: b\nassistant: c")]
    parsers.export({"t": spark.range(3)}, str(tmp_path / "out"), "1", "now")
    assert spark.read.json(str(tmp_path / "out/t")).count() == 3


def test_hook_spellings(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"hookType":"stop","sessionId":"a","cwd":"/x","data":{"k":1}}\n{"hook_type":"stop","session_id":"b","project":"p"}\n')
    rows = {r.session_id: r for r in parsers.read_hooks(spark, str(tmp_path / "e.json")).collect()}
    assert (rows["a"].project, rows["a"].data, rows["b"].data) == ("/x", '{"k":1}', "{}")


def test_blocks_do_not_change_nearest_neighbours(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    one_block, many = ({(r.id, r.nbr) for r in knn_pairs(vectors, 3, "label", block=b).collect()} for b in (1024, 5))
    assert one_block == many and len(one_block) >= 3 * 0.9 * vectors.count()


@pytest.mark.parametrize(("told", "age"), [("2024-05-31T00:00:00Z", 1.0), ("2024-05-31t02:00:00.25+02:00", 1.0), ("2024-05-31", 0.0), ("yesterday", 0.0), (None, 0.0), ("2031-01-01T00:00:00Z", 0.0), ("2024-13-01T00:00:00Z", 0.0)])
def test_age_of_texts(spark, told, age):
    assert one(spark, times.age_of(F.lit(told).cast("string"), F.lit(1_717_200_000))) == pytest.approx(age, abs=1e-4)


def test_first_bytes(spark):
    for value, size, want in (("abc", 2, "ab"), ("aé🙂z", 3, "aé"), ("aé🙂z", 2, "a"), ("aé🙂z", 7, "aé🙂"), ("aé🙂z", 8, "aé🙂z"), ("", 5, "")):
        assert one(spark, text.first_bytes(F.lit(value), size)) == want


def test_prompt_titles_and_unknown_tools(spark):
    rows = spark.createDataFrame([("prompt_submit", '{"prompt":"' + "x" * 70 + '"}'), ("prompt_submit", "{}"), ("post_tool_use", '{"toolName":"Read"}'), ("post_tool_use", "{}")], "hook string, data string")
    assert [(r.tool, r.title) for r in hooks.observed(rows).collect()] == [("unknown", "Prompt: " + "x" * 60 + "…"), ("unknown", "Prompt"), ("Read", "Read call"), ("unknown", "unknown call")]


def test_plans_are_captured(spark):
    body = "intro\n# Title \nsee src/a.rs, b.md and src/a.rs\n## One: Two!\n## ab\n" + "".join(f"f{i}.py " for i in range(30))
    assert one(spark, text.plan_title(F.lit(body), F.lit("x"))) == "Title"
    assert one(spark, text.plan_files(F.lit(body))) == ["src/a.rs", "b.md", *(f"f{i}.py" for i in range(17))]
    assert one(spark, text.plan_keywords(F.lit(body))) == ["src/a.rs", "b.md", *(f"f{i}.py" for i in range(7)), "one-two"]
    assert len(one(spark, text.plan_content(F.lit("x" * 9000)))) == 8000 + len("\n\n[...truncated]")


def test_context_is_rendered_with_heads(spark):
    lines = spark.createDataFrame([(0, 1, "# Core\n"), (1, 2, "- b\n"), (1, 1, "- a\n"), (5, 1, "- r\n")], "section int, pos int, line string")
    assert context.rendered(lines).head().context == "# Core\n\n# Saved memories\n\n- a\n- b\n\n# Recent task outcomes\n\n- r\n"


def test_results_are_written(spark, tmp_path):
    parsers.write_results(spark.createDataFrame([("recall", 0.5)], "metric string, value double"), str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "r")).select("metric", "value").collect()] == [("recall", 0.5)]
