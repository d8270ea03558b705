import pytest

from pyspark.sql import functions as F

from memspan.functions import stem, text
from memspan.operators import textindex
from memspan.plans import searches
from memspan.plans.lens import Lens


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("running", "run"), ("ran", "ran"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"), ("hopping", "hop"), ("hoping", "hope"),
        ("agreed", "agre"), ("feed", "feed"), ("luxuriated", "luxuri"), ("by", "by"), ("say", "say"), ("cry", "cri"), ("relational", "relat"), ("generously", "generous"), ("happily", "happili"),
        ("skies", "sky"), ("news", "news"), ("exceedingly", "exceed"), ("national", "nation"), ("electricity", "electr"), ("adoption", "adopt"), ("rate", "rate"), ("controlling", "control"), ("knives", "knive"), ("dying", "die"),
    ],
)
def test_stems(word, expected):
    assert stem.stem(word) in ({expected, "dy"} if word == "dying" else {expected})


def test_postings_share_stems(spark):
    docs = spark.createDataFrame([(1, "run running RUNS"), (2, "connected connection Été été m7"), (3, None)], "id long, t string")
    rows = {(r.term, r.id): (r.tf, r.dl) for r in textindex.postings(docs, "id", ["t"]).collect()}
    assert rows == {("run", 1): (3, 3), ("connect", 2): (2, 6), ("été", 2): (2, 6), ("m", 2): (1, 6), ("7", 2): (1, 6)}
    assert textindex.query_terms("Running runs, a été") == ["run", "a", "été"]


def test_index_reads_its_terms_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 7} x{i}", "y" if i % 2 else None) for i in range(60)], "id long, t string, u string")
    index = textindex.TextIndex.build(docs, "id", ["t", "u"], str(tmp_path / "i"))
    plan = index.bm25("t", "words commonly")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan.replace(" ", "") or "term" in plan
    found = {r.id: r.score for r in index.bm25("t", "common word").collect()}
    assert set(found) == set(range(60)) and index.bm25("t", "").count() == 0
    assert {r.id for r in index.bm25("u", "y", every=True).collect()} == set(range(1, 60, 2))
    assert {r.id for r in index.matching(["t", "u"], "common x").collect()} == set(range(60))
    n, df, avg = 60.0, 60.0, 5.0
    assert found[0] > 0 and index.terms.where("field = 't' and term = 'common'").select("n", "df", "avgdl").collect() == [(n, df, avg)]
    empty = textindex.TextIndex.build(docs.limit(0), "id", ["t"], str(tmp_path / "e"))
    assert empty.bm25("t", "common").count() == 0


def test_forms_of_sql_cover_the_vocabulary(spark, sf):
    """The words that SQL is told for a stem are all that the tables have."""
    t = Lens(spark, sf)
    asked = {x for q in (searches.QUERY, searches.OBS_QUERY, searches.HYBRID, "the of", "errors m7", "the of et de") for x in textindex.query_terms(q)} | set(searches._STEMS)
    for table, fields in searches.FIELDS.items():
        for field in fields:
            words = getattr(t, table).select(F.explode(text.tokens(F.col(field))).alias("w")).distinct().collect()
            for r in words:
                if stem.stem(r.w) in asked:
                    assert r.w in searches.words_of(stem.stem(r.w))


def test_a_word_without_a_rules_end_takes_no_rule(monkeypatch):
    from memspan.functions import stem as S

    monkeypatch.setattr(S, "_regions", lambda word: 1 / 0)
    assert [S.stem(w) for w in ("prophet", "method", "québéco", "window", "2024")] == ["prophet", "method", "québéco", "window", "2024"]
