"""Texts of the same words have the same score, so ties go to the smaller id."""

import pytest
from pyspark.sql import functions as F

from memspan.operators import textindex
from memspan.operators.textindex import TextIndex

#: Terms that unlike numbers of texts hold, so the order in which their weights are added tells in the last digits.
WORDS = ["error", "m", "7", "proj", "1", "k", "42", "the"]
SAME = 300


@pytest.fixture(scope="module")
def index(spark):
    every, some = " ".join(WORDS), ", ".join(f"if(id % {i + 2} = 0, '{w}', null)" for i, w in enumerate(WORDS))
    text = F.when(F.col("id") < SAME, F.lit(every)).otherwise(F.expr(f"concat_ws(' ', {some})"))
    return TextIndex.build(spark.range(0, 3 * SAME).select("id", text.alias("t")), "id", ["t"])


@pytest.mark.parametrize("apart", [64, 0])
def test_search_text_ties(index, monkeypatch, apart):
    monkeypatch.setattr(textindex, "SUMMED_APART", apart, raising=False)
    read = TextIndex._read
    # Postings come in another order for each text, as they do from many files.
    dealt = lambda self, table, names=None: read(self, table, names).repartition(8, "id", "term") if table == "postings" else read(self, table, names)
    monkeypatch.setattr(TextIndex, "_read", dealt)
    scores = {r.score for r in index.bm25("t", " ".join(WORDS)).where(F.col("id") < SAME).collect()}
    assert len(scores) == 1
    assert sorted(r.id for r in index.top("t", " ".join(WORDS), 20).collect()) == list(range(20))
