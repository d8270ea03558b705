"""Plans and commits by files: sets that plans repeat meet a commit once, and nothing is grouped by pairs."""

import re

from memspan.operators import lifecycle

PLANS = [(p, f"f{(p % 4) * i % 7}") for p in range(24) for i in range(p % 3 + 1)]
COMMITS = [(c, f"f{(c * i + i) % 9}") for c in range(40) for i in range(c % 5 + 1)]


def frames(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "LIST_PLANS", 2, raising=False)
    return spark.createDataFrame([*PLANS, PLANS[0], (3, None)], "plan_id long, file string"), spark.createDataFrame([*COMMITS, COMMITS[3], (7, None)], "commit_id long, file string")


def sets(rows):
    out = {}
    for k, f in rows:
        out.setdefault(k, set()).add(f)
    return out


def grouped_pairs(df):
    found = re.findall(r"Exchange (hashpartitioning\(.*)", df._jdf.queryExecution().executedPlan().toString())
    return [x for x in found if "commit_id#" in x and re.search("plan_id#|files#", x)]


def test_commit_file_overlap(spark, monkeypatch):
    made = lifecycle.overlapping(*frames(spark, monkeypatch))
    counts = {p: sum(1 for y in sets(COMMITS).values() if x & y) for p, x in sets(PLANS).items()}
    assert {tuple(r) for r in made.collect()} == {(p, n) for p, n in counts.items() if n}
    assert not grouped_pairs(made)


def test_plan_coverage(spark, monkeypatch):
    for least in (0.3, 0.8, 1.0):
        made = lifecycle.covered(*frames(spark, monkeypatch), least)
        rows = [(r[0], r[1], round(r[2], 6)) for r in made.collect()]
        want = {(p, c, round(len(x & y) / len(x), 6)) for p, x in sets(PLANS).items() for c, y in sets(COMMITS).items() if x & y and len(x & y) >= least * len(x)}
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert not grouped_pairs(made)
