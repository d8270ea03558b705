"""Ball k-means, decontamination and ranked search against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspan.llm import ballkmeans, decontam, queries, wand

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Ball k-means


def brute_kmeans(rows, k, rounds, dims, scale, bound):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x * scale) < bound for x in v):
            kept.append((i, [math.floor(float(x) * scale) for x in v]))
    centers = [v for _, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        label = [min(range(len(centers)), key=lambda c: (apart(v, centers[c]), c)) for _, v in kept] if centers else []  # noqa: B023
        if turn < rounds:
            for c in range(len(centers)):
                mine = [v for (_, v), x in zip(kept, label, strict=True) if x == c]
                if mine:
                    centers[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    far = [apart(v, centers[c]) for (_, v), c in zip(kept, label, strict=True)]
    inertia = [sum(d for d, c in zip(far, label, strict=True) if c == x) for x in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted([(str(i), c, d, inertia[c], sum(inertia), digest[c]) for (i, _), c, d in zip(kept, label, far, strict=True)])


def clustered(df, **more):
    found = ballkmeans.ball_kmeans(df, **more)
    return sorted((str(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.rows.collect())


ODD_VECTORS = [
    (1, [0.5, 0.25, -0.5]),
    (2, None),
    (3, [0.5, None, 1.0]),
    (4, [0.5, float("nan"), 1.0]),
    (5, [float("inf"), 0.0, 0.0]),
    (6, [1.0, 2.0]),
    (7, []),
    (8, [1.0, 2.0, 3.0, 4.0]),
    (9, [0.5, 0.25, -0.5]),
    (9, [0.5, 0.25, -0.5]),
    (9, [-0.5, 0.25, 2.5]),
    (None, [3.0, 3.0, 3.0]),
    (10, [0.0, 0.0, 0.0]),
    (11, [1e30, 0.0, 0.0]),
    (12, [-3.01, -2.99, 0.0]),
    (13, [-1.0, 1.0, 7.0]),
]


@pytest.mark.parametrize("k", [1, 3, 16])
def test_ball_kmeans_of_odd_rows(spark, k):
    df = spark.createDataFrame([(*r, "x") for r in ODD_VECTORS], "vec_id long, embedding array<float>, label string")
    bound = 1 << ((60 - 2) // 2 - 1)
    assert clustered(df, k=k, dims=3) == brute_kmeans(ODD_VECTORS, k, 3, 3, 64, bound)
    none = ballkmeans.ball_kmeans(df.limit(0), dims=3)
    assert none.rows.count() == 0 and none.centroids == [] and none.rows.columns == ballkmeans.ball_kmeans(df, k=k, dims=3).rows.columns


def test_ball_kmeans_of_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in df.select("vec_id", "embedding").collect()]
    assert clustered(df) == brute_kmeans(rows, 16, 3, 64, 64, 1 << 26)


def test_clashing_names_and_string_ids(spark):
    df = spark.createDataFrame([(f"a{i % 3}", [float(i), 1.0], i, i, i) for i in range(9)], "vec_id string, embedding array<double>, label int, dist int, cluster int")
    assert len(clustered(df, dims=2, k=2)) == 9


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 9), st.integers(1, 60), st.sampled_from([2, 5, 40]))
def test_rings_find_what_all_comparisons_find(seed, k, n, spread):
    rng = np.random.default_rng(seed)
    points, before = rng.integers(-spread, spread, (n, 3)), rng.integers(-spread, spread, (k, 3))
    after = np.where(rng.random((k, 1)) < 0.4, before, before + rng.integers(-3, 4, (k, 3)))
    label, dist = ballkmeans.first_labels(points, before)
    farthest = [int(dist[label == c].max()) if (label == c).any() else -1 for c in range(k)]
    got, best, looked = ballkmeans.next_labels(points, label, dist, ballkmeans.balls(after.tolist(), farthest, before.tolist()))
    want, far = ballkmeans.first_labels(points, after)
    assert got.tolist() == want.tolist() and best.tolist() == far.tolist()
    assert looked <= n * k


def test_stable_cores_are_compared_with_nothing():
    rng = np.random.default_rng(2)
    centers = rng.integers(-2000, 2000, (12, 8))
    points = np.repeat(centers, 500, axis=0) + rng.integers(-30, 31, (6000, 8))
    label, dist = ballkmeans.first_labels(points, centers)
    farthest = [int(dist[label == c].max()) for c in range(12)]
    step = centers + 1
    _, _, looked = ballkmeans.next_labels(points, label, dist, ballkmeans.balls(step.tolist(), farthest, centers.tolist()))
    assert looked < 1.5 * len(points)
    _, _, looked = ballkmeans.next_labels(points, label, dist, ballkmeans.balls(centers.tolist(), farthest, centers.tolist()))
    assert looked == 0


# Decontamination


def brute_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def brute_hits(text, items, window=10):
    words, spans, held = brute_words(text), set(), set()
    for item, told in items:
        w = brute_words(told)
        size = min(window, len(w))
        wanted = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1) if wanted else ():
            if tuple(words[i : i + size]) in wanted:
                spans.add((i, size))
                held.add(item or "")
    return len(words), sorted(spans), sorted(held)


SAID = "Alpha beta Gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
ITEMS = [("1", SAID), ("2", "one two"), ("3", None), ("4", " ... "), ("5", "a a a a a a a a a a a a"), ("6", "Größe ÄPFEL 7 x"), (None, "lonely words of an item without id"), ("1", "again ITEM one with other words"), ("8", SAID.upper()), ("9", "kappa lambda mu nu xi omicron pi rho sigma tau upsilon")]
DOCS = [
    (1, f"before {SAID} after"),
    (1, f"before {SAID} after"),
    (1, "the same id, one TWO; three"),
    (2, " ".join(SAID.split()[:9])),
    (3, "x-" + "-".join(SAID.lower().split()[2:12]) + "-y"),
    (4, "a " * 40),
    (5, "a " * 9),
    (6, None),
    (7, ""),
    (8, "Größe äpfel 7 x größe ÄPFEL 7 X"),
    (None, f"{SAID} omicron pi rho sigma tau upsilon one two one two"),
    (9, "Lonely words of an item without id. Again item one, with other words!"),
    (10, SAID.replace("zeta", "beta") + " " + SAID),
    (11, " ".join(f"w{i}" for i in range(30_000)) + " one two " + SAID),
]


@pytest.mark.parametrize("rows", [0, 1 << 18])
def test_decontamination(spark, rows):
    items = spark.createDataFrame([(*x, "h") for x in ITEMS], "item_id string, text string, h string")
    docs = spark.createDataFrame([(*d, "a", 1, 2, "b") for d in DOCS], "doc_id long, text string, id string, row int, n int, items string")
    got = sorted(((str(r.id), r.n_words, [tuple(s) for s in r.spans], list(r["items"])) for r in decontam.contaminated(docs, items, broadcast_rows=rows).collect()), key=str)
    assert got == sorted(((str(i), *brute_hits(t, ITEMS)) for i, t in DOCS), key=str)


def test_decontamination_of_empty_tables(spark):
    items, docs = spark.createDataFrame(ITEMS, "item_id string, text string"), spark.createDataFrame(DOCS, "doc_id long, text string")
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    for none in (items.limit(0), items.where("text is null")):
        rows = decontam.contaminated(docs, none).collect()
        assert len(rows) == len(DOCS) and all(r.spans == [] and r["items"] == [] for r in rows)


WORD = st.sampled_from(["a", "b", "a b", "c-d", "É"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(WORD, max_size=8).map(" ".join), min_size=1, max_size=5), st.lists(st.lists(WORD, max_size=30).map(" ".join), min_size=1, max_size=8))
def test_decontamination_of_repeated_words(spark, told, texts):
    items = [(str(i), t) for i, t in enumerate(told)]
    rows = decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=4, shingle=2)
    got = {r.id: (r.n_words, [tuple(s) for s in r.spans], list(r["items"])) for r in rows.collect()}
    assert got == {i: brute_hits(t, items, 4) for i, t in enumerate(texts)}


def test_words_hit_once(spark):
    spans = spark.sql("select array(struct(0 as start, 3 as length), struct(1 as start, 3 as length), struct(9 as start, 1 as length)) as s")
    assert spans.select(decontam.words_hit(F.col("s")).alias("n")).head().n == 5


def test_decontamination_is_native(spark, sf):
    plan = queries.op12_decontamination(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# Ranked search


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_ranks(docs, items, limit=50):
    terms = [brute_terms(t) for _, t in docs]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for found in terms for t in set(found))
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        asked, scored = set(brute_terms(text)), []
        for (doc, _), found in zip(docs, terms, strict=True):
            counts, score = Counter(found), 0
            for t in asked & set(found):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * (50 + (50 * len(found) * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(str(item), r + 1, "None" if none else str(d), -s) for r, (s, none, d) in enumerate(sorted(scored)[:limit])]
    return sorted(out)


def searched(docs, items, **more):
    return sorted((str(r.query_id), r["rank"], str(r.id), r.score) for r in wand.search(docs, items, **more).collect())


FOUND_DOCS = [*DOCS, (12, "beta beta BETA alpha"), (13, "beta beta BETA alpha"), (0, "beta; beta beta alpha"), (None, "Alpha"), (14, " ...  ")]


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_ranked_search(spark, limit, monkeypatch):
    monkeypatch.setattr(wand, "BLOCK_QUERIES", 3)
    items = spark.createDataFrame([(*x, "h") for x in ITEMS], "item_id string, text string, query string")
    docs = spark.createDataFrame([(*d, 1, "b") for d in FOUND_DOCS], "doc_id long, text string, score int, query string")
    assert searched(docs, items, limit=limit) == brute_ranks(FOUND_DOCS, ITEMS, limit)


def test_ranked_search_of_empty_tables(spark):
    items, docs = spark.createDataFrame(ITEMS, "item_id string, text string"), spark.createDataFrame(FOUND_DOCS, "doc_id long, text string")
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items)):
        assert wand.search(d, q).count() == 0


def block_of(items):
    vocabulary = {}
    told = [sorted({vocabulary.setdefault(t, len(vocabulary)) for t in wand.terms_of(t.encode())}) for _, t in items]
    return wand.Block([i for i, _ in items], told, vocabulary)


def local_ranks(docs, items, limit, parts):
    """The search without Spark: statistics of all, each part a task."""
    block = block_of(items)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["id", "text"])
    counts = Counter()
    for b in wand._counter(block.vocabulary)(iter([batch(docs).select(["text"])])):
        counts.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    n, total = counts.get(-1, 0), counts.get(-2, 0)
    w = wand.Weights(block, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(block.vocabulary))], np.int64), n, total)
    rows = [r for p in range(parts) for b in wand._searcher(w, limit)(iter([batch(docs[p::parts])])) for r in b.to_pylist()]
    out = []
    for q, item in enumerate(block.keys):
        best = sorted((-r["score"], r["id"] is None, r["id"] or 0) for r in rows if r["query"] == q)[:limit]
        out += [(str(item), k + 1, "None" if none else str(d), -s) for k, (s, none, d) in enumerate(best)]
    return sorted(out)


TERM = st.sampled_from("abcdefghij")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(TERM, max_size=12).map(" ".join), max_size=60), st.lists(st.lists(TERM, min_size=1, max_size=6).map(" ".join), min_size=1, max_size=4), st.sampled_from([1, 2, 5]), st.sampled_from([1, 3]))
def test_pivots_lose_nothing(texts, told, limit, parts):
    docs, items = [((i * 7) % 61, t) for i, t in enumerate(texts)], list(enumerate(told))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(wand, "PIVOT_DOCS", 4)
        patch.setattr(wand, "SHARD_POSTINGS", 40)
        patch.setattr(wand, "READ_BYTES", 30)
        assert local_ranks(docs, items, limit, parts) == brute_ranks(docs, items, limit)


def test_documents_that_cannot_win_are_not_scored():
    rng = np.random.default_rng(4)
    n = 40_000
    texts = ["common words here " + " ".join(f"w{x}" for x in rng.integers(0, 400, 6)) for _ in range(n)]
    block = block_of([(0, "common words here w7 w11")])
    counts = Counter(t for x in texts for t in set(wand.terms_of(x.encode())))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts[t] + 1))) for t in block.vocabulary], np.int64)
    w = wand.Weights(block, weight, n, 9 * n)
    found = [(i, block.vocabulary[t]) for i, x in enumerate(texts) for t in wand.terms_of(x.encode()) if t in block.vocabulary]
    shard = wand.Shard.of(list(range(n)), [i for i, _ in found], [t for _, t in found], [1] * len(found), [9] * n, w)
    heap = wand.Heap(20)
    assert shard.search(block.queries[0], heap) < n / 5
    assert len(heap.rows) == 20


def test_rank_merges_are_dealt(spark, sf):
    plan = queries.op13_ranked_search(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and not re.search("CartesianProduct|NestedLoop", plan)
