"""Operators on pairs and groups, and the pipeline, against brute force."""

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from memspan.llm import components, langid, linedup, nndescent, secrets, simhash
from memspan.llm.queries import language_model
from test_texts import BYTES, brute_lines, whole


def groups(nodes, pairs):
    """The smallest node of each node's component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(5)
    # A chain, stars with hubs in the middle of their leaves, and random edges.
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1040, 1000 + i) for i in range(0, 180)] + [(3000 + i, 3300) for i in range(150)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2200, (150, 2))]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    want = groups({x for p in pairs if p[0] != p[1] for x in p}, pairs)
    assert {r.node: r.component for r in components.connected_components(edges).collect()} == want
    assert components.connected_components(edges.limit(0)).count() == 0


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_near(prints, budget=3):
    found = np.array(prints, np.uint64)
    return [(i, int(j)) for i in range(len(found)) for j in np.flatnonzero(np.bitwise_count(found[i + 1 :] ^ found[i]) <= budget) + i + 1]


@pytest.mark.parametrize("pairs", [50, 1 << 20])
def test_walk_connects_what_links_do(pairs):
    rng = np.random.default_rng(3)
    heads = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (60, 40, 2), dtype=np.uint64)
    leaves = np.unique(np.concatenate([heads, (heads[:, None] ^ flips[..., 0] ^ flips[..., 1]).ravel(), np.array([0, 1, 2**64 - 1], np.uint64)]))
    want = groups(range(len(leaves)), brute_near(leaves))
    src, dst = simhash.walk(leaves, None, 0, 0, 3, pairs)
    at = {int(x): i for i, x in enumerate(leaves)}
    assert len(src) < len(leaves)
    assert groups(range(len(leaves)), [(at[int(a)], at[int(b)]) for a, b in zip(src, dst, strict=True)]) == want
    low, high = leaves[leaves < 1 << 62], leaves[(leaves >= 1 << 62) & (leaves < 1 << 63)]
    src, dst = simhash.walk(low, high, 2, 1, 3, pairs)
    assert np.all(np.bitwise_count(src ^ dst) <= 3)


@pytest.mark.parametrize("node", [8, 1 << 16])
def test_simhash(odd, documents, node):
    for df in (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), documents):
        rows = sorted((r.doc_id, brute_print(r.text)) for r in df.select("doc_id", "text").collect())
        want = groups(range(len(rows)), brute_near([p for _, p in rows]))
        got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df, node=node).collect()}
        assert got == {i: (p, rows[want[k]][0]) for k, (i, p) in enumerate(rows)}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    # Rows that repeat an id each have their own component.
    apart = simhash.near_duplicates(odd.sparkSession.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n"), (2, "a b c d e f g")], "doc_id long, text string"))
    assert sorted((r.id, r.component_id) for r in apart.collect()) == [(1, 1), (2, 1), (2, 2)]


def test_tiles_below_depth_three(spark):
    node = 200
    rng = np.random.default_rng(12)
    # A third of all fingerprints below one node of 12 bits, which is taken deepest.
    hot = rng.integers(0, 1 << 52, 150, dtype=np.uint64)
    heads = np.concatenate([hot, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    flips = np.uint64(1) << rng.integers(0, 64, (250, 2), dtype=np.uint64)
    leaves = np.unique(np.concatenate([heads, heads ^ flips[:, 0] ^ flips[:, 1]]))
    df = spark.createDataFrame([(int(x),) for x in leaves.view(np.int64)], "fp long")
    found = simhash.tiles(df, node=node)
    tiles = found.collect()
    assert max(t.depth for t in tiles) >= 12 and all(t.differ == (t.a ^ t.b).bit_count() <= 3 for t in tiles)
    assert len({(t.depth, t.a, t.b) for t in tiles}) == len(tiles)
    at = {int(x): i for i, x in enumerate(leaves.view(np.int64))}
    links = simhash.tile_links(df, found)
    pairs = [(at[r.src], at[r.dst]) for r in links.collect()]
    assert groups(range(len(leaves)), pairs) == groups(range(len(leaves)), brute_near(leaves))
    text = links._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_fingerprint_agrees_with_the_built_in_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).head()
    assert row.h % (1 << 64) == brute_print("One\ttwo\nthree") == simhash.majority_bits([simhash.shingle_hashes("one two three", 3, 42)])[0]


def brute_vectors(rows, threshold=0.93):
    sound = {i: np.array(v, float) for i, v, label in rows if v and label is not None and None not in v and np.all(np.isfinite(v)) and np.any(v)}
    label = {i: x for i, _, x in rows}
    ids = sorted(sound)
    pairs = []
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sound[i], sound[j]
            if label[i] == label[j] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                pairs.append((i, j))
    links = {i: sum(i in p for p in pairs) for i, _, _ in rows}
    return links, groups(links, pairs)


def test_embeddings(spark):
    rng = np.random.default_rng(11)
    vectors = []
    for label in (0, 1, 2):
        vectors += [(v, label) for v in rng.standard_normal((60, 24))]
        center = rng.standard_normal(24)
        vectors += [(center + 0.12 * rng.standard_normal(24), label) for _ in range(45 if label else 5)]
        vectors += [(center, label)] * 6
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(vectors)]
    bad = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)] + [(2000, rows[0][1], None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, u string, n int")
    links, heads = brute_vectors(rows)
    got = {r.id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df, block=16, cell=32).collect()}
    assert set(got) == set(links)
    true, found = sum(links.values()), sum(n for n, _ in got.values())
    assert all(got[i][0] <= n for i, n in links.items())
    assert found >= 0.97 * true
    assert np.mean([got[i][1] == heads[i] for i in links]) >= 0.97
    assert nndescent.near_duplicates(df.limit(0)).count() == 0
    assert nndescent.expected_recall(0.93, 5, 6) > 0.98
    # String ids, and a component named by the smallest of them.
    report = {}
    named = nndescent.near_duplicates(df.withColumn("vec_id", F.concat(F.lit("v"), F.lpad("vec_id", 5, "0"))), block=16, cell=32, report=report).collect()
    assert {int(r.id[1:]): (r.n_links, int(r.component_id[1:])) for r in named}.keys() == got.keys()
    assert report["recall"][-1] >= 0.98 or report["exact"]
    assert sum(r.n_links for r in named) >= 0.97 * true


def test_crowded_keys_are_dealt(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, F.lit(0)).otherwise(F.col("id")).alias("k"))
    found = nndescent._dealt(rows, ["k"], 100)
    assert found.count() == 5000 and found.columns == ["id", "k", "salt"]
    assert found.where("k <> 0").agg(F.max("salt")).head()[0] == 0
    sizes = [r["count"] for r in found.where("k = 0").groupBy("salt").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 200


def test_saturated_clusters_that_link_only_across(spark):
    rng = np.random.default_rng(4)
    # Cosines: about 0.999 inside a cluster, 0.95 across, so no list of ten holds a link across.
    tilt = np.array([0.95, np.sqrt(1 - 0.95**2)])
    vectors = []
    for centre in (np.eye(24)[0], tilt[0] * np.eye(24)[0] + tilt[1] * np.eye(24)[1], np.eye(24)[9]):
        vectors += [centre + 0.005 * rng.standard_normal(24) for _ in range(20)]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, heads = brute_vectors(rows)
    assert len(set(heads.values())) == 2 and set(links.values()) == {39, 19}
    for block in (8, 1024):
        got = {r.id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df, block=block).collect()}
        assert got == {i: (links[i], heads[i]) for i in links}


def test_audit_sees_small_groups_beside_a_large_one(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(24)
    vectors = [centre + 0.05 * rng.standard_normal(24) for _ in range(120)]
    for v in rng.standard_normal((60, 24)):
        vectors += [v, v + 0.03 * rng.standard_normal(24)]
    # Ids are all odd, and one table of tiny cells without refinement loses most small groups.
    rows = [(2 * i + 1, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, heads = brute_vectors(rows)
    got = {r.id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df, cell=2, tables=1, rounds=0, block=32).collect()}
    assert got == {i: (links[i], heads[i]) for i in links}
    assert nndescent._reached({1: 0}, {}, 10) is None and nndescent._reached({1: 0}, {}, 10, every=True) == 1.0
    few, many = {i: 1 for i in range(99)}, {1000: 9000}
    assert nndescent._reached(few | many, many, 10) == 0
    assert nndescent._reached(few | many, few | {1000: 4500}, 10) == 0.5


def test_rare_links_are_measured(spark):
    """Few linked pairs, and parameters that lose some: all classes are asked, so the loss is seen."""
    rng = np.random.default_rng(9)
    vectors = list(rng.standard_normal((1500, 16)))
    vectors += [v + 0.05 * rng.standard_normal(16) for v in vectors[:20]]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, heads = brute_vectors(rows)
    report = {}
    got = {r.id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df, tables=1, rounds=0, keep=1, cell=4, report=report).collect()}
    assert report["recall"][-1] is not None
    assert got == {i: (links[i], heads[i]) for i in links} or (report["recall"][-1] >= 0.98 and not report["exact"])
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(links.values())


def test_likely_classes_are_asked_where_links_are_rare(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "AUDIT", 8)
    monkeypatch.setattr(nndescent, "MOST_ASKED", 40)
    rng = np.random.default_rng(10)
    vectors = list(rng.standard_normal((3000, 16)))
    vectors += [v + 0.02 * rng.standard_normal(16) for v in vectors[:5]]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    report = {}
    got = {r.id: r.n_links for r in nndescent.near_duplicates(df, report=report).collect()}
    assert report["recall"] == [1.0] and sum(got.values()) == 10
    report = {}
    assert nndescent.near_duplicates(df.limit(3000), report=report).agg(F.sum("n_links")).head()[0] == 0
    assert set(report["recall"]) == {None} and not report["exact"]


def test_pipeline(spark, sf, documents, odd, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    extra = odd.where("doc_id between 0 and 30").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 90_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    told = [(95_000 + i, f"some text that tells password=hunter{i}22 and goes on for a while {i}", "en", "s", 9) for i in range(3)]
    docs = documents.unionByName(extra).unionByName(spark.createDataFrame(told, documents.schema))
    text = {r.doc_id: r.text for r in docs.collect()}

    one = stages["language_id"](spark, docs, sf)
    assert one.columns == docs.columns
    model = language_model(docs)
    unknown = {r.id for r in langid.predict(docs, model).collect() if r.lang_pred == "und"}
    assert unknown and {r.doc_id for r in one.collect()} == set(text) - unknown

    two = stages["line_dedup"](spark, one, sf)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {(r.doc_id, r.text, r.n_chars) for r in two.collect()} == {(i, t, len(t)) for i, _, _, t in brute_lines(rows, linedup.THRESHOLD)}

    again = two.unionByName(two.limit(5))
    three = stages["simhash_near_dedup"](spark, again, sf)
    prints = sorted((r.doc_id, brute_print(r.text)) for r in two.collect())
    heads = groups(range(len(prints)), brute_near([p for _, p in prints]))
    assert sorted(r.doc_id for r in three.collect()) == sorted({prints[h][0] for h in heads.values()})

    four = stages["secret_scan"](spark, three, sf)
    hit = {r.id for r in secrets.scan(three).collect() if r.spans}
    before = {r.doc_id: r.text for r in three.collect()}
    assert hit
    for r in four.collect():
        assert r.n_chars == len(r.text)
        assert (r.text != before[r.doc_id]) == (r.doc_id in hit)

    from tokenizers import Tokenizer

    five = stages["packing"](spark, four, sf)
    after = {r.doc_id: r.text for r in four.collect()}
    tokens = {}
    for r in five.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    coder = Tokenizer.from_file(BYTES)
    assert tokens == {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}
    assert zlib.crc32(b"") == 0 and whole is not None

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").count().count() == four.count()


def test_near_dedup_stage_tells_null_and_repeated_ids_apart(spark, sf, documents):
    texts = [f"{word} is what this text is about and nothing else like {word * 3} stands near {word[::-1]}" for word in ("river", "engine", "violin", "glacier", "market", "lantern")]
    ids = [None, None, None, 7, 7, 8]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)]
    # Copies under a null id, under an id that is kept already, and a copy of a text without id under an id.
    rows += [(None, texts[0], "en", "s", 1), (8, texts[3], "en", "s", 1), (9, texts[1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, documents.schema)
    assert not brute_near([brute_print(t) for t in texts])
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf).collect()
    # The order of input makes no difference, nor which row of one id and text comes first.
    more = [*rows, (7, texts[3], "de", "t", 5), (7, texts[3], "en", "a", 5)]
    runs = [dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.createDataFrame(r, documents.schema), sf).collect() for r in (more, more[::-1])]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1])) and ("de", "t") in {(r.lang, r.source) for r in runs[0]}
    want = [(None, texts[0]), (9, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5])]
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in want)


def test_stages_keep_columns_of_any_name(spark, sf, documents):
    names = ["n_lines", "n_dropped", "_doc", "_key", "others", "_lang_pred", "kept", "id"]
    told = documents.select("doc_id", "text", "lang").limit(60)
    docs = told.select("doc_id", "text", "lang", *(F.lit(-7).alias(c) for c in names))
    shared = spark.createDataFrame([(900 + i, f"one shared line of the text\nand the own line number {i} of it", "en", *([-7] * len(names))) for i in range(12)], docs.schema)
    docs = docs.unionByName(shared)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", *names], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.where(" or ".join(f"`{c}` <> -7" for c in names)).count() == 0, name
    assert docs.where("text like '%shared line%'").count() == 0 and docs.count() > 0


def test_pipeline_of_an_empty_table(spark, sf, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
