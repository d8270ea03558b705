"""The thirteen registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspan.llm import ballkmeans, decontam, langid, licenses, linedup, nndescent, packing, pieces, secrets, simhash, sketch, urltrie, wand
from memspan.sources.tables import read_table

#: The rules that the URL query is asked to apply.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is not to be learned from: crc32 of its id as text leaves 1 over 3."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % 3 == 1


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs, where=~held_out(), order=F.xxhash64("doc_id"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = langid.predict(docs, language_model(docs))
    return rows.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    size = F.floor(n / 4).cast("int")
    edit = F.concat(F.substring("text", F.lit(1), n - size), F.substring("next_text", F.lit(1), size))

    def sketched(rows: DataFrame) -> DataFrame:
        places = [c for c in rows.columns if c.startswith("_")]
        edited = rows.select("doc_id", *places, "text", n.cast("long").alias("n_chars"), edit.alias("edited"))
        both = sketch.sketches(sketch.sketches(edited, "text", "sketch"), "edited", "edited_sketch")
        return both.select("doc_id", *places, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch")

    rows = sketch.with_next(docs, tie=F.xxhash64("text"), carry=("text",), made=sketched, carry_made=("sketch",))
    mine, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    # Of texts so short that no hash is kept nothing is known unless they have the same words; the columns of counts tell, and the likeness is 0.
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketch.fingerprint(mine).alias("fingerprint"),
        sketch.fingerprint(edited).alias("edited_fingerprint"),
        F.coalesce(sketch.likeness(mine, edited), F.lit(0.0)).alias("near_edited"),
        F.coalesce(sketch.likeness(mine, following), F.lit(0.0)).alias("near_next"),
        sketch.compared(mine, edited).alias("compared_edited"),
        sketch.compared(mine, following).alias("compared_next"),
        sketch.containment(mine, edited).alias("contained_in_edited"),
    )


def packed(docs: DataFrame) -> DataFrame:
    rows = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), ranks=tokenizer_path("byte_bpe_50k.tiktoken"))
    return rows.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linedup.drop_common_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(read_table(spark, sf_dir, "documents"))
    found = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], F.round(x["share"], 4).cast("string"), x["word"].cast("string"))), ",")
    return rows.select(F.col("id").alias("doc_id"), F.size("licenses").cast("long").alias("n_licenses"), found.alias("licenses"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return rows.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"), count("novel")
    )


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report: dict = {}
    rows = nndescent.near_duplicates(read_table(spark, sf_dir, "embeddings"), report=report)
    recall = F.lit(report["recall"][-1]).cast("double").alias("audited_recall")
    return rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", nndescent.kept(F.col("component_id"), F.col("id")).alias("kept"), recall)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urltrie.judge(read_table(spark, sf_dir, "pages"), RULES)
    return rows.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rule, h, p) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
         ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), best AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (page_id)
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ballkmeans.ball_kmeans(read_table(spark, sf_dir, "embeddings"))
    return found.rows.withColumnRenamed("id", "vec_id")


def _kmeans_sql(k: int = 16, rounds: int = 3) -> str:
    """Assignments and updates one after the other; ``d * k + c`` is least for the nearest centroid with the smallest number."""
    whole = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))))"
    ctes = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND {whole})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        apart = "CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        ctes.append(f"a{i} AS MATERIALIZED (SELECT p.r, any_value(p.vec_id) AS vec_id, any_value(p.v) AS v, min({apart} * {k} + c.c) AS m FROM kept p, c{i} c GROUP BY p.r)")
        if i < rounds:
            ctes.append(f"s{i} AS (SELECT m % {k} AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY ALL)")
            ctes.append(f"u{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c)")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(u{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN u{i} ON c{i}.c = u{i}.c)")
    return (
        f"WITH {', '.join(ctes)}, told AS (SELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, CAST(m // {k} AS BIGINT) AS distance FROM a{rounds}) "
        "SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM told JOIN c{rounds} c ON told.cluster = c.c"
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit = decontam.words_hit(F.col("spans"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


OP12_SQL = r"""
WITH lower_docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (
  SELECT item, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, list_aggregate(w[i + 1 : i + 10], 'string_agg', ' ') AS k, least(len(w), 10) AS n FROM starts
), places AS (
  SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM lower_docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
  SELECT p.r, p.i, p.n, item FROM (SELECT r, n, i, list_aggregate(w[i + 1 : i + n], 'string_agg', ' ') AS k FROM places) p JOIN windows USING (k, n)
), hit AS (
  SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM lower_docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wand.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), stats AS (
  SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM docs
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, stats GROUP BY term, n_docs
), part AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(t) * n_docs) // n_terms))) AS s
  FROM tf JOIN weight USING (term) JOIN docs USING (r), stats
), scored AS (
  SELECT item_id, r, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN part USING (term) GROUP BY ALL HAVING sum(s) > 0
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN docs USING (r)
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_sentencepiece, op2_language_id, op3_fingerprints, op4_packing, op5_line_dedup, op6_license_scan, op7_secret_scan, op8_embedding_near_dedup, op9_url_filter, op10_simhash, op11_ball_kmeans, op12_decontamination, op13_ranked_search)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op9_url_filter": OP9_SQL, "op11_ball_kmeans": _kmeans_sql(), "op12_decontamination": OP12_SQL, "op13_ranked_search": OP13_SQL}
