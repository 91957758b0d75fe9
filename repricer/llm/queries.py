"""The registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repricer.llm import audit, clusters, dedup, html, jaccard, language, mixing, packing, quality, shards, tokencount, topk, toxicity
from repricer.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.byte_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identified(docs).select(
        "doc.doc_id",
        language.is_held_out(F.col("doc.doc_id")).alias("held_out"),
        F.col("predicted.lang").alias("lang_pred"),
        F.col("predicted.score").alias("score"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.graded(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity = jaccard.Similarity(words=4, percent=85)
    linked = jaccard.linked_documents(table(spark, sf_dir, "documents"), similarity)
    return linked.select("doc_id", "n_shingles", "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counted(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = dedup.open_index(spark).add(table(spark, sf_dir, "documents"))
    return decisions.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_inner_products(vectors, F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = clusters.clustered(table(spark, sf_dir, "embeddings"))
    return assigned.withColumn("centroid_sha256", clusters.centroid_digests(centroids))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_byte_shards": op2_byte_shards,
    "op3_html_extraction": op3_html_extraction,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mixing": op7_source_mixing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroid_clusters": op13_centroid_clusters,
}


def _rounds_sql(rounds: int) -> str:
    """Common table expressions of the clustering rounds: near0 is the first assignment, near{rounds} the last."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (
            SELECT vec_id, v, min(distance) AS distance, arg_min(cluster, (distance, cluster)) AS cluster FROM (
                SELECT v.row, v.vec_id, v.v, c.cluster,
                    CAST(list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.c) + list_inner_product(c.c, c.c) AS BIGINT) AS distance
                FROM v, c{k} AS c) GROUP BY row, vec_id, v)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS (
                SELECT cluster, coalesce(m.c, old.c) AS c FROM c{k} AS old LEFT JOIN (
                    SELECT cluster, list(mean ORDER BY i) AS c FROM (
                        SELECT cluster, i, floor(sum(CAST(v[i] AS DOUBLE)) / count(*)) AS mean
                        FROM near{k}, range(1, 65) AS r(i) GROUP BY cluster, i) GROUP BY cluster) AS m USING (cluster))""")
    return ", ".join(steps)


ORACLE: dict[str, str] = {
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
    "op11_exact_top_k": """
        WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
            WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
            FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
                len(words) < 100,
                100 * len(list_distinct(words)) < 80 * len(words),
                100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t),
                regexp_matches(t, '[#$%&*|]'),
                coalesce(doc_id > first, false)] AS fails
            FROM w LEFT JOIN l USING (doc_id)),
        s AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        letters AS (SELECT substr('ABCDE', CAST(i AS INTEGER), 1) AS x FROM range(1, 6) AS r(i)),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT o, CAST(i AS INTEGER) AS step, substr(o, CAST(i AS INTEGER), 1) AS x FROM orders, range(1, 6) AS r(i)),
        reached AS (SELECT s.part, o AS filter_order, step, x, n, good, toxic,
                fails[strpos('ABCDE', x)] AS failing,
                len([1 FOR k IN [1, 2, 3, 4, 5] IF fails[k] AND strpos(o, substr('ABCDE', k, 1)) < step]) > 0 AS gone,
                len([1 FOR k IN fails IF k]) AS many
            FROM s, steps),
        counted AS (SELECT part, filter_order, step, x,
                sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN failing AND many = 1 THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
            FROM reached GROUP BY part, filter_order, step, x)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
        FROM counted
    """,
    "op13_centroid_clusters": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        c0 AS (SELECT row_number() OVER (ORDER BY hash, v) - 1 AS cluster, v AS c FROM (
            SELECT sha256('2:' || vec_id) AS hash, v FROM v ORDER BY hash, v LIMIT 40)),
        {_rounds_sql(5)},
        sums AS (SELECT cluster, sum(distance) AS total FROM near5 GROUP BY cluster),
        digests AS (SELECT cluster, sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN c], ',')) AS centroid_sha256 FROM c5)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(total AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM near5 JOIN sums USING (cluster) JOIN digests USING (cluster)
    """,
}
