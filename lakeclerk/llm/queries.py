"""The queries of this subpackage, each an operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeclerk.llm import (
    bpe,
    decontam,
    hard_negatives,
    html_text,
    langid,
    license_scan,
    neardup,
    passages,
    periodic_runs,
    secret_scan,
    shingle_join,
    topk,
    training_order,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op2_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_notices(table(spark, sf_dir, "documents"))


def op3_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return training_order.sequence_digests(documents, RANKS, public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


def op8_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op9_sorted_lists_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_inner_products(vectors, F.col("vec_id") % 20 == 0)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    key, label = F.col("vec_id"), F.col("label")
    label = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(vectors, key % 100 == 0, label)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.shingle_components(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_latent_decontamination,
        op2_license_classifier,
        op3_feistel_order,
        op4_language_id,
        op5_tree_bpe,
        op6_order_minhash,
        op7_secret_scan,
        op8_collinear_chaining,
        op9_sorted_lists_topk,
        op10_html_extraction,
        op11_hard_negatives,
        op12_periodic_runs,
        op13_ngram_jaccard_join,
    )
}


def secrets_sql() -> str:
    """Spans from the lengths of matches and of what stands between them."""
    rules = " UNION ALL ".join(
        f"""
        SELECT row, '{rule.kind}' AS kind, {place} AS place, {rule.least} AS least,
               regexp_extract_all(t, '{pattern}', 0) AS m,
               regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
               string_split_regex(t, '{pattern}') AS gaps
        FROM docs
        """
        for place, rule in enumerate(secret_scan.RULES)
        for pattern in [rule.pattern.replace("'", "''")]
    )
    counts = ", ".join(
        f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}"
        for rule in secret_scan.BASE_RULES
    )
    base = len(secret_scan.BASE_RULES)
    span = "kind || ':' || b || ':' || e, ',' ORDER BY b, place"
    return f"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
        ), every AS ({rules}), numbered AS (
            SELECT *, unnest(range(1, len(m) + 1)) AS i FROM every
        ), placed AS (
            SELECT row, kind, place, length(m[i]) AS size, length(g[i]) >= least AS fits,
                   list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT
                   + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT
                   AS b
            FROM numbered
        ), spans AS (SELECT *, b + size AS e FROM placed WHERE fits), found AS (
            SELECT row, {counts},
                   string_agg({span}) FILTER (place < {base}) AS base,
                   string_agg({span}) AS spans
            FROM spans GROUP BY row
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
               coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans
        FROM docs LEFT JOIN found USING (row)
    """


ORACLE_SQL = {
    "op7_secret_scan": secrets_sql(),
    "op9_sorted_lists_topk": """
        WITH v AS (
            SELECT vec_id,
                   list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id,
                   row_number() OVER (
                       PARTITION BY query_id ORDER BY score DESC, vec_id
                   )::INTEGER AS rank,
                   vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
                   list_inner_product(a.e, r.e)::BIGINT AS score
            FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.e) = len(r.e)
            WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), ranked AS (
            SELECT anchor_id, positive_id,
                   row_number() OVER (
                       PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id
                   )::INTEGER AS rank,
                   vec_id AS negative_id, positive_score, score AS negative_score
            FROM positives JOIN scored USING (anchor_id)
            WHERE NOT same AND 80 * positive_score <= 100 * score
              AND 100 * score <= 100 * positive_score
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
}
