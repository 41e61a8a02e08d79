"""The operators as registered queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import arc, bpe, learned_partitions, licenses, mixing, multi_index, quality, simhash, token_count, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7, folds=3, left_out=1)


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archived_pages(table(spark, sf_dir, "pages"), min_bytes=0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3, folds=5, left_out=0)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return learned_partitions.search(rows, is_query=rows["vec_id"] % 100 == 0, k=10)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), threshold=0.8)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_multi_index": op6_multi_index,
    "op7_learned_partitions": op7_learned_partitions,
    "op8_simhash": op8_simhash,
    "op9_licenses": op9_licenses,
    "op10_token_counts": op10_token_counts,
}

#: Bare upper-case base32 of a hexadecimal SHA-1 ``h``: five digits are four characters.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '')"""

ORACLE_SQL = {
    "op3_arc_to_warc": f"""
        WITH payloads AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        firsts AS (SELECT h AS digest, min(page_id) AS first FROM payloads GROUP BY h)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM payloads JOIN firsts ON h = digest
    """,
    "op6_multi_index": """
        WITH RECURSIVE vectors AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        able AS (
            SELECT * FROM vectors WHERE label IS NOT NULL AND len(e) > 0
            AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.r AS a, b.r AS b FROM able a JOIN able b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reached AS (SELECT r AS a, r AS b FROM vectors UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
        components AS (SELECT reached.a AS r, min(vectors.vec_id) AS component_id FROM reached JOIN vectors ON reached.b = vectors.r GROUP BY reached.a),
        counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM vectors JOIN components USING (r) LEFT JOIN counts USING (r)
    """,
    "op9_licenses": licenses.oracle_sql(threshold=0.8),
    "op1_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS ticket,
                   CAST('0x' || substr(md5(concat_ws('/', 'text', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS ticket2
            FROM documents),
        named AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
            FROM docs GROUP BY source),
        steps AS (
            SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER reach, 0) AS rest,
                   sum(w) OVER () - coalesce(sum(w) OVER reach, 0) AS weights, 3.0 * source_size / w AS reach_at
            FROM named
            WINDOW reach AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (
            SELECT min_by(rest, reach_at) AS rest, min_by(weights, reach_at) AS weights FROM steps WHERE 3 * source_size * weights > rest * w),
        shares AS (
            SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), CAST(w * level.rest AS DOUBLE) / CAST(level.weights AS DOUBLE)) AS target
            FROM steps, level),
        rests AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole FROM shares),
        through AS (
            SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ticket, ticket2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM docs),
        placed AS (
            SELECT t.doc_id, t.size, r.source_size, r.target, r.whole, t.total - t.size AS below, t.total, r.target - r.whole * r.source_size AS rest
            FROM through t JOIN rests r ON t.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (whole + CASE WHEN total <= rest OR (below <= rest AND total - rest < rest - below) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM placed
    """,
}
