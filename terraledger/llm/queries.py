"""The queries of the corpus operators with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, near_dedup, packing, quality_model, quality_rules, substring_dedup, toxicity, url_filters
from .runtime import new_path, table
from .tokens import TokenStore, default_tokenizer


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.digest(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_tokenizer(), window=2048, end_id=1)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TokenStore.write(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), default_tokenizer(), end_id=0).digest()


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.resolve(table(spark, sf_dir, "documents"), near_dedup.Params(words=3, percent=85))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_packing,
        op3_substring_dedup,
        op4_exact_dedup,
        op5_mixing,
        op6_token_store,
        op7_quality_model,
        op8_near_dedup,
        op9_quality_rules,
        op10_toxicity,
    )
}

ORACLES = {
    "op1_url_filters": r"""
        WITH c AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '\.+$', ''), '') AS host,
                          rtrim(ltrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '/') AS path,
                          TIMESTAMP '2024-01-01' + to_days(CAST((page_id * 7919) % 365 AS INTEGER)) AS t FROM pages),
        h AS (SELECT DISTINCT host AS h, ascii(md5(host)[1]) AS a, ascii(md5(host)[2]) AS b FROM c WHERE host IS NOT NULL),
        e AS (SELECT h AS pattern, 'block' AS action, 'spam' AS category, 'add' AS change, (b * 7) % 200 AS d FROM h WHERE a % 3 = 0
              UNION SELECT h, 'block', 'spam', 'remove', (b * 7) % 200 + 60 FROM h WHERE a % 3 = 0 AND b % 2 = 0
              UNION SELECT h, 'block', 'malware', 'add', (b * 7) % 200 + 150 FROM h WHERE a % 3 = 0 AND b % 4 = 0
              UNION SELECT h || '/en', 'block', 'adult', 'add', b % 100 FROM h WHERE a % 5 = 1
              UNION SELECT h || '/fr', 'allow', 'review', 'add', 10 FROM h WHERE a % 3 = 0 AND b % 3 = 0),
        s AS (SELECT pattern, action, category, change, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AS since,
                     lead(TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER))) OVER (PARTITION BY pattern, action ORDER BY d, change = 'add', category) AS until FROM e),
        m AS (SELECT c.page_id, s.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.pattern) DESC, s.action, s.since DESC, s.category) AS rn
              FROM c JOIN s ON s.change = 'add' AND s.since <= c.t AND (s.until IS NULL OR c.t < s.until)
               AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern) OR starts_with(c.host || '/' || c.path || '/', s.pattern || '/') AND contains(s.pattern, '/')))
        SELECT c.page_id, c.host, strftime(c.t, '%Y-%m-%d') AS fetched_on, coalesce(m.action, 'none') AS verdict, m.pattern, m.category, strftime(m.since, '%Y-%m-%d') AS since_on
        FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.rn = 1""",
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM d GROUP BY source),
        o AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER b, 0) AS BIGINT) AS rest, CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS ws
              FROM s WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT rest, ws FROM o WHERE CAST(3 * source_size AS HUGEINT) * ws >= CAST(w AS HUGEINT) * rest ORDER BY 3 * source_size / w, source NULLS LAST LIMIT 1),
        t AS (SELECT o.source, o.source_size, CASE WHEN CAST(3 * o.source_size AS HUGEINT) * f.ws < CAST(o.w AS HUGEINT) * f.rest THEN CAST(3 * o.source_size AS DOUBLE)
                     ELSE CAST(f.rest * o.w AS DOUBLE) / CAST(f.ws AS DOUBLE) END AS target FROM o, f),
        p AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(target) AS BIGINT) // t.source_size ELSE 0 END AS e,
                     CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS b
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(e * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - e * source_size - b)) AS BIGINT) AS taken FROM p""",
}
