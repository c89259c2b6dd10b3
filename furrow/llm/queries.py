"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, html_text, license_scan, media, minhash_dedup, packing, quality_rules, secret_scan, sharding, token_counts, url_filter, whitening
from .common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir), words=4, percent=80)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=24)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), "byte_bpe_50k.json", limit=1024)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir), license_scan.KNOWN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(documents(spark, sf_dir), "word_bpe_49k.json", length=4096, end_id=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of ``labels`` stands for the page of its id: bad if toxic or of low quality."""
    labels = _table(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    return url_filter.judge(_table(spark, sf_dir, "pages"), labels.agg(bad.alias("bad")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), "byte_bpe_50k.json")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), "embedding", most=16)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), "byte_bpe_50k.json", "piece_bpe_32k.model")


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_sharding, op3_token_counts, op4_license_scans, op5_packing, op6_quality_rules, op7_media_columns, op8_secret_scans, op9_url_filters, op10_bpe, op11_whitening, op12_alignment, op13_html_text)}

#: All pairs that share a shingle, counted, and the transitive closure of the links.
DEDUP_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON r.b = l.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(coalesce(least(doc_id, b), doc_id) AS BIGINT) AS component_id, doc_id = coalesce(least(doc_id, b), doc_id) AS kept
FROM sets LEFT JOIN least_ ON doc_id = a"""

#: The table's pages have one layout; their text is what stands in the article.
PAGES_SQL = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS t FROM a)
SELECT page_id, url, coalesce(trim(regexp_replace(t, '\s+', ' ', 'g')), '') AS text, CAST(length(coalesce(trim(regexp_replace(t, '\s+', ' ', 'g')), '')) AS BIGINT) AS n_chars FROM d"""

ORACLES: dict[str, str] = {"op1_minhash_dedup": DEDUP_SQL, "op13_html_text": PAGES_SQL}
