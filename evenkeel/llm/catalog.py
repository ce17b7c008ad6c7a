"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import classifier, decontaminate, line_dedup, prob_minhash, quality_rules, sentencepiece_codec, sharding, substring_dedup, token_counts, url_filters
from evenkeel.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicate_classes(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(read(spark, sf_dir, "documents"))


def _day(n: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))


def _list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of ``pages``, by a rule on their md5: the tables have no lists.

    A host is blocked from a day on, a third of them are taken off 120 days later, half of those are
    put on again after 300; a quarter has its path /en/ allowed.
    """
    hosts = pages.select(url_filters.host(F.col("url")).alias("h")).where("h != ''").distinct()
    x = F.conv(F.substring(F.md5("h"), 1, 7), 16, 10).cast("long")
    rows = hosts.select("h", x.alias("x"))
    entry = lambda name, pattern, action, day: F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), day.alias("at"))
    first = F.col("x") % 700
    every = F.array(
        entry("block", F.col("h"), "add", _day(first)),
        F.when(F.col("x") % 3 == 0, entry("block", F.col("h"), "remove", _day(first + 120))),
        F.when(F.col("x") % 6 == 0, entry("block", F.col("h"), "add", _day(first + 300))),
        F.when(F.col("x") % 4 == 1, entry("allow", F.concat(F.col("h"), F.lit("/en/")), "add", _day(first / 2))),
    )
    return rows.select(F.inline(F.filter(every, lambda e: e.isNotNull())))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are taken as fetched on a day that their id decides: the table has no time."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _day(F.col("page_id") * 37 % 900))
    return url_filters.judge(captures, _list_entries(pages)).withColumn("fetched_at", F.col("fetched_at").cast("string"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), sharding.HashTree.balanced(24))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_substring_dedup, op3_prob_minhash, op4_quality_classifier, op5_token_counts, op6_url_filters, op7_sentencepiece, op8_decontamination, op9_hash_tree_sharding, op10_line_dedup)}

#: Host and path of a URL, as in ``url_filters``.
_HOST = "lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '[.]?(:[0-9]*)?$', ''))"
_PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/')"

SQL: dict[str, str] = {
    "op6_url_filters": f"""
WITH cap AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 900 AS INTEGER) AS DATE) AS fetched_at, {_HOST} AS h, {_PATH} AS p FROM pages
), host AS (
  SELECT h, CAST('0x' || substr(md5(h), 1, 7) AS BIGINT) AS x FROM (SELECT DISTINCT h FROM cap WHERE h <> '')
), entry AS (
  SELECT 'block' AS list, h AS pattern, 'add' AS action, x % 700 AS d FROM host
  UNION ALL SELECT 'block', h, 'remove', x % 700 + 120 FROM host WHERE x % 3 = 0
  UNION ALL SELECT 'block', h, 'add', x % 700 + 300 FROM host WHERE x % 6 = 0
  UNION ALL SELECT 'allow', h || '/en/', 'add', x % 700 // 2 FROM host WHERE x % 4 = 1
), span AS (
  SELECT list, pattern, action, DATE '2024-01-01' + CAST(d AS INTEGER) AS since,
         lead(DATE '2024-01-01' + CAST(d AS INTEGER)) OVER (PARTITION BY list, pattern ORDER BY d) AS until
  FROM (SELECT list, pattern, d, max(action) AS action FROM entry GROUP BY ALL)
), hit AS (
  SELECT c.page_id, count(*) FILTER (WHERE list = 'block') AS n_block, count(*) FILTER (WHERE list = 'allow') AS n_allow
  FROM cap c JOIN span s ON action = 'add' AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
   AND (h = pattern OR ends_with(h, '.' || pattern) OR (h || p = pattern) OR (ends_with(pattern, '/') AND starts_with(h || p, pattern)))
  GROUP BY c.page_id
)
SELECT c.page_id, url, CAST(fetched_at AS VARCHAR) AS fetched_at, coalesce(n_block, 0) AS n_block, coalesce(n_allow, 0) AS n_allow,
       coalesce(n_block, 0) > 0 AND coalesce(n_allow, 0) = 0 AS blocked
FROM cap c LEFT JOIN hit USING (page_id)
""",
}
