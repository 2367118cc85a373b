"""Registered queries of the training-data operators: thin digests over the
operators' own outputs, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import html_extract, license_scan, segment
from cohortline.llm.conversation_repair import damaged, repair_report
from cohortline.llm.cotrain import quality
from cohortline.llm.decontaminate import leaks
from cohortline.llm.exact_dedup import exact_dedup
from cohortline.llm.mixing import mix
from cohortline.llm.near_dup import near_duplicates
from cohortline.llm.pseudo_likelihood import pseudo_likelihood
from cohortline.llm.sql_codes import CODES_SQL
from cohortline.llm.sql_mix import MIX_SQL
from cohortline.llm.sql_repair import REPAIR_SQL
from cohortline.llm.tables import table
from cohortline.llm.toxicity import toxicity
from cohortline.llm.url_filter import filter_urls, split_url
from cohortline.llm.vector_codes import vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_SQL = f"""
WITH d AS (SELECT doc_id, {_ASCII_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""


@register("op6_exact_dedup", EXACT_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


# ── op5 ─────────────────────────────────────────────────────────────────────

#: the list: URLs of pages on hosts with a label that starts with ``spam-``
SPAM_HOST = r"(^|\.)spam-"

URL_SQL = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
s AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canon FROM s),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)spam-')),
r AS (
  SELECT c.page_id, c.host, c.path, l.canon IS NOT NULL AS listed,
         CASE WHEN ('.' || c.host) LIKE '%.example.com' AND starts_with(c.path, '/de/') THEN 'example.com/de/'
              WHEN ('.' || c.host) LIKE '%.example.net' AND starts_with(c.path, '/en/') THEN 'example.net/en/'
              WHEN ('.' || c.host) LIKE '%.org' AND starts_with(c.path, '/fr/') THEN 'org/fr/'
              WHEN ('.' || c.host) LIKE '%.net' AND starts_with(c.path, '/') THEN 'net/' END AS rule
  FROM c LEFT JOIN l ON c.canon = l.canon)
SELECT page_id, host, path, rule, listed,
       CASE rule WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
                 WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
                 ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict
FROM r
""".replace("\\\\", "\\")


@register("op5_url_filter", URL_SQL)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").where(split_url(F.col("url"))[0].rlike(SPAM_HOST))
    return filter_urls(pages, listed)


# ── op10 ────────────────────────────────────────────────────────────────────

@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ── op7 ─────────────────────────────────────────────────────────────────────

@register("op7_benchmark_decontamination")
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").alias("n_leaks"),
                        F.array_sort(F.array_distinct("item_ids")).alias("item_ids"),
                        # each leak with its item, in the order found
                        F.arrays_zip(F.col("item_ids").alias("item_id"), F.col("starts").alias("start"), F.col("ends").alias("end"),
                                     F.col("edits")).alias("leaks"))


# ── op3 ─────────────────────────────────────────────────────────────────────

@register("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.encode(table(spark, sf_dir, "documents"), segmentations=True)


# ── op2 ─────────────────────────────────────────────────────────────────────

@register("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


# ── op4 ─────────────────────────────────────────────────────────────────────

@register("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no paths: source, language and thousands of ids stand for directories
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"),
                       F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.license_scan(table(spark, sf_dir, "documents"), path)


# ── op8, op9 ────────────────────────────────────────────────────────────────

@register("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


@register("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ── op1 ─────────────────────────────────────────────────────────────────────

@register("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# ── op12 ────────────────────────────────────────────────────────────────────

@register("op12_source_mixing", MIX_SQL)
def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


# ── op11 ────────────────────────────────────────────────────────────────────

@register("op11_vector_codes", CODES_SQL)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


# ── op13 ────────────────────────────────────────────────────────────────────

@register("op13_conversation_repair", REPAIR_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))
