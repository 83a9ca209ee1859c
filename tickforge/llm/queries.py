"""Queries of the text operators and their SQL."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_words, host_paths, merkle_audit, odd_sketch, quality_fm, repair_store, robust_outliers, template_leaks, token_counts, unit_dedup, warc
from .shared import table, work_dir


def op1_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair_store.store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return repair_store.facts(spark, path)


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust_outliers.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unit_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept FROM s JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) ON x = doc_id
"""


def damaged(key: Column, record: Column) -> Column:
    """A replica's record: of 101 keys one has another byte, one lacks nine bytes of its body, and one record is gone (null)."""
    flipped = F.concat(F.substring(record, 1, 20), F.lit("#"), record.substr(F.lit(22), F.length(record)))
    short = F.concat(record.substr(F.lit(1), F.length(record) - 13), F.lit("\r\n\r\n"))
    rest = F.pmod(key, F.lit(101))
    return F.when(rest == 7, flipped).when(rest == 42, short).when(rest != 77, record)


DATE = "2024-01-01T00:00:00Z"


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity of every record against the WARC files of a damaged replica: its place in key order, what was found, and
    whether the descent came down to it."""
    pages = table(spark, sf_dir, "pages").where("page_id IS NOT NULL")
    record_id = F.concat(F.lit("urn:page:"), F.col("page_id").cast("string"))
    record, files = warc.response(record_id, F.col("url"), F.col("html"), DATE), work_dir(spark, "warc-replica")
    warc.write(damaged(F.col("page_id"), record), pages, files)
    good = merkle_audit.Tree(pages.select(F.col("page_id").alias("key"), record.alias("record")))
    key = F.regexp_extract("record_id", "^urn:page:(-?[0-9]+)$", 1).cast("long").alias("key")
    other = merkle_audit.Tree(warc.read(spark, files).select(key, "digest", "size"), digest=F.col("digest"), size=F.col("size"))
    segments, _ = merkle_audit.descend(good, other)
    out = merkle_audit.offsets(good).withColumn("node", F.floor(F.col("key") / merkle_audit.SEGMENT))
    out = out.join(merkle_audit.findings(good, other, segments), "key", "left").join(segments.withColumn("compared", F.lit(True)), "node", "left")
    return out.select(F.col("key").alias("page_id"), "start", F.col("size").alias("length"), F.col("digest").alias("sha256"), F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("compared", F.lit(False)).alias("compared"))


OP8_SQL = """
WITH h AS (
  SELECT page_id, url, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS http
  FROM pages WHERE page_id IS NOT NULL),
r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Date: DATE' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, 'urn:page:' || page_id) || chr(13) || chr(10)
    || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(http) || chr(13) || chr(10) || chr(13) || chr(10)
    || http || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    CASE page_id % 101 WHEN 7 THEN 'corrupt' WHEN 42 THEN 'corrupt' WHEN 77 THEN 'missing' ELSE 'ok' END AS status
  FROM h)
SELECT page_id,
  CAST(sum(strlen(record)) OVER (ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(record) AS BIGINT) AS start,
  CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha256, status,
  bool_or(status <> 'ok') OVER (PARTITION BY page_id // 256) AS compared
FROM r
""".replace("DATE'", f"{DATE}'")


def op9_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe_words.decode(bpe_words.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    out = quality_fm.classify(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality_fm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_repair_store": op1_repair_store,
    "op2_robust_outliers": op2_robust_outliers,
    "op3_unit_dedup": op3_unit_dedup,
    "op4_template_leaks": op4_template_leaks,
    "op5_token_counts": op5_token_counts,
    "op6_host_paths": op6_host_paths,
    "op7_odd_sketch": op7_odd_sketch,
    "op8_merkle_audit": op8_merkle_audit,
    "op9_bpe_words": op9_bpe_words,
    "op10_quality_fm": op10_quality_fm,
}
ORACLE_SQL = {"op7_odd_sketch": OP7_SQL, "op8_merkle_audit": OP8_SQL}
