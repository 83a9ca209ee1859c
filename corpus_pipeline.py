"""A training corpus from `documents`, in stages that each call one operator of tickforge.llm.

A stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; all but the last return the
columns of documents. Rows with a null doc_id pass the stages that decide by doc_id; rows that repeat a doc_id
go or stay together.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import bpe_words, odd_sketch, quality_fm, template_leaks, unit_dedup
from tickforge.llm.shared import spread_join, table, written

#: Not expressible in SQL: a fitted model decides the first stage.
ORACLE_SQL = None


#: Dropped ids that are broadcast at most; with more, documents are joined by doc_id, those of a hot one dealt to several tasks.
MAX_BROADCAST = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = written(ids.select("doc_id").where("doc_id IS NOT NULL").distinct(), "dropped")
    if ids.count() <= MAX_BROADCAST:
        return docs.join(F.broadcast(ids), "doc_id", "left_anti").select(*docs.columns)
    named = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("mark"), F.struct(*docs.columns).alias("row"))
    rest = spread_join(named, ids, ["doc_id"], named.count(), "mark", "left_anti")
    return rest.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs don't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the factorisation machine scores below 0.5."""
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    score = _free(docs, "score")
    return quality_fm.classify(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group linked by a similarity of 0.8 on five-word shingles."""
    return _without(docs, odd_sketch.near_duplicates(docs, n=5, percent=80).where("NOT kept"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines and passages that an earlier document has; n_chars follows the text."""
    removed = _free(docs, "removed")
    out = unit_dedup.dedup(docs, into=removed)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak a benchmark item."""
    return _without(docs, template_leaks.leaks(docs, table(spark, sf_dir, "benchmark")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe_words.decode(bpe_words.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
