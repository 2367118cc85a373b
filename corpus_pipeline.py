"""Corpus pipeline: from raw documents to token ids, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet in the shared checkpoint folder and read again as the next
stage's input, so a lost executor costs at most the stage it worked on.  All but the last
return the columns of ``documents`` as they were (further columns too).

1. toxicity: documents that the classifier rejects go.
2. exact_dedup: of equal texts the largest ``doc_id`` stays.
3. ngram_jaccard: of each near-duplicate class the least ``doc_id`` stays.
4. decontamination: documents that hold a benchmark item go.
5. sentencepiece: ids, scores and round trip of every document that is left.

Every row has its own fate, whatever its id: exact dedup decides by (id, digest of the
text), near duplicates by a number that each row gets.  Rows of equal text and equal id are one
document to exact dedup and stay together there; the next stage leaves one of them.  Of equal texts, rows
without id go if a row with an id is there and stay otherwise; of near duplicates a row with an id stays before one without.
Further columns, whatever their names, pass through; an empty table passes through as empty.

Stages leave a limit of bytes for the batches of Python workers in the session (``bound_batches``), as they run after
they return; a limit that the session has already stays.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.joins import MAX_BROADCAST_ROWS
from cohortline.llm import segment
from cohortline.llm.decontaminate import drop_contaminated
from cohortline.llm.exact_dedup import exact_dedup
from cohortline.llm.near_dup import near_duplicates
from cohortline.llm.tables import bound_batches, table, written
from cohortline.llm.toxicity import drop_toxic, fit


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def _sized(dropped: DataFrame) -> DataFrame:
    """A written list of rows to drop, broadcast if it is small and joined as it is if not."""
    return F.broadcast(dropped) if dropped.count() <= MAX_BROADCAST_ROWS else dropped


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    gone_id, gone_text = _fresh(docs, "gone_id"), _fresh(docs, "gone_text")
    gone = (exact_dedup(docs).where("keep_id IS NOT NULL AND NOT doc_id <=> keep_id")
            .select("doc_id", "text_sha256").distinct().toDF(gone_id, gone_text))
    normal = F.translate(F.coalesce(docs["text"].cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col(gone_id)) & (F.sha2(normal.cast("binary"), 256) == F.col(gone_text))
    return docs.join(_sized(written(gone, "pipeline-gone")), same, "left_anti")


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    doc_id = F.col("doc_id").cast("bigint")
    repeated = docs.select(doc_id.alias("doc_id")).groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    row = _fresh(docs, "row_number")
    # ids that name their rows serve as they are; else the rows get numbers, fixed by writing them
    numbered = (docs.withColumn(row, doc_id) if repeated.isEmpty()
                else written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-numbered"))
    classes = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("n"), "class_id")
    ids = numbered.select(F.col(row).alias("n"), doc_id.alias("doc_id"))
    # classes of one row need no look at their ids
    classes = written(classes, "pipeline-classes")
    several = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    members = written(classes.join(several, "class_id").join(ids, "n"), "pipeline-members")
    stays = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("n")))["n"].alias("n"))
    gone = members.join(stays, "n", "left_anti").select(F.col("n").alias(gone_row := _fresh(numbered, "gone_row")))
    return numbered.join(_sized(written(gone, "pipeline-gone")), numbered[row] == F.col(gone_row), "left_anti").drop(row)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return segment.encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

ORACLE_SQL = None    # a trained classifier, min-hashes and a piece lattice: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
