"""Incremental ingest: raw order CSV files arriving in a folder -> cleaned table.

The same row-local cleaning as the batch path (date parse, city lookup as a
stream-static join, promo/strings/amounts, USD columns) runs on each micro-batch.
``foreachBatch`` writes the cleaned batch to a staging folder, checks what was
written and publishes it as the folder ``ingest_batch=<id>`` of the table:

* duplicate ``order_uuid`` inside the batch, and (optionally) ids that *other*
  batches already hold: a left-semi join on the id column;
* null key columns.

A failing batch raises, so the query stops without publishing it.  A batch that is
replayed after a lost driver replaces its own folder, so nothing is added twice.
The header of each file must list the raw columns in order; other headers raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortline import schema as S
from cohortline.operators.cleaning import DataQualityError, clean_orders
from cohortline.operators.quality import critical_counts, raise_on_critical
from cohortline.plans.materialize import path_exists
from cohortline.session import scratch_path
from cohortline.sources.files import CSV_OPTIONS

BATCH = "ingest_batch"


def raw_stream(spark: SparkSession, raw_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.schema(S.RAW_SCHEMA).options(**CSV_OPTIONS)
              .option("enforceSchema", False).option("mode", "FAILFAST"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(raw_dir)


def _batches(spark: SparkSession, out_path: str) -> DataFrame:
    schema = T.StructType([*S.CLEAN_SCHEMA.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(schema).parquet(out_path)


def ingested(spark: SparkSession, out_path: str) -> DataFrame:
    """The cleaned table with the rows of every published batch."""
    return _batches(spark, out_path).select(*S.CLEAN_COLUMNS)


def append_checked_batch(batch: DataFrame, batch_id: int, out_path: str, check_existing: bool = True) -> None:
    """Stage, check and publish one cleaned micro-batch under its id."""
    spark = batch.sparkSession
    staging = scratch_path(spark, "ingest_batch")
    batch.write.parquet(staging)
    staged = spark.read.schema(S.CLEAN_SCHEMA).parquet(staging)
    raise_on_critical(critical_counts(staged), " in micro-batch")
    if check_existing and path_exists(spark, out_path):
        seen = _batches(spark, out_path).where(F.col(BATCH) != batch_id).select(S.ORDER)
        if not staged.select(S.ORDER).join(seen, S.ORDER, "left_semi").isEmpty():
            raise DataQualityError("micro-batch brings order ids that are already in the table")
    staged.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/{BATCH}={batch_id}")


def start_clean_ingest(spark: SparkSession, raw_dir: str, out_path: str, lookup: DataFrame | None = None,
                       checkpoint: str | None = None, available_now: bool = True,
                       check_existing: bool = True) -> StreamingQuery:
    """Start the ingest query; ``available_now`` processes what is there and stops.

    ``checkpoint`` defaults to a folder beside the table that belongs to it, so a
    later call goes on after the files that earlier calls have read."""
    cleaned = clean_orders(raw_stream(spark, raw_dir), lookup, guard_keys=False)
    writer = (cleaned.writeStream
              .foreachBatch(lambda df, batch_id: append_checked_batch(df, batch_id, out_path, check_existing))
              .option("checkpointLocation", checkpoint or out_path.rstrip("/") + "-ingest-checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def ingest_once(spark: SparkSession, raw_dir: str, out_path: str, lookup: DataFrame | None = None,
                checkpoint: str | None = None) -> DataFrame:
    """Process all files currently in ``raw_dir`` and return the cleaned table."""
    q = start_clean_ingest(spark, raw_dir, out_path, lookup, checkpoint)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return ingested(spark, out_path)
