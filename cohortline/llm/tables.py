"""Reading the training-data tables and cutting lineage through shared storage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id bigint, text string)`` and nothing else: other columns of the
    input, whatever their names, never reach an operator.  Null text is empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the cluster's shared checkpoint
    folder and read back: later jobs restart from the files when executors go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows handed to a Python worker at a time where executors' memory is tight.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers in batches of about ``BATCH_BYTES`` from now on, unless the session has a limit of its own.

    By default a batch is 10,000 rows, some 30 MB of long texts, of which a task holds several copies outside
    the heap: in Spark's buffers, in the worker's and as Python strings, before and after the operator."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def key_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Split sorted batches into one table per run of equal leading key columns.

    Runs may span batches; the caller sizes them (blocks of a bounded number of rows)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        start = 0
        for i, key in enumerate(keys):
            if key != last:
                if last is not None:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield pa.Table.from_batches(held)
                    held, start = [], i
                last = key
        if start < len(keys):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
