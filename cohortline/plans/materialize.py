"""Write-once cleaned table shared by the marts of one session."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortline import schema as S
from cohortline.operators.quality import critical_counts, raise_on_critical
from cohortline.session import scratch_path

# star-schema files the cleaned table is derived from
SOURCE_TABLES = ("orders", "customer", "nation", "region")

_WRITTEN: dict[tuple, str] = {}


def _signature(spark: SparkSession, sf_dir: str) -> tuple:
    """Session + every input file's (path, size, mtime), via Hadoop's FileSystem."""
    from cohortline.sources.testdata import hadoop_signature

    files = tuple(hadoop_signature(spark, os.path.join(sf_dir, f"{t}.parquet")) for t in SOURCE_TABLES)
    return (spark.sparkContext.applicationId, sf_dir, files)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (local or cluster storage)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def materialize_clean(spark: SparkSession, sf_dir: str, build: Callable[[], DataFrame],
                      checks: bool = True) -> DataFrame:
    """Write ``build()`` once per (session, input files) and return a scan of it.

    The write is a distributed Parquet write to the cluster's checkpoint
    folder (lineage is cut there, so a lost executor re-reads files instead
    of recomputing the joins).  Critical checks run on the written table.
    """
    key = _signature(spark, sf_dir)
    path = _WRITTEN.get(key)
    if path is not None and not path_exists(spark, path + "/_SUCCESS"):
        path = None  # the folder was cleared: rebuild
    if path is None:
        path = scratch_path(spark, "cleaned_orders")
        build().write.mode("overwrite").parquet(path)
        if checks:  # duplicate ids / null keys raise; the full report is its own query
            raise_on_critical(critical_counts(spark.read.parquet(path)))
        _WRITTEN[key] = path
    return spark.read.schema(S.CLEAN_SCHEMA).parquet(path)
