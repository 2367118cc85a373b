"""Read the star-schema parquet tables with only the needed columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

# Parquet schema per (path, file sizes and mtimes): inference reads footers on
# every read; the file-status key keeps a changed file from reusing a schema.
_SCHEMAS: dict[tuple, object] = {}


def hadoop_signature(spark: SparkSession, path: str) -> tuple:
    """(path, ((file, size, mtime), ...)) through Hadoop's FileSystem, so local
    and cluster storage (HDFS, object stores) are handled alike; (path, None)
    when the path does not exist."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return (path, None)
    it = fs.listFiles(hpath, True)
    entries = []
    while it.hasNext():
        st = it.next()
        entries.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return (path, tuple(sorted(entries)))


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    sig = hadoop_signature(spark, path)
    schema = _SCHEMAS.get(sig) if sig[1] is not None else None
    if schema is None:
        df = spark.read.parquet(path)
        if sig[1] is not None:
            _SCHEMAS[sig] = df.schema
    else:
        df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df
