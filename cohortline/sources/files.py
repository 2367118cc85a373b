"""CSV and Parquet readers/writers for raw and cleaned order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline import schema as S
from cohortline.sources import quoted_csv

# '' and null must survive a CSV round trip: nulls are written as \N and
# only \N is read back as null, so an empty promo code stays ''.
NULL_TOKEN = "\\N"


# a quote inside a quoted field is doubled, on both sides
CSV_OPTIONS = {"header": True, "nullValue": NULL_TOKEN, "escape": '"'}


def _read_by_header(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """CSV file(s) whose columns are matched to ``schema`` by header name.

    Columns may come in any order; absent ones become null and unknown or repeated
    ones raise.  All files under ``path`` must share one header: Spark checks each
    file's header against the first one's and raises where they differ.
    ``multi_line`` accepts line breaks inside quoted fields; such files can't be
    split, so it is off unless asked for (a line break then raises as malformed).
    """
    reader = spark.read.options(**CSV_OPTIONS, multiLine=multi_line)
    names = reader.csv(path).columns
    unknown = [c for c in names if c not in schema.names]
    if unknown:
        raise ValueError(f"unexpected columns in the header of {path}: {unknown}")
    if not names:
        return spark.createDataFrame([], schema)
    found = T.StructType([schema[c] for c in names])
    df = (reader.schema(found).option("enforceSchema", False).option("mode", "FAILFAST")
          .option("dateFormat", "yyyy-MM-dd").csv(path))
    return df.select(*[F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw order file(s), columns by header name, every field read as text."""
    return _read_by_header(spark, path, S.RAW_SCHEMA, multi_line)


def read_raw_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """Raw order files whose headers may differ and whose quoted fields may hold line breaks; large
    files are split all the same (:mod:`cohortline.sources.quoted_csv`)."""
    return quoted_csv.read_csv(spark, path, S.RAW_SCHEMA, {"nullValue": NULL_TOKEN, "escape": '"'})


def load_raw(spark: SparkSession, hist_path: str, recent_path: str,
             multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    return read_raw_csv(spark, hist_path, multi_line), read_raw_csv(spark, recent_path, multi_line)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with header CSV parts (a distributed write, no driver funnel)."""
    (df.write.mode("overwrite").options(**CSV_OPTIONS)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def read_clean_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Cleaned table from CSV, columns by header name, with the typed 19-column schema."""
    return _read_by_header(spark, path, S.CLEAN_SCHEMA, multi_line)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", partition_by_year: bool = False) -> None:
    """Persist the cleaned table (Parquet by default, CSV on request)."""
    if fmt == "csv":
        write_csv(df, path)
        return
    w = df
    if partition_by_year:
        w = df.withColumn("year", F.year(S.DATE))
    writer = w.write.mode("overwrite")
    if partition_by_year:
        writer = writer.partitionBy("year")
    writer.parquet(path)


def read_clean(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return read_clean_csv(spark, path)
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Cleaned orders registered in the catalog under ``name`` (a parameter,
    e.g. ``project.dataset.orders_merged``)."""
    return spark.table(name)


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v-"))


def _quoted(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def publish_table(df: DataFrame, name: str, path: str, comment: str | None = None, properties: dict[str, str] | None = None,
                  check: Callable[[DataFrame], None] | None = None, keep: int = 3) -> DataFrame:
    """Publish ``df`` as catalog table ``name`` whose data lie below ``path``, all or nothing.

    The rows are written into a new folder ``v-N``, read back and handed to ``check``, which
    raises to refuse them; only then does one catalog statement point the table there, together with
    a comment and lineage, refresh, lag and owner properties set right after it.  Readers see the old
    version or the new one, never a part; a failed write or check leaves the table as it
    was.  A changed schema is refused.  The last ``keep`` versions stay for readers that still
    hold an older one."""
    spark, path = df.sparkSession, path.rstrip("/")
    number = max(_versions(spark, path), default=0) + 1
    folder = f"{path}/v-{number:06d}"
    df.write.parquet(folder)
    written = spark.read.schema(df.schema).parquet(folder)
    if check is not None:
        check(written)
    if spark.catalog.tableExists(name):
        old = [(f.name, f.dataType) for f in spark.table(name).schema]
        if old != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"{name} has other columns: {old}")
        spark.sql(f"ALTER TABLE {name} SET LOCATION {_quoted(folder)}")
        spark.catalog.refreshTable(name)
    else:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION {_quoted(folder)}")
    # "owner" is reserved by Spark (set to the current user): keep ours apart
    props = {("data_owner" if k == "owner" else k): v for k, v in (properties or {}).items()}
    props["version"] = str(number)
    if comment:
        props["comment"] = comment
    kv = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in props.items())
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({kv})")
    current = published_version(spark, name)
    for old_version in [v for v in _versions(spark, path) if v < current][: -(keep - 1) or None]:
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v-{old_version:06d}")
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    return spark.table(name)


def published_version(spark: SparkSession, name: str) -> int:
    """Number of the version that the table ``name`` points to."""
    rows = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").collect()
    return int(rows[0]["data_type"].rstrip("/").rsplit("v-", 1)[1])


def table_properties(spark: SparkSession, name: str) -> dict[str, str]:
    """Table properties plus the table comment (under ``comment``)."""
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    desc = spark.catalog.getTable(name).description
    if desc is not None:
        props["comment"] = desc
    return props
