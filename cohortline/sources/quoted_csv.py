"""CSV files with line breaks inside quoted fields and differing headers, read in parallel.

A line break ends a record unless it stands inside quotes, that is, unless the
number of quotes before it in the file is odd.  So large files need not go through one task:

1. The files are read as lines, split by ranges like any text; each range tells its number of
   quotes.  Sums over the ranges of a file (one row per range) tell which ranges begin
   inside a field.
2. With that known each range joins its lines to records on its own.  What a range
   holds of a record that began in an earlier one, or that goes on in a later one, is set
   aside; these pieces (at most two a range) are put together by file.
3. The first record of a file is its header.  Files are grouped by header, and
   each group's records are parsed by Spark's CSV parser with the group's columns.

A quote within an unquoted field counts as a quote; a file whose quotes do not pair up raises.  Blank lines between records are skipped, and a carriage return before a record's end belongs to the break;
inside quotes both stay as they are.  Empty files have no rows.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.functions.joins import MAX_BROADCAST_ROWS, lookup_join
from cohortline.session import scratch_path

MOST_HEADERS = 64
RECORD, HEADER, PIECE_END, PIECE_OPEN = range(4)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, start, quotes``: rows of one range may span batches, sums are added by Spark."""
    for b in batches:
        counts: dict[tuple, int] = {}
        for value, file, start in zip(*(b.column(i).to_pylist() for i in range(3))):
            counts[file, start] = counts.get((file, start), 0) + value.count('"')
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int64()),
                                          pa.array(list(counts.values()), pa.int64())], names=["file", "start", "quotes"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, start, kind, record`` from the lines of whole ranges in order."""
    here, held, inside, kind, out = None, [], False, RECORD, []

    def close(as_kind):
        out.append((*here, as_kind, "\n".join(held)))
        held.clear()

    def batch():
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()))],
                                          names=["file", "start", "kind", "record"])

    for b in batches:
        for value, file, start, begins_inside in zip(*(b.column(i).to_pylist() for i in range(4))):
            if (file, start) != here:
                if held:
                    close(PIECE_OPEN)                  # goes on in the next range
                here, inside = (file, start), begins_inside
                kind = HEADER if start == 0 else PIECE_END if inside else RECORD
            if not inside and not held and not value.strip("\r"):
                continue
            held.append(value)
            if value.count('"') % 2:
                inside = not inside
            if not inside:
                close(kind)
                kind = RECORD
        if out:
            yield batch()
            out.clear()
    if held:
        close(PIECE_OPEN)
    if out:
        yield batch()


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, kind, record`` of all files below ``path`` (``kind`` is RECORD or HEADER)."""
    lines = _lines(spark, path)
    quotes = (lines.mapInArrow(_ranges, "file string, start bigint, quotes bigint")
              .groupBy("file", "start").agg(F.sum("quotes").alias("quotes")))
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = quotes.select("file", "start", (F.coalesce(F.sum("quotes").over(w), F.lit(0)) % 2 == 1).alias("inside"))
    broken = _written(before.where("inside"), "ranges")
    n = broken.count()
    if n > MAX_BROADCAST_ROWS:
        # the join below must keep the lines in order, so this list is handed to every task
        raise ValueError(f"{n} ranges begin inside a quoted field; raise spark.sql.files.maxPartitionBytes")
    known = lines.join(F.broadcast(broken), ["file", "start"], "left").select(
        "value", "file", "start", F.coalesce("inside", F.lit(False)).alias("inside"))
    found = _written(known.mapInArrow(_records, "file string, start bigint, kind int, record string"), "records")
    pieces = found.where(F.col("kind").isin(PIECE_END, PIECE_OPEN))
    # a piece that ends a record closes the open ones before it; a range's end piece stands before its open one
    order = Window.partitionBy("file").orderBy("start", "kind")
    ends = F.coalesce(F.sum((F.col("kind") == PIECE_END).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = (pieces.withColumn("chain", ends).groupBy("file", "chain")
              .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("p")))
    # a record that begins in the first range may be the header, if nothing of that file came before it
    has_header = found.where(F.col("kind") == HEADER).select("file").distinct().withColumn("_has", F.lit(True))
    whole = lookup_join(joined, _written(has_header, "headers"), "file", "chain").select(
        "file", F.when(F.col("_has").isNull() & (F.col("chain") == 0), HEADER).otherwise(RECORD).alias("kind"),
        F.when(F.exists("p", lambda x: x["kind"] == PIECE_END), F.array_join(F.transform("p", lambda x: x["record"]), "\n"))
        .otherwise(F.raise_error(F.concat(F.lit("a quoted field is not closed in "), F.col("file")))).alias("record"))
    return found.where(F.col("kind").isin(RECORD, HEADER)).select("file", "kind", "record").unionByName(whole)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict) -> DataFrame:
    """All CSV files below ``path`` with the columns of ``schema``, matched by each file's header.

    Absent columns are null, unknown or repeated ones raise."""
    unbroken = F.regexp_replace("record", "\r\\z", "")
    rows = _written(records(spark, path).withColumn("record", F.when(F.col("kind") == HEADER, F.ltrim(unbroken, F.lit("\ufeff")))
                                                    .otherwise(unbroken)), "csv-records")
    headers = _written(rows.where(F.col("kind") == HEADER).select("file", F.col("record").alias("header")), "csv-headers")
    kinds = [r["header"] for r in headers.select("header").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers below {path}")
    data = lookup_join(rows.where(F.col("kind") == RECORD), headers, "file", "record")
    out = spark.createDataFrame([], schema)
    for header in sorted(kinds):
        names = next(csv.reader([header]))
        odd = [c for c in names if c not in schema.names]
        if odd or len(set(names)) != len(names):
            raise ValueError(f"unexpected columns in a header below {path}: {odd or names}")
        own = T.StructType([T.StructField(c, schema[c].dataType) for c in names])
        parsed = data.where(F.col("header") == header).select(
            F.from_csv("record", own.simpleString()[7:-1].replace(":", " "), {**options, "mode": "FAILFAST", "multiLine": "true"}).alias("r"))
        out = out.unionByName(parsed.select(*[F.col("r")[c].alias(c) if c in names else F.lit(None).cast(schema[c].dataType).alias(c)
                                              for c in schema.names]))
    return out
