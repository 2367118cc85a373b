"""CSV records across file ranges against pandas."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import types as T

from cohortline import schema as S
from cohortline.session import scratch_path
from cohortline.sources import files as IO
from cohortline.sources import quoted_csv as Q

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in "abc"])
OPTIONS = {"nullValue": "\\N", "escape": '"'}


def folder(spark, **texts):
    path = scratch_path(spark, "quoted").replace("file:", "")
    os.makedirs(path)
    for name, text in texts.items():
        with open(f"{path}/{name}.csv", "w", newline="") as f:
            f.write(text)
    return path


def table(n, seed, columns, end="\n"):
    rnd = random.Random(seed)
    parts = ["x", "two words", 'say ""hi""', "line\nbreak", "\r\nboth\r\n", ",", "", "é 😀", "\n\n\n", "long " * 30, '""', "\r"]

    def field():
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 3)))
        return f'"{s}"' if s and (set(s) & set(',"\r\n') or rnd.random() < 0.3) else s or "q"
    return end.join([",".join(columns), *(",".join(field() for _ in columns) for _ in range(n))]) + (end if seed % 2 else "")


@pytest.mark.parametrize("range_bytes", [150, 1 << 20])
def test_records_of_all_ranges_equal_pandas(spark, range_bytes):
    texts = {"one": table(60, 1, "abc"), "two": table(25, 2, "cab", "\r\n"), "three": table(10, 3, "ca"), "none": "", "bare": "a,b,c",
             "gaps": 'a,b,c\n\n1,"2\n\n",3\n\n\n4,5,6'}
    path = folder(spark, **texts)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = Q._lines(spark, path)
        if range_bytes < 1000:
            assert lines.select("file", "start").distinct().count() > 20 and lines.rdd.getNumPartitions() > 20
        got = Q.read_csv(spark, path, SCHEMA, OPTIONS).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    frames = [pd.read_csv(f"{path}/{n}.csv", dtype=str, keep_default_na=False, engine="python") for n in texts if n != "none"]
    want = pd.concat(frames)[list("abc")].astype(object).where(lambda d: d.notna(), None)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.itertuples(index=False, name=None)))


def test_a_header_may_span_ranges_and_bad_files_raise(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5)
    try:
        one = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b\nb")])
        path = folder(spark, x='a,"b\nb"\n1,2\n')
        assert Q.records(spark, path).where("kind = 1").first()["record"] == 'a,"b\nb"'
        with pytest.raises(Exception):
            Q.read_csv(spark, folder(spark, x='a,b\n1,"open\n2,3\n'), SCHEMA, OPTIONS).collect()
        with pytest.raises(ValueError, match="unexpected"):
            Q.read_csv(spark, folder(spark, x="a,z\n1,2\n"), SCHEMA, OPTIONS)
        assert len(one) == 2 and Q.read_csv(spark, folder(spark, x=""), SCHEMA, OPTIONS).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_same_rows_as_the_plain_reader(spark, make_raw):
    df = make_raw([{"customer_city": 'a "b", c\\'}, {"incentive_promo_code": ""}, {}, {"customer_city": " blanks "}])
    path = scratch_path(spark, "plain")
    IO.write_csv(df, path)
    assert sorted(map(str, IO.read_raw_csv_any(spark, path).collect())) == sorted(map(str, IO.read_raw_csv(spark, path).collect()))
    assert IO.read_raw_csv_any(spark, path).schema == S.RAW_SCHEMA
