"""Incremental ingest of raw order files equals the batch cleaning."""

import pytest

from cohortline.operators.cleaning import clean_orders, merge_files
from cohortline.session import scratch_path
from cohortline.sources import files as IO
from cohortline.sources.fixture import city_country_lookup, raw_files
from cohortline.streaming import ingest_once
from tests.conftest import SF_SMALL


def test_ingest_matches_batch_and_rejects_repeats(spark):
    hist, recent = raw_files(spark, SF_SMALL)
    raw_dir = scratch_path(spark, "stream_raw")
    IO.write_csv(hist, raw_dir + "/hist")
    IO.write_csv(recent, raw_dir + "/recent")
    # the file source reads one folder: move both writes' part files under it
    import glob, os, shutil
    land = raw_dir.replace("file:", "") + "/landing"
    os.makedirs(land)
    for i, f in enumerate(sorted(glob.glob(raw_dir.replace("file:", "") + "/*/part-*.csv"))):
        shutil.copy(f, f"{land}/part-{i:03d}.csv")
    lookup = city_country_lookup(spark, SF_SMALL)
    out = scratch_path(spark, "stream_out")
    ckpt = scratch_path(spark, "stream_ckpt")
    got = ingest_once(spark, land, out, lookup, ckpt)
    want = clean_orders(IO.read_raw_csv(spark, land), lookup)
    assert got.count() == merge_files(hist, recent).count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

    # a later file repeating known ids is refused and nothing is appended
    shutil.copy(f"{land}/part-000.csv", f"{land}/part-999.csv")
    before = spark.read.parquet(out).count()
    with pytest.raises(Exception, match="already in the table"):
        ingest_once(spark, land, out, lookup, ckpt)
    assert spark.read.parquet(out).count() == before
