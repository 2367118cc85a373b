"""The corpus pipeline's stages: every row's own fate, odd rows, clashing names, brute force."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from cohortline.llm.tables import table
from cohortline.session import scratch_path
from tests.conftest import SF_MID

NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, gone_id string, gone_text int, row_number string, gone_row int, class_id string, n int, k1 string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "r", 2, "c", 3, "k") for i, t in rows], NAMES)


def prose(n, seed):
    rnd = random.Random(seed)
    return [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 999)}" for _ in range(n)]


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_exact_dedup_decides_by_row(spark):
    rows = [(1, "Same"), (2, "sAME"), (2, "other"), (3, "other"), (None, "same"), (None, "lone"), (None, "lone"), (4, None), (5, ""), (6, "É"), (7, "é")]
    got = kept(cp.exact_dedup_stage(spark, docs_of(spark, rows), None))
    want = [(2, "sAME"), (3, "other"), (None, "lone"), (None, "lone"), (5, ""), (6, "É"), (7, "é")]
    assert got == sorted(want, key=repr)
    assert cp.exact_dedup_stage(spark, docs_of(spark, rows), None).columns == docs_of(spark, rows).columns


def near(a, b):
    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    x, y = grams(a), grams(b)
    return bool(x) and bool(y) and len(x & y) >= 0.8 * len(x | y)


def test_near_duplicates_decide_by_row(spark):
    rnd = random.Random(2)
    rows = []
    for base in range(10):
        w = prose(90, base)
        for _ in range(rnd.randint(1, 5)):
            v = list(w)
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(len(v))] = f"new{rnd.randint(0, 9999)}"
            rows.append((rnd.randint(0, 30), " ".join(v)))                 # ids repeat with different texts
    rows += [(None, rows[0][1]), (None, rows[0][1] + " more"), (None, "alone here"), (None, None), (3, ""), (8, rows[5][1]), (8, rows[5][1])]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i][1], rows[j][1]) or (rows[i][1] and rows[i][1] == rows[j][1]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = []
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g]
        least = min((i is None, i or 0) for i, _ in members)
        want.append({(i, t) for i, t in members if (i is None, i or 0) == least})
    got = kept(cp.ngram_jaccard_stage(spark, docs_of(spark, rows), None))
    assert len(got) == len(want) and all(sum(r in w for r in got) >= 1 for w in want)
    assert all(r in set().union(*want) for r in got)


def test_stages_pass_empty_tables_and_odd_rows(spark, tmp_path):
    rows = [(1, None), (None, None), (2, ""), (3, " \n "), (4, "x" * 20_000), (5, "y " * 20_000), (6, "clean words stand here"), (6, "clean words stand here")]
    df = docs_of(spark, rows)
    for name in ("labels", "benchmark"):
        table(spark, SF_MID, name).write.parquet(f"{tmp_path}/{name}.parquet")
    labels = table(spark, SF_MID, "labels")
    assert labels.columns
    for docs in (df, df.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= docs.count()
            if name != "sentencepiece":
                assert out.columns == docs.columns, name
    text = kept(cp.decontamination_stage(spark, df, str(tmp_path)))
    assert (6, "clean words stand here") in text


def test_run_keeps_what_the_stages_keep(spark, tmp_path):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    benchmark = table(spark, SF_MID, "benchmark")
    item = benchmark.where("length(text) > 60").orderBy("item_id").first()["text"]
    planted = [(900_001, "a fresh beginning of words " + item + " and an end"), (900_002, "Wholly New Words That Nobody Else Has Written"),
               (900_003, "wholly new words that nobody else has written")]
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted], docs.schema)
    docs.limit(150).unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path))
    ids = [r["doc_id"] for r in got.collect()]
    assert 900_001 not in ids and 900_003 in ids and 900_002 not in ids and len(ids) == len(set(ids)) > 50
    # the same stage by stage, each on what the one before has kept
    step = table(spark, str(tmp_path), "documents")
    for name, stage in cp.STAGES:
        path = scratch_path(spark, name)
        stage(spark, step, str(tmp_path)).write.parquet(path)
        step = spark.read.parquet(path)
    assert sorted(r["doc_id"] for r in step.collect()) == sorted(ids)
    assert got.where(~F.col("round_trip")).count() == 0


def test_stages_bound_the_batches_of_python_workers(spark):
    from cohortline.llm.tables import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    rows = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 3000) AS text")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        spark.conf.unset(key)
        cp.sentencepiece_stage(spark, rows, "")
        assert max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) < 2 * BATCH_BYTES
        spark.conf.set(key, "1000000")
        cp.sentencepiece_stage(spark, rows, "")
        assert spark.conf.get(key) == "1000000"                # the session's own limit stays
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
