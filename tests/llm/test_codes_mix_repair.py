"""Vector codes, source mixing and conversation repair against SQL, plain loops and enumeration."""

import heapq
import hashlib
import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortline.llm import conversation_repair as cr
from cohortline.llm import queries, vector_codes as vc
from cohortline.llm.mixing import mix
from cohortline.llm.running import running_total, with_lookup
from tools.compare import compare, duck


def same_as_sql(spark, tmp_path, key, name, table):
    pq.write_table(table, os.path.join(tmp_path, f"{name}.parquet"))
    got = compare(spark, duck(str(tmp_path)), key, queries.QUERIES[key], queries.ORACLE[key], str(tmp_path))
    assert got["status"] == "ok", got
    return got["spark_rows"]


def frame(spark, tmp_path, table):
    pq.write_table(table, f"{tmp_path}/frame.parquet")
    return spark.read.parquet(f"{tmp_path}/frame.parquet")


# ── running totals and lookups ──────────────────────────────────────────────

def test_running_totals_within_and_over_groups(spark):
    rnd = random.Random(1)
    rows = [(1 if rnd.random() < 0.6 else rnd.randint(2, 9), i, rnd.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, v bigint").repartition(7)
    want, per = 0, {}
    truth = {}
    for g, i, v in sorted(rows):
        want += v
        per[g] = per.get(g, 0) + v
        truth[i] = (want, per[g])
    over = {r["i"]: r["t"] for r in running_total(df, ["g", "i"], "v", "t").collect()}
    within = {r["i"]: r["t"] for r in running_total(df, ["g", "i"], "v", "t", group="g").collect()}
    assert all(truth[i] == (over[i], within[i]) for i in truth) and len(over) == len(within) == 3000
    assert running_total(df.limit(0), ["g", "i"], "v", "t").count() == 0


def test_lookup_too_large_to_broadcast_gives_the_same_rows(spark, monkeypatch):
    from cohortline.llm import running

    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 5}") for i in range(300)], "id bigint, k string")
    lookup = spark.createDataFrame([(None, 0), *[(f"k{j}", j + 1) for j in range(5)]], "k string, v int")
    small = sorted(map(tuple, with_lookup(rows, lookup, "k", "id").collect()))
    monkeypatch.setattr(running, "MAX_BROADCAST_ROWS", 2)
    large = with_lookup(rows, lookup, "k", "id")
    assert sorted(map(tuple, large.collect())) == small and len(small) == 300


# ── op11 ────────────────────────────────────────────────────────────────────

VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("v", pa.string()), ("code", pa.int32())])


def vector_table(n, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    # third of all rows alike, with ties between equal entries
    rows = [(i, rows[5][1] if i % 3 == 0 else v, x) for i, v, x in rows]
    rows += [(900, None, 1), (901, [None, *rows[0][1][1:]], 1), (902, [float("nan")] * dims, 1), (903, [float("inf"), *rows[0][1][1:]], 1),
             (None, rows[8][1], 2)]
    return pa.Table.from_pylist([dict(zip(VECTORS.names, (*r, "x", 1))) for r in rows], VECTORS)


def test_vector_codes_equal_sql(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "op11_vector_codes", "embeddings", vector_table(400)) == 401


def test_active_entries_equal_full_scans():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x, c = rng.integers(-4, 5, (200, 2)), rng.integers(-4, 5, (12, 2))
        at, dist = vc.nearest(x, c)
        new = np.where(rng.random((12, 1)) < 0.4, rng.integers(-4, 5, (12, 2)), c)
        vc.assign(x, new, (new != c).any(axis=1), at, dist)
        full_at, full = vc.nearest(x, new)
        assert (at == full_at).all() and (dist == full).all()


def test_vector_codes_edges(spark, tmp_path):
    empty = vector_table(20).slice(20, 4)                        # only rows that are dropped
    pq.write_table(empty, f"{tmp_path}/embeddings.parquet")
    assert queries.op11_vector_codes(spark, str(tmp_path)).count() == 0
    assert queries.op11_vector_codes(spark, str(tmp_path)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(3, [1.0, -0.001], 1), (3, [1.0, -0.001], 1), (1, [2.0], None), (2, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["code"], r["error"]) for r in vc.vector_codes(df).collect())
    # shorter vectors are padded: entries in order of ids are (512, 0), (0, 0), (256, -1) twice
    assert got == [(1, "00" * 16, 0), (2, "01" + "00" * 15, 0), (3, "0202" + "00" * 14, 0), (3, "0202" + "00" * 14, 0)]
    with pytest.raises(ValueError, match="64 bits"):
        vc.vector_codes(spark.createDataFrame([(1, [1e12] * 16, 1)], df.schema))


# ── op12 ────────────────────────────────────────────────────────────────────

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
                  ("size", pa.string()), ("target", pa.int32())])


def documents(n, seed=0):
    rnd = random.Random(seed)
    blank = [" ", "  ", "\n", "\t", " x ", "\x0b"]
    rows = []
    for i in range(n):
        words = rnd.choice([0, 1, 3, 10, 40, 400])
        source = "hot" if i % 3 == 0 else rnd.choice([None, "", "a", "b", "é", "z", "Z"])
        rows.append((i, None if i % 29 == 0 else "".join("wé" + rnd.choice(blank) for _ in range(words)), source))
    rows += [rows[4], rows[4], (None, "no id here", "a"), (7777, "alone", "zz-tiny")]
    return pa.Table.from_pylist([dict(zip(("doc_id", "text", "source"), r)) | {"lang": "en", "n_chars": 1, "size": "x", "target": 1} for r in rows], DOCS)


def test_mixing_equals_sql(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "op12_source_mixing", "documents", documents(500)) == 504


def test_mixing_equals_queues_served_one_by_one(spark, tmp_path):
    docs = documents(200, seed=3)
    df = frame(spark, tmp_path, docs)
    got = mix(df).toPandas()
    assert len(got) == docs.num_rows and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].where(got["size"] > 0, 1) == 0).all()
    sources = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert sources.target.sum() == pytest.approx(sources["size"].sum()) and (sources.target <= 3 * sources["size"]).all()
    assert ((sources.taken - sources.target).abs() <= sources.most + 1e-6).all()
    assert sorted(map(str, mix(df.repartition(5)).collect())) == sorted(map(str, mix(df).collect()))
    # a heap of queue heads, one copy at a time
    queues = []
    for _, g in got[got["size"] > 0].groupby("source", dropna=False):
        order = sorted((hashlib.md5(("" if d != d else str(int(d))).encode()).hexdigest(), int(s)) for d, s in zip(g.doc_id, g["size"]))
        queues.append((g.target.iloc[0], [x for _ in range(3) for x in order]))
    heap = [(q[0][1] / t, k, 0, q[0][1]) for k, (t, q) in enumerate(queues)]
    heapq.heapify(heap)
    budget, taken = int(got["size"].sum()), {}
    while heap:
        _, k, i, words = heapq.heappop(heap)
        t, q = queues[k]
        budget -= q[i][1]
        if budget < 0:
            break
        taken[q[i]] = taken.get(q[i], 0) + q[i][1]
        if i + 1 < len(q):
            heapq.heappush(heap, ((words + q[i + 1][1]) / t, k, i + 1, words + q[i + 1][1]))
    assert sum(taken.values()) == got.taken.sum()


def test_mixing_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id bigint, text string, source string")
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mix(df).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mix(df.limit(0)).count() == 0


# ── op13 ────────────────────────────────────────────────────────────────────

def enumerated(rows, entry, goal):
    """Least (cost, audit) over all edit sequences with at most two inserts in a row."""
    best = None

    def go(i, q, cost, audit, inserts):
        nonlocal best
        if i == len(rows) and q in cr._GOALS[goal]:
            best = (cost, audit) if best is None else min(best, (cost, audit))
        if inserts < 2:
            go(i, cr._NEXT[q], cost + 2, audit + "I", inserts + 1)
        if i < len(rows):
            initial, fault, n = rows[i]
            tail = "D" * (n - 1)
            go(i + 1, q, cost + 3 * n, audit + "D" + tail, 0)
            if fault in (cr.OK, cr.TRUNCATED):
                more = 3 * (n - 1) + (fault == cr.TRUNCATED)
                for to, c in ((cr.SYSTEM, "s"), (cr.USER, "u"), (cr.ASSISTANT, "a")):
                    legal = (q == cr.START) if to == cr.SYSTEM else to == cr._NEXT[q]
                    if legal and initial == c:
                        go(i + 1, to, cost + more, audit + "K" + tail, 0)
                    if legal and to != cr.SYSTEM and initial != c:
                        go(i + 1, to, cost + more + 2, audit + "R" + tail, 0)
    go(0, entry, 0, "", 0)
    return best


def test_search_equals_enumeration():
    rnd = random.Random(6)
    for _ in range(250):
        rows = [(rnd.choice("sssuuuaaax "), rnd.choice([cr.OK] * 4 + [cr.BLANK, cr.DUPLICATE, cr.TRUNCATED]), rnd.choice([1, 1, 1, 2])) for _ in range(rnd.randint(0, 4))]
        for entry, goal in itertools.product(cr.STATES, (cr.END, *cr.STATES)):
            assert cr.search(rows, entry, goal) == enumerated(rows, entry, goal), (rows, entry, goal)


CONV = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.string()), ("_c", pa.int32())])


def conversations(seed=0):
    rnd = random.Random(seed)
    said = ["Yes.", "no", "Well! ", "What?\n", " \t", "", None, "a b. c", "Yes."]
    rows = []
    for c in [*range(60), None]:
        for t in range(rnd.randint(1, 9)):
            rows.append((c, rnd.choice([t, t, t, 3 * t]), rnd.choice(["user", "assistant", "system", "tool", "", None]) if rnd.random() < 0.3 else
                         ("user", "assistant")[t % 2], rnd.choice(said)))
    rows += [(7, None, "user", "null turn"), *[(5, t, ("user", "assistant")[(t // 3) % 2], f"text {t % 50}.") for t in range(100, 400)]]   # one long
    rows = list(dict.fromkeys(rows))
    return pa.Table.from_pylist([dict(zip(CONV.names, (*r, "x", 1))) for r in rows], CONV)


def test_repair_equals_sql(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "op13_conversation_repair", "conversations", conversations()) == 61


def test_blocks_of_any_size_give_the_same_repair(spark, tmp_path):
    df = frame(spark, tmp_path, conversations(4))
    rows = cr.damaged(df)
    whole = sorted(map(str, cr.repair_report(df, rows).collect()))
    assert sorted(map(str, cr.repair_report(df, rows, block_rows=3).collect())) == whole
    assert sorted(map(str, cr.repair_report(df.repartition(9), cr.damaged(df.repartition(9)), block_rows=20).collect())) == whole


def test_repair_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.")] * 3 + [(1, 1, "assistant", "Yes.")] * 2 + [(2, 0, None, None)], "conv_id bigint, turn bigint, role string, text string")
    rows = df.selectExpr("conv_id", "turn", "coalesce(role, ' ') role", "coalesce(text, ' ') text", "1L n")
    got = {r["conv_id"]: r for r in cr.repair_report(df, rows).collect()}
    assert (got[1]["audit"], got[1]["duplicate"], got[1]["cost"], got[1]["illegal"]) == ("KDDKD", 3, 9, 3)
    assert got[1]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()
    assert (got[2]["audit"], got[2]["blank"], got[2]["repaired_sha256"]) == ("D", 1, hashlib.sha256(b"").hexdigest())
    turns = [(r["edit"], r["role"], r["text"]) for r in cr.repaired_turns(rows).where("conv = 'c1'").orderBy("part", "block", "place").collect()]
    assert turns == [("K", "user", "Hi."), ("K", "assistant", "Yes.")]
    assert cr.repair_report(df.limit(0), rows.limit(0)).count() == 0
    none = cr.repair_report(df, rows.limit(0)).where("conv_id = 1").first()
    assert (none["gaps"], none["cost"], none["audit"], none["repaired_sha256"]) == (0, 0, "", hashlib.sha256(b"").hexdigest())
