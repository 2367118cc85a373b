"""The training-data operators on small fixtures against brute force, round trips and
hand-made cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.llm import decontaminate, dom, html_extract, license_scan, near_dup, segment, toxicity
from cohortline.llm import url_filter as UF
from cohortline.llm.cotrain import quality
from cohortline.llm.exact_dedup import exact_dedup
from cohortline.llm.pseudo_likelihood import pseudo_likelihood
from cohortline.llm.quotient_filter import CountingQuotientFilter, split_blocks

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, keep_id int"


def docs_of(spark, texts, lang="en"):
    """Documents with two more columns that clash with names used inside."""
    rows = [(i, t, lang, f"s{i % 3}", len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed):
    rnd = random.Random(seed)
    return [rnd.choice("abcdefghij") + rnd.choice("aeiou") + str(rnd.randint(0, 99)) for _ in range(n)]


def test_quotient_filter_merges_losslessly():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 2**63, 500, dtype=np.uint64) >> np.uint64(rng.integers(0, 3)) for _ in range(4)]
    parts[1][:100] = parts[0][:100]
    by_block = {}
    for p in parts:
        for f in split_blocks(p, 6):
            by_block.setdefault(f.block, []).append(CountingQuotientFilter.unpack(6, f.pack()))
    got = {}
    for fs in by_block.values():
        fp, n = CountingQuotientFilter.merge(fs).decode()
        got.update(zip(fp.tolist(), n.tolist()))
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert got == dict(zip(values.tolist(), counts.tolist()))


def test_exact_dedup_edges(spark):
    texts = ["Abc", "aBC", None, "", "É", "é", "x" * 50_000, "X" * 50_000, "one"]
    got = {r["doc_id"]: r for r in exact_dedup(docs_of(spark, texts)).collect()}
    assert [got[i]["keep_id"] for i in range(9)] == [1, 1, 3, 3, 4, 5, 7, 7, 8]
    assert [got[i]["group_size"] for i in range(9)] == [2, 2, 2, 2, 1, 1, 2, 2, 1]
    assert got[0]["text_sha256"] == hashlib.sha256(b"abc").hexdigest() and not got[0]["kept"] and got[1]["kept"]
    assert exact_dedup(docs_of(spark, ["a"]).limit(0)).count() == 0


def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset([tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", "...", "one two", "One, two!", " ".join(words(4000, 99))]
    for base in range(12):
        w = words(120, base)
        for _ in range(rnd.randint(1, 9)):
            v = list(w)
            for _ in range(rnd.randint(0, 4)):
                v[rnd.randrange(len(v))] = f"new{rnd.randint(0, 9999)}"
            texts.append(" ".join(v))
    texts += texts[6:9]
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    partners = [set() for _ in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
            if sets[a] != sets[b]:
                partners[a].add(sets[b])
                partners[b].add(sets[a])
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == [root(i) for i in range(len(texts))]
    assert [got[i]["n_links"] for i in range(len(texts))] == [len(p) for p in partners]


def test_prefix_is_shortened_to_the_target_recall():
    d = near_dup.prefix_length(0.8)
    assert 1 - (1 - 0.8 ** d) ** near_dup.TREES >= near_dup.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near_dup.TREES


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_matches_edit_distance():
    rnd = random.Random(5)
    items = [(k, " ".join(words(rnd.randint(12, 40), 100 + k))) for k in range(8)] + [(8, "tiny"), (9, ""), (10, None)]
    index = decontaminate.BenchIndex(items)
    texts, truth = [], []
    for k in range(60):
        item_id, item = items[k % 8]
        s = list(item.upper() if k % 3 == 0 else item)
        for _ in range(rnd.randint(0, 2 * decontaminate.edit_budget(len(item)) + 1)):
            p = rnd.randrange(len(s))
            s[p:p + 1] = rnd.choice([[], ["#"], [s[p], "#"]])
        texts.append(" ".join(words(30, k)) + "\n " + "".join(s) + "  " + " ".join(words(30, 500 + k)))
        flat = " ".join(texts[-1].lower().split())
        truth.append(edit_distance_within(item, flat) <= decontaminate.edit_budget(len(item)))
    got = [any(x[0] == items[k % 8][0] for x in found) for k, found in enumerate(index.search(texts))]
    assert got == truth and True in truth and False in truth
    assert index.search(["", "a tiny one"]) == [[], [(8, 2, 6, 0)]]


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (2, None)], "item_id bigint, text string")
    texts = ["x The  quick brown\nfox jumps over the lazy dog again y", "clean", None, ""]
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    assert got == {0: [1], 1: [], 2: [], 3: []}
    assert decontaminate.leaks(docs_of(spark, texts), bench.limit(0)).count() == 4
    kept = decontaminate.drop_contaminated(docs_of(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3] and kept.columns == docs_of(spark, texts).columns


def test_segmentation_matches_brute_force():
    sp = segment.Segmenter(segment.load_vocabulary())

    def brute(w):
        out = []

        def go(i, s):
            if i == len(w):
                out.append(s)
            for j in range(i + 1, len(w) + 1):
                hit = sp.piece.get(w[i:j])
                if hit:
                    go(j, s + hit[1])
                elif j == i + 1:
                    go(j, s + sp.unknown)
        go(0, 0.0)
        return sorted(out, reverse=True)[:4]
    for text in ["the cat", "a, b.", "Grüße\nx", "日本 x", "zz%%% ab"]:
        whole = brute(segment.MARK + text.replace(" ", segment.MARK))
        ids, scores = sp.encode(text)
        assert scores == pytest.approx(whole) and sp.decode(ids.tolist()) == text
        assert [s for s, _ in sp.segmentations(text)] == pytest.approx(whole)
        assert all(sp.decode(x) == text for _, x in sp.segmentations(text))


def test_sentencepiece_round_trip(spark):
    texts = [None, "", "  two  blanks \n\n", "tab\tand é ß 😀", "word " * 20_000]
    rows = segment.encode(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert all(r["round_trip"] for r in rows) and rows[0]["n_pieces"] == 0
    back = {r["doc_id"]: r["text"] for r in segment.decode(segment.encode(docs_of(spark, texts))).collect()}
    assert [back[i] for i in range(5)] == ["", "", *texts[2:]]


def test_sum_product_equals_enumeration():
    page = dom.parse("<div><p>a <b>b</b></p><ul><li>c</li></ul></div>")
    f = html_extract.forest([page])
    rng = np.random.default_rng(1)
    unary, pair = rng.normal(size=(len(f.parent), 2)), rng.normal(size=(len(html_extract.KINDS) + 1, 2, 2))
    p, _ = html_extract.sum_product(f, unary, pair)
    total = np.zeros_like(unary)
    for y in itertools.product((0, 1), repeat=len(unary)):
        s = sum(unary[i, v] for i, v in enumerate(y))
        s += sum(pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(1, len(y)))
        for i, v in enumerate(y):
            total[i, v] += np.exp(s)
    assert np.allclose(p, total / total.sum(axis=1, keepdims=True))


def test_html_extraction(spark):
    prose = "This is prose of the article that goes on for a while, so that it counts."
    html = (f'<html><head><title>T</title><style>x{{}}</style></head><body><nav><a href="1">Menu</a></nav><div class="ad">{prose}</div>'
            f'<article><h1>A &amp; B</h1><p>{prose}<br><p>Second&nbsp;<b>bo</b>ld</p><script>var a="</p>";</script></article>'
            f'<div class="comments"><p>{prose}</p></div><footer>foot</footer>')
    pages = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", "")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(pages, html_extract.fit(pages)).collect()}
    assert got[1]["text"] == f"A & B {prose} Second bold" and got[2]["text"] == "" and got[3]["n_chars"] == 0


def test_url_filter_rules_and_list(spark):
    urls = ["http://A.example.net/en/1", "http://x.net", "https://x.net/", "http://b.org/fr/1?q", "http://c.com/p/", "https://www.c.com/p#f",
            "no scheme", None, "http://d.com/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    listed = spark.createDataFrame([("http://c.com/p",), (None,)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in UF.filter_urls(pages, listed).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1] == ("x.net", "", None, "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4][3] == got[5][3] == "block" and got[6] == got[7] == ("", "", None, "allow") and got[8][3] == "allow"


def test_license_scan_and_inheritance(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/y.py", "Licensed under CC BY-NC 4.0.\ncode " + "w " * 50),
            (4, "c/z.py", None), (5, None, "code"), (6, "top.txt", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, p string, text string")
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in license_scan.license_scan(df, df["p"]).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("CC-BY-NC-4.0", "own", None),
                   4: (None, None, None), 5: (None, None, None), 6: (None, None, None)}


def test_classifiers_and_lm_on_small_tables(spark):
    from cohortline.llm.tables import table
    from tests.conftest import SF_MID

    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    q = quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (q.predicted == q.quality).mean() > 0.95
    lm = pseudo_likelihood(docs.unionByName(docs.limit(1).selectExpr("-1L doc_id", "'' text", "lang", "source", "n_chars"))).toPandas().set_index("doc_id")
    assert lm.loc[-1, "n_words"] == 0 and np.isnan(lm.loc[-1, "mean_log_prob"]) and len(lm) == 1001
    assert lm.mean_class_log_prob.mean() > -np.log(4352) + 1              # well above a uniform guess
    assert (lm.log_likelihood <= lm.class_log_likelihood + 1e-3).all()
    none = toxicity.toxicity(docs.limit(5), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.0] * 5


def test_toxicity_learns_marked_words():
    rnd = random.Random(1)
    texts, y = [], []
    for k in range(400):
        w = words(rnd.randint(3, 80), k)
        if k % 3 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(["badword", "worseword"])
        texts.append(" ".join(w))
        y.append(int(k % 3 == 0))
    a, b, first = toxicity.word_ids(texts)
    data = [(a[s:e], b[s:e]) for s, e in zip(first[:-1], first[1:])]
    m = toxicity.train(data[:300], np.array(y[:300]))
    assert ((m.raw(a, b, first)[300:] > 0) == np.array(y[300:])).mean() > 0.95
    whole = m.raw(a, b, first)
    assert np.allclose(m._raw_long(a, b, first, 7), whole, atol=1e-4)     # pooling in pieces changes nothing


def test_segmenter_forgets_its_words_when_idle(monkeypatch):
    import time
    from types import SimpleNamespace

    monkeypatch.setattr(segment, "IDLE_S", 0.3)
    shared = SimpleNamespace(value=(["▁", "a"], [-1.0, -2.0], [0, 0]))
    with segment._segmenter(shared, "m", 2) as one:
        one.encode("a a")
    with segment._segmenter(shared, "m", 2) as two:
        assert two is one and two.cache                     # the next task finds the words
        time.sleep(0.6)
        assert segment._SEGMENTERS                          # not while it works
    time.sleep(0.9)
    assert not segment._SEGMENTERS


def test_toxicity_takes_every_labelled_row(spark, monkeypatch):
    """Training, calibration and thresholds are of all labelled rows, over several tasks."""
    monkeypatch.setattr(toxicity, "TRAINER_ROWS", 2000)
    rnd = random.Random(3)
    rows = []
    for k in range(9000):
        w = words(rnd.randint(2, 6), k)
        y = int(k % 15 == 0)
        if y:
            w[rnd.randrange(len(w))] = rnd.choice(["badword", "worseword"])
        rows.append((k, " ".join(w), "en", y))
    # the rows that the least hashes of ids leave out of 6,000 have a word of their own
    ids = spark.range(9000).where(toxicity.fold_of("id") > 1).where("id % 15 > 0").orderBy(F.xxhash64("id").desc()).limit(20)
    late = {r[0] for r in ids.collect()}
    rows = [(k, t + " lateword" if k in late else t, lang, y) for k, t, lang, y in rows]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int").repartition(4)
    m = toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"))
    a, b, first = toxicity.word_ids(["lateword", "badword"])
    assert (m.row_of[a] < len(m.emb) - 1).all()
    # each of the calibration's sums is of its whole fold
    sums = []
    monkeypatch.setattr(toxicity, "_sums", lambda r, of, f=toxicity._sums: sums.append((r.count(), f(r, of))) or sums[-1][1])
    m = toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"))
    fold = table.where(toxicity.fold_of("doc_id") == 1).count()
    assert sums[0][1][1] == fold and {n for n, _ in sums} == {fold}
    got = m.scores([t for _, t, _, _ in rows]) >= 0.5
    assert (got == np.array([y for *_, y in rows], bool)).mean() > 0.99
    assert m.thresholds["en"] >= 0.5


def test_toxicity_scaling_thresholds_and_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 2, 500)
    y = (z + rng.normal(0, 1, 500) > 1).astype(int)
    table = spark.createDataFrame([("en", int(b), float(a)) for a, b in zip(z, y)], "lang string, label int, z double").repartition(3)
    weight = (1.25, 0.5)
    platt = toxicity.scaling_of(table, weight)
    assert platt == pytest.approx(toxicity.platt_scaling(z, y, np.where(y == 1, 0.5, 1.25)), rel=1e-6)
    cut = toxicity.language_thresholds(table, platt, weight)["en"]
    score = 1 / (1 + np.exp(-(platt[0] * z + platt[1])))

    def errors(at):
        return (1.25 * ((score >= at) & (y == 0)) + 0.5 * ((score < at) & (y == 1))).sum()
    assert errors(cut) == pytest.approx(min(errors(c) for c in [*score[score >= 0.5], 0.5, 1.1]))
    # where filters are greatest does not depend on the pieces a text is searched in
    texts = [" ".join(words(n, n)) for n in (40, 3, 0, 25, 9)]
    a, b, first = toxicity.word_ids(texts)
    t = toxicity.Training(np.arange(toxicity.WORD_SLOTS + toxicity.PREFIX_SLOTS + 1) < toxicity.WORD_SLOTS + toxicity.PREFIX_SLOTS)
    whole = t._tops(t.m.row_of[a], t.m.row_of[b], first)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 5)
    pieces = t._tops(t.m.row_of[a], t.m.row_of[b], first)
    assert all(np.array_equal(x, y) for x, y in zip(whole[0], pieces[0])) and all(np.allclose(x, y) for x, y in zip(whole[1], pieces[1]))
    flat = t.flat()
    t.load(flat)
    assert np.array_equal(t.flat(), flat)


def test_lm_scores_each_rare_word_by_its_own_count(spark, monkeypatch):
    from cohortline.llm import pseudo_likelihood as pl

    # the vocabulary is full of words seen 30 times; abcx and abcy share a class, seen 22 times and twice
    common = " ".join(f"w{i}" for i in range(pl.VOCABULARY))
    texts = [common] * 30 + ["abcx"] * 20 + ["abcy", "abcx abcy abcx", None]
    for known in (pl.KNOWN, pl.VOCABULARY):                      # counts held by every task, and joined
        monkeypatch.setattr(pl, "KNOWN", known)
        rows = pl.pseudo_likelihood(docs_of(spark, texts)).collect()
        got = {r["doc_id"]: r for r in rows}
        assert len(rows) == len(texts) and got[52]["n_words"] == 0 and got[52]["mean_log_prob"] is None
        assert got[30]["log_likelihood"] - got[50]["log_likelihood"] == pytest.approx(np.log(22 / 2), abs=1e-3)
        assert got[30]["log_likelihood"] - got[30]["class_log_likelihood"] == pytest.approx(np.log(22 / 24), abs=1e-3)
        assert got[51]["n_words"] == 3 and got[51]["log_likelihood"] - got[51]["class_log_likelihood"] == pytest.approx(
            2 * np.log(22 / 24) + np.log(2 / 24), abs=1e-3)
    twice = docs_of(spark, texts).unionByName(docs_of(spark, texts).where("doc_id >= 50"))
    again = [r["n_words"] for r in pl.pseudo_likelihood(twice).where("doc_id = 51").collect()]
    assert again == [3, 3]


def test_lm_network_is_a_distribution_and_its_gradient_is_right():
    from cohortline.llm import pseudo_likelihood as pl

    rng = np.random.default_rng(8)
    net = pl.Network()
    for k in net.p:
        net.p[k] = rng.normal(0, 0.4, net.p[k].shape).astype(np.float32)
    ids = np.sort(rng.integers(0, pl.IDS, 40)).astype(np.uint16)[rng.permutation(40)]
    ctx = pl.contexts(ids, np.array([0, 1, 9, 40]))
    by_hand = np.full((4, 40), pl.IDS)
    for lo, hi in ((0, 1), (1, 9), (9, 40)):
        for i in range(lo, hi):
            for k, step in enumerate((-2, -1, 1, 2)):
                if lo <= i + step < hi:
                    by_hand[k, i] = ids[i + step]
    assert (ctx == by_hand).all()
    every = net.log_probs(np.arange(pl.IDS, dtype=np.uint16), np.repeat(ctx[:, :1], pl.IDS, axis=1))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
    # one word by hand: tanh of the summed embeddings, a softmax at each of the three nodes
    h = np.tanh(sum(net.p["emb"][k][ctx[k, 3]] for k in range(4)) + net.p["hid"]).astype(float)
    path = [(0, ids[3] // 256), (ids[3] // 256, ids[3] // 16 % 16), (ids[3] // 16, ids[3] % 16)]
    want = 0.0
    for k, (node, child) in enumerate(path):
        z = h @ net.p[f"w{k}"][node] + net.p[f"b{k}"][node]
        want += z[child] - np.log(np.exp(z).sum())
    assert net.log_probs(ids, ctx)[3] == pytest.approx(want, abs=1e-4)
    grads = net.gradients(ids, ctx)
    for name, at in (("hid", (2,)), ("w0", (0, 3, int(ids[0]) // 256)), ("b1", (int(ids[5]) // 256, 4)), ("w2", (int(ids[7]) // 16, 1, 2)), ("emb", (1, int(ctx[1, 9]), 5))):
        value, slopes = net.p[name][at], []
        for e in (1e-2, -1e-2):
            net.p[name][at] = value + e
            slopes.append(-net.log_probs(ids, ctx).mean())
        net.p[name][at] = value
        found = grads[name][at] if name != "emb" else grads["emb", 1][1][np.flatnonzero(grads["emb", 1][0] == at[1])[0], at[2]]
        assert found == pytest.approx((slopes[0] - slopes[1]) / 2e-2, abs=2e-4), name


def test_cotraining_offers_every_unlabelled_document(spark):
    from cohortline.llm import cotrain as ct

    rng = np.random.default_rng(4)
    w = rng.normal(size=ct.SIZE)
    texts = [" ".join(words(rng.integers(0, 60), k)) for k in range(5200)]
    xt = ct.text_view(texts)
    xm = ct.meta_view(texts, ["en"] * len(texts), [f"s{i % 7}" for i in range(len(texts))], [None] * len(texts))
    others = spark.createDataFrame([(i, x) for i, x in enumerate(ct.packed(xt, xm))], "doc_id bigint, x binary").repartition(3)
    cal, rate = ((1.5, 0.2), (1.0, -0.3)), 0.3
    grad, curve, mass = ct.all_given(others, w, cal, rate)
    # by hand, over all 5,200 documents: more than any sample before
    x = [xt.astype(np.float16).astype(float), xm.astype(np.float16).astype(float)]
    z = [x[0] @ w[:ct.TEXT_SIZE], x[1] @ w[ct.TEXT_SIZE:]]
    for k, at in enumerate((slice(0, ct.TEXT_SIZE), slice(ct.TEXT_SIZE, ct.SIZE))):
        p = 1 / (1 + np.exp(-(cal[1 - k][0] * z[1 - k] + cal[1 - k][1])))
        c = np.where(p >= ct.SURE, 0.5 / rate, np.where(p <= 1 - ct.SURE, 0.5 / (1 - rate), 0))
        assert mass[k] == pytest.approx(c.sum()) and c.sum() > 0
        assert np.allclose(grad[at], x[k].T @ (c * (1 / (1 + np.exp(-z[k])) - (p >= ct.SURE))), atol=1e-6)
        assert np.allclose(curve[at], np.abs(x[k]).T @ (c * np.abs(x[k]).sum(axis=1) / 4), atol=1e-6)


def test_license_headers_texts_and_dual_notices(spark):
    gpl = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
int main() { return 0; }
""" + "int other; " * 50
    isc = """ISC License

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
    dual = "Released under the MIT License.\nsome words between\nLicensed under CC BY 4.0.\n"
    texts = [gpl, isc, dual, "plain words\n\nof no licence", "", None] + [" ".join(words(50, k)) for k in range(20)]
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in license_scan.license_scan(df, df["doc_id"].cast("string")).collect()}
    names = [[x["license"] for x in got[i]["licenses"]] for i in range(len(texts))]
    assert names == [["GPL-3.0"], ["ISC"], ["MIT", "CC-BY-4.0"]] + [[]] * 23
    at = got[2]["licenses"][1]
    assert dual[at["start"]:at["end"]] == "Licensed under CC BY 4.0" and at["cosine"] == pytest.approx(1)


def test_decontamination_query_keeps_each_leak_with_its_item(spark, tmp_path):
    from cohortline.llm import queries

    items = {7: "the quick brown fox jumps over the lazy dog again", 2: "many other words stand in this second item here"}
    text = f"{items[7]} and then {items[2]} and then {items[7]}"
    docs_of(spark, [text, "clean"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in queries.op7_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert got[0]["item_ids"] == [2, 7] and got[0]["n_leaks"] == len(got[0]["leaks"]) and got[1]["leaks"] == []
    assert {x["item_id"] for x in got[0]["leaks"]} == {2, 7}
    assert all(text[x["start"]:x["end"]] == items[x["item_id"]] and x["edits"] == 0 for x in got[0]["leaks"])


def test_fit_offers_all_documents_without_a_label(spark, monkeypatch):
    from cohortline.llm import cotrain as ct

    docs = docs_of(spark, [" ".join(words(20 + k % 30, k)) + ("!" if k % 2 else "?") * 9 for k in range(120)])
    docs = docs.unionByName(docs.limit(1).selectExpr("CAST(NULL AS BIGINT) doc_id", "text", "lang", "source", "n_chars", "fp", "keep_id"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    offered, plain = [], ct.all_given

    def counted(others, *rest):
        offered.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in others.select("doc_id").collect()))
        return plain(others, *rest)
    monkeypatch.setattr(ct, "all_given", counted)
    ct.fit(docs, labels)
    assert len(offered) == ct.ROUNDS and all(o == [*((False, k) for k in range(40, 120)), (True, 0)] for o in offered)


def test_runs_of_equal_characters_segment_quickly():
    import time
    import tracemalloc

    sp = segment.Segmenter(segment.load_vocabulary())
    for text in ("x" * 100_000, "-" * 100_000, "ab" * 20_000, "x" * 3000 + " and " + "-" * 3000):
        began = time.time()
        best, ranked, same = sp.ranked(text)
        assert same and len(ranked) == 4 and time.time() - began < 20
        best = np.frombuffer(best, np.int32).tolist()
        every = [segment.with_edits(best, edits) for _, edits in ranked]
        assert all(sp.decode(ids) == text for ids in every) and len(set(map(tuple, every))) == 4
        assert [s for s, _ in ranked] == sorted((s for s, _ in ranked), reverse=True)
    peaks = []
    for n in (5_000, 20_000):
        tracemalloc.start()
        sp.ranked("x" * n)
        peaks.append(tracemalloc.get_traced_memory()[1] / n)
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]                                # memory in proportion to the run


def test_long_words_are_segmented_like_short_ones(monkeypatch):
    sp = segment.Segmenter(segment.load_vocabulary())
    texts = ["unbelievably", "aaaaabaaaaa", "日本語x", "Grüße--__--", "1234512345"]
    short = [sp._word(t) for t in texts]
    monkeypatch.setattr(segment, "LONG_WORD", 0)
    for t, s in zip(texts, short):
        got = sp._word(t)
        assert (got[0], got[3]) == (s[0], s[3]) and got[1:3] == pytest.approx(s[1:3])


def test_tied_segmentations_have_their_longest_pieces_last():
    toy = segment.Segmenter((["<unk>", "a", "aa", "aaa"], [0.0, -1.0, -2.0, -3.0], [2, 0, 0, 0]))     # every way of 5 costs 5
    best = [ids for _, ids in toy.nbest("aaaaa", 3)]
    assert best == [(2, 3), (1, 1, 3), (3, 2)]
    assert len(toy.nbest("aaaaa", 100)) == 13                       # all compositions of 5 into 1, 2 and 3


def test_sentencepiece_query_lists_all_segmentations(spark):
    texts = ["the cats", "", None, "several words, of which any may differ; even two"]
    rows = {r["doc_id"]: r for r in segment.encode(docs_of(spark, texts), segmentations=True).collect()}
    full = {}
    for r in segment.nbest_segmentations(docs_of(spark, texts)).orderBy("place").collect():
        full.setdefault(r["doc_id"], []).append((r["score"], list(r["ids"])))
    for i, r in rows.items():
        got = [(x["score"], segment.with_edits(list(r["ids"]), [(e["at"], e["drop"], e["ids"]) for e in x["edits"]])) for x in r["nbest"]]
        assert got == full[i] and got[0][1] == list(r["ids"]) and r["round_trip"]
        assert [s for s, _ in got] == list(r["nbest_scores"])
    assert len(full[0]) == len(full[3]) == 4 and full[1] == [(0.0, [])]


@pytest.fixture(scope="module")
def page_model():
    """Fitted to the marked pages alone, and with the given table's pages."""
    import pyarrow.parquet as pq

    def fitted(rows):
        pages = [dom.parse(r) for r in rows]
        pairs = [(p, y) for p in pages if (y := html_extract.sectioned_labels(p)) is not None]
        marked = html_extract.LABELLED + html_extract.practice_pages()
        weight = [1.0] * len(pairs) + [max(1.0, len(pairs) / len(marked))] * len(marked)
        pairs += [(p, html_extract.marked_labels(p)) for p in map(dom.parse, marked)]
        return html_extract.train([p for p, _ in pairs], [y for _, y in pairs], weight)
    return fitted(pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()[:250])


_PROSE = "Eighteen words stand in this paragraph, as it were, so that it is neither long nor very short."


@pytest.mark.parametrize("body, text", [
    (f'<nav><ul><li><a href="1">Home</a></li></ul></nav><div class="ad"><p>{_PROSE}</p></div><article><p>{_PROSE}</p></article><footer><p>f {_PROSE}</p></footer>', _PROSE),
    (f'<nav><a href="1">Home</a></nav><article><p>{_PROSE}</p><p>{_PROSE}</p></article><div class="sidebar"><p>{_PROSE}</p></div>', f"{_PROSE} {_PROSE}"),
    (f'<article class="search-result"><p>{_PROSE}</p><p>{_PROSE}</p></article>', f"{_PROSE} {_PROSE}"),
    ("<main><p data-x=don't>first it's here</p><p>two</p><p>three</p></main>", "first it's here two three"),
    ("<article><p>Text.</p><script src=/js/>var a=1;</script><p>More.</p></article>", "Text. More."),
    (f"<article><h1>T</h1><p>{_PROSE}</p><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul></article><footer>f</footer>", f"T {_PROSE} one two"),
    ("<article><p>Let <math><mi>x</mi><annotation>\\x</annotation></math> be.</p></article>", "Let x be."),
    ("<header><h1>S</h1></header><main><p>Hi.</p></main>", "Hi."),
    (f'<div class=nav><a href=1>x</a></div><div class=post><p>Just this.</p></div><div class=comments><p>{_PROSE}</p><p>{_PROSE}</p></div>', "Just this."),
    (f'<main><article><p>{_PROSE}</p></article></main><section class="reader-comments"><article><p>{_PROSE}</p></article></section>', _PROSE),
    (f"<article><p>{_PROSE}</p><video src=a/><p>After.</p><svg a=b/><p>End.</p></article>", f"{_PROSE} After. End."),
])
def test_articles_of_other_layouts_are_kept(page_model, body, text):
    page = dom.parse(f"<body>{body}</body>")
    assert " ".join(dom.block_texts(page, page_model.keep([page])[0])) == text


def test_fit_climbs_the_likelihood_of_the_marked_pages(page_model):
    right = 0
    marked = html_extract.LABELLED + html_extract.practice_pages()
    for source in marked:
        page = dom.parse(source)
        y = html_extract.marked_labels(page).astype(bool)
        right += dom.block_texts(page, page_model.keep([page])[0]) == dom.block_texts(page, y)
    assert right >= 0.93 * len(marked)


def test_gradient_of_the_page_model():
    """The gradient that train() follows, against differences of the likelihood by enumeration."""
    page = dom.parse("<div><p>a <b>b</b></p><ul><li>c</li></ul></div>")
    f = html_extract.forest([page])
    rng = np.random.default_rng(5)
    w, pair, y = rng.normal(size=f.x.shape[1]), rng.normal(size=(len(html_extract.KINDS) + 1, 2, 2)), rng.integers(0, 2, len(f.parent))

    def likelihood(w, pair):
        def score(y):
            return sum(f.x[i] @ w * v for i, v in enumerate(y)) + sum(pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(1, len(y)))
        return score(y) - np.logaddexp.reduce([score(z) for z in itertools.product((0, 1), repeat=len(y))])
    p, edge = html_extract.sum_product(f, html_extract.ContentModel(w, pair).unary(f.x), pair)
    grad = f.x.T @ (y - p[:, 1])
    for j in range(len(w)):
        e = np.eye(len(w))[j] * 1e-5
        assert grad[j] == pytest.approx((likelihood(w + e, pair) - likelihood(w - e, pair)) / 2e-5, abs=1e-4)
    k, a, b = f.kind[1], 1, 0
    want = sum((y[f.parent[i]] == a and y[i] == b) - edge[i, a, b] for i in range(1, len(y)) if f.kind[i] == k)
    e = np.zeros_like(pair)
    e[k, a, b] = 1e-5
    assert want == pytest.approx((likelihood(w, pair + e) - likelihood(w, pair - e)) / 2e-5, abs=1e-4)


def test_matches_in_slices_find_what_one_pass_finds(monkeypatch):
    rnd = random.Random(9)
    items = [(k, " ".join(words(rnd.randint(12, 40), 300 + k))) for k in range(6)] + [(6, "x" * 200), (7, "ab" * 60)]
    texts = []
    for k in range(24):
        s = list(items[k % 8][1])
        for _ in range(rnd.randint(0, 12)):
            p = rnd.randrange(len(s))
            s[p:p + 1] = rnd.choice([[], ["#"], [s[p], "#"]])
        texts.append(" ".join(words(40, k)) + " " + "".join(s) + " " + " ".join(words(20, 700 + k)))
    texts += ["x" * 3000, "ab" * 1500 + "x" * 400, ""]
    index = decontaminate.BenchIndex(items)
    monkeypatch.setattr(decontaminate, "MATCHES", 1 << 40)
    whole = [sorted(t) for t in index.search(texts)]
    monkeypatch.setattr(decontaminate, "MATCHES", 50)
    assert [sorted(t) for t in index.search(texts)] == whole and sum(map(bool, whole)) > 12


def test_periodic_items_and_texts_stay_in_bounded_memory():
    import tracemalloc

    index = decontaminate.BenchIndex([(1, "x" * 200)])
    tracemalloc.start()
    found = index.search(["x" * 100_000])[0]
    assert len(found) > 400 and tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()


def test_benchmark_blocks_come_one_at_a_time(spark):
    bench = spark.createDataFrame([(i, "word " * 20 + str(i)) for i in range(50)], "item_id bigint, text string")
    got = list(decontaminate.bench_blocks(bench, block_bytes=2000))
    assert len(got) > 5 and sorted(i for b in got for i, _ in b) == list(range(50))


def test_exact_dedup_with_many_repeated_fingerprints(spark, monkeypatch):
    from cohortline.llm import exact_dedup as ed

    docs = docs_of(spark, [f"text {i % 40}" for i in range(100)] + [None, "", "TEXT 1"])
    few = sorted(map(str, ed.exact_dedup(docs).collect()))
    monkeypatch.setattr(ed, "MAX_BROADCAST", 3)
    assert sorted(map(str, ed.exact_dedup(docs).collect())) == few


def test_words_learned_together_are_segmented_like_single_ones(monkeypatch):
    rng = random.Random(3)
    vocabulary = segment.load_vocabulary()
    letters = "abcdeiorstéñ▁.,0123日😀\x00\n"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(600)] + ["y" * 40]
    one, many = segment.Segmenter(vocabulary), segment.Segmenter(vocabulary)
    got = many._words(words[:600])
    assert sum(x is not None for x in got) > 300                  # the others have characters without a piece
    assert all(x == one._word(w) for w, x in zip(words, got) if x is not None)
    toy = segment.Segmenter((["<unk>", "a", "aa", "aaa", "b"], [0.0, -1.0, -2.0, -3.0, -1.0], [2, 0, 0, 0, 0]))      # ties
    some = ["a" * n + "b" * m for n in range(6) for m in range(3) if n + m]
    assert toy._words([*some, "ac"]) == [*map(toy._word, some), None]
    # few words remembered, few learned at a time: the same results, and single words are hardly ever left
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)] + [""]
    want = [one.ranked(t) for t in texts]
    for size in (7, 100_000):
        monkeypatch.setattr(segment, "CACHE_WORDS", size)
        monkeypatch.setattr(segment, "LEARN_WORDS", 50)
        monkeypatch.setattr(segment, "NBEST_WORDS", 2)
        assert list(segment.Segmenter(vocabulary).ranked_all(texts)) == want
    plain = segment.Segmenter(vocabulary)
    monkeypatch.setattr(plain, "_word", None)
    assert len(list(plain.ranked_all(["the cat sat, the dog ran. " * 20] * 3))) == 3
