"""Plain loops beside the numpy forms, and paths that ordinary data seldom takes."""

import random

import numpy as np
import pytest

from cohortline.llm import toxicity
from cohortline.llm import url_filter as UF


def test_convolution_equals_plain_loops():
    rng = np.random.default_rng(11)
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["aa", "bb", "cc", "dd", "rareword"]) for _ in range(rnd.randint(0, 9))) for _ in range(60)] + ["", "one"]
    a, b, first = toxicity.word_ids(texts)
    data = [(a[s:e], b[s:e]) for s, e in zip(first[:-1], first[1:])]
    m = toxicity.train(data, rng.integers(0, 2, len(texts)), epochs=1)
    got = m.raw(a, b, first)
    for d, (s, e) in enumerate(zip(first[:-1], first[1:])):
        x = [m.emb[m.row_of[i]] + m.emb[m.row_of[j]] for i, j in zip(a[s:e], b[s:e])]
        total, k = m.out_bias, 0
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                best = max(sum(float(x[p + j] @ m.conv[w][j][:, f]) for j in range(w) if p + j < len(x)) for p in range(len(x)))
                total += max(best + float(m.bias[w][f]), 0) * float(m.out[k])
                k += 1
        assert got[d] == pytest.approx(total, abs=1e-4)


def test_training_follows_the_loss():
    """Training lowers the weighted logistic loss of what it is fitted to."""
    rnd = random.Random(12)
    texts, y = [], []
    for k in range(200):
        w = [rnd.choice(["red", "blue", "green", "grey"]) for _ in range(rnd.randint(3, 30))]
        if k % 4 == 0:
            w[rnd.randrange(len(w))] = "awful"
        texts.append(" ".join(w))
        y.append(int(k % 4 == 0))
    a, b, first = toxicity.word_ids(texts)
    data, y = [(a[s:e], b[s:e]) for s, e in zip(first[:-1], first[1:])], np.array(y)

    def loss(m):
        z = m.raw(a, b, first)
        w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        return float((w * np.logaddexp(0, np.where(y == 1, -z, z))).mean())
    losses = [loss(toxicity.train(data, y, epochs=n)) for n in (1, 3, 8)]
    assert losses[0] > losses[1] > losses[2]


def test_bloom_false_positives_are_settled_by_the_join(spark, monkeypatch):
    monkeypatch.setattr(UF, "BITS_PER_URL", 1)              # a crowded filter: most bits of a block are set
    listed = [f"http://l{i}.com/p{i}" for i in range(2000)]
    asked = [f"http://a{i}.com/p" for i in range(1500)] + listed[::7]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id bigint, url string")
    known = spark.createDataFrame([(u,) for u in listed], "url string")
    canon = known.select(UF.canonical(*UF.split_url(known["url"])).alias("canon"))
    words = [r[f"w{j}"] for r in UF.bloom_blocks(canon, max(1, -(-2000 // 512))).collect() for j in range(8)]
    assert sum(bin(w & (1 << 64) - 1).count("1") for w in words) / len(words) > 60      # of 64: nearly all pass the filter
    got = {r["page_id"]: (r["listed"], r["verdict"]) for r in UF.filter_urls(pages, known).collect()}
    assert got == {i: (i >= 1500, "block" if i >= 1500 else "allow") for i in range(len(asked))}


def test_license_cosines_equal_a_plain_computation():
    import math
    import re

    from cohortline.llm import license_scan as ls
    from cohortline.llm.textnum import Words

    rnd = random.Random(13)
    df = np.random.default_rng(13).integers(0, 40, 1 << ls.TERM_BITS)
    scanner = ls.Scanner(50, df)
    notices = [(name, n) for name in sorted(ls.TEMPLATES) for n in ls.TEMPLATES[name]]

    def vector(text):
        counts = {}
        for word in re.findall(r"[^\W_]+", text.lower()):
            t = int(ls._terms(Words([word]))[0])
            counts[t] = counts.get(t, 0) + 1
        v = {t: (1 + math.log(c)) * (math.log(51 / (1 + int(df[t]))) + 1) for t, c in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / size for t, x in v.items()}
    known = [(name, vector(n)) for name, n in notices]

    texts = []
    for k in range(40):
        name, notice = notices[rnd.randrange(len(notices))]
        w = notice.split(" ")
        for _ in range(rnd.randint(0, max(1, len(w) // 3))):
            w[rnd.randrange(len(w))] = f"changed{rnd.randint(0, 99)}"
        texts.append(f"some code words {k}\n\n{' '.join(w)}\n\nother words and more of them {k}")
    for text, found in zip(texts, scanner.scan(texts)):
        parts = [text, *text.split("\n\n")]
        for line in text.split("\n"):
            parts += re.split(r"(?<=[.!?])(?=[ \t])", line)
        best, name = max((sum(x * v.get(t, 0) for t, x in vector(p).items()), n) for p in parts if p.strip() for n, v in known)
        assert bool(found) == (best >= ls.MIN_COSINE)
        if found:
            assert found[0][1] == pytest.approx(best, abs=1e-6)


def test_quality_scores_are_the_fitted_models_own(spark):
    from cohortline.llm import cotrain as ct
    from tests.llm.test_operators import docs_of, words

    texts = [" ".join(words(10 + k % 40, k)) + (" good" if k % 2 else " spam spam") * (k % 5) for k in range(150)] + [None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(90)], "doc_id bigint, quality int")
    m = ct.fit(docs, labels)
    plain = [t or "" for t in texts]
    xt, xm = ct.text_view(plain), ct.meta_view(plain, ["en"] * len(texts), [f"s{i % 3}" for i in range(len(texts))], [len(t) for t in plain])
    want = []
    for t, x in zip(xt.astype(float), xm.astype(float)):
        z = [m.text_cal[0] * (t @ m.text) + m.text_cal[1], m.meta_cal[0] * (x @ m.meta) + m.meta_cal[1]]
        z = [min(max(v, -20), 20) for v in z]
        want.append(1 / (1 + np.exp(-(z[0] * m.blend[0] + z[1] * m.blend[1] + m.blend[2]))))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in ct.quality(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i][0] == pytest.approx(w, abs=1e-4) and got[i][1] == int(got[i][0] >= 0.5)
