"""The support vector machines and the discriminant against plain versions, and held-out figures on the test tables."""

import os
import zlib

import numpy as np
import pytest
from loomstone.llm import op3_language_id as L
from loomstone.llm import op9_quality_classifier as C


def plain_svm(x, y, c=10.0):
    """Minimises |w|^2 / 2 + c * (mean squared hinge, classes alike) by Newton steps on the active rows."""
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    z = np.column_stack((x, np.ones(len(x))))
    ridge = np.diag(np.append(np.ones(x.shape[1]), 0.0))
    w = np.zeros(z.shape[1])
    for _ in range(200):
        active = (y * (z @ w) < 1).astype(float) * share
        new = np.linalg.solve(ridge + 2 * c * (z.T * active) @ z + 1e-12 * np.eye(len(w)), 2 * c * z.T @ (active * y))
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w[:-1], w[-1]


def test_machines_against_newton():
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(300, 12)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x @ rng.normal(size=12) + 0.1 * rng.normal(size=300) > 0.1, 1.0, -1.0)
    w, b = L.svm(x.astype(np.float32), y, steps=3000)
    v, a = plain_svm(x, y)
    np.testing.assert_allclose(x @ w + b, x @ v + a, atol=5e-3)


def test_predictions_are_those_of_the_machines():
    """Family by the largest one-against-rest margin, language by votes within it, from dense features."""
    import pyarrow as pa
    from loomstone.llm import textvec as V
    from test_classifiers import SYLLABLES, text

    rng = __import__("random").Random(3)
    texts = [(lang, text(rng, lang, 25)) for lang in SYLLABLES for _ in range(40)]
    block = next(V.blocks(pa.array([t for _, t in texts]), 1 << 20))
    doc, index, value = L.features(block)
    x = np.zeros((len(texts), L.DIM))
    for i, t in enumerate(texts):  # n-grams counted one by one
        raw = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in t[1].encode())
        for n in (2, 3):
            for k in range(len(raw) - n + 1):
                g = raw[k : k + n]
                if g[:2] == b"  ":
                    continue
                h = (g[0] ^ (0x9E3779B1 * n)) & 0xFFFFFFFF
                for c in g[1:]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
                h = h * 0x85EBCA6B & 0xFFFFFFFF
                x[i, (h ^ (h >> 15)) % L.DIM] += 1
    x = np.sqrt(x / x.sum(axis=1, keepdims=True))
    dense = np.zeros_like(x)
    dense[doc, index] = value
    np.testing.assert_allclose(dense, x, atol=1e-12)
    model = L.Model.fit([(texts[i][0], index[doc == i], value[doc == i]) for i in range(len(texts))])
    margins = x @ model.weights + model.bias
    lang, score, family = model.predict(block)
    for i in range(len(texts)):
        f = int(np.argmax(margins[i, : len(model.families)]))
        inside = [k for k, name in enumerate(model.langs) if L.family_of(name) == model.families[f]]
        votes = dict.fromkeys(inside, 0)
        for k, (a, b) in enumerate(model.pairs, len(model.families)):
            if a in votes:
                votes[a if margins[i, k] >= 0 else b] += 1
        assert family[i] == model.families[f] and votes[model.langs.index(lang[i])] == max(votes.values())


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(8)
    d = 5
    x = {k: rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 2 * k for k, n in ((0, 60), (1, 200))}
    model = C.Discriminant.of_moments({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()})
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (60 * cov[0] + 200 * cov[1]) / 260
    point = rng.normal(size=(50, d)) * 3
    log = {}
    for k, n in ((0, 60), (1, 200)):
        c = 0.7 * cov[k] + 0.3 * pooled
        c = 0.9 * c + np.diag(0.1 * np.diag(pooled) + 1e-6 + 1e-4 * np.diag(pooled))
        gap = point - x[k].mean(axis=0)
        log[k] = np.log(n / 260) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap)
    np.testing.assert_allclose(model.score(point), 1 / (1 + np.exp(log[0] - log[1])), rtol=1e-6, atol=1e-9)


def test_moments_summed_on_executors_are_those_of_all_rows(spark):
    rng = np.random.default_rng(9)
    d = len(C.STATISTICS)
    x, y = rng.normal(size=(90, d)), rng.integers(0, 2, 90)
    stats = spark.createDataFrame([(i, False, v.tolist()) for i, v in enumerate(x)], C.SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    got = C.learn(stats, labels)
    want = C.Discriminant.of_moments({k: ((y == k).sum(), x[y == k].sum(axis=0), x[y == k].T @ x[y == k]) for k in (0, 1)})
    for a, b in zip(got.means + got.roots, want.means + want.roots, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)


DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_held_out_figures(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in L.op3_language_id(spark, DIR).collect() if r["held_out"] and truth[r["doc_id"]]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scored = [(r["score"], r["predicted"], quality[r["doc_id"]]) for r in C.op9_quality_classifier(spark, DIR).collect() if r["doc_id"] in quality and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    accuracy = sum(p == q for _, p, q in scored) / len(scored)
    good, bad = ([s for s, _, q in scored if q == k] for k in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    print(f"languages {right:.4f} of {len(held)}; quality {accuracy:.4f}, AUC {auc:.4f} of {len(scored)}")
    assert right > 0.97 and accuracy > 0.95 and auc > 0.98
