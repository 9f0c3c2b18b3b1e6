"""Near-duplicates against all pairs of plain sets, and the sequential test and components on their own."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from loomstone.llm import op1_minhash as M
from loomstone.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def expected(rows):
    sets = [plain(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            up[find(b)] = find(a)
    label = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            label[r] = min(label.get(r, doc), doc)
    return [(doc, len(sets[i]), label.get(find(i)), doc == label.get(find(i))) for i, (doc, _) in enumerate(rows)]


def corpus():
    rng = random.Random(11)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[rng.randrange(len(w))] = words(1)[0]
        return " ".join(w)

    texts = [None, "", "  \n", "one", "One", "two words", "two\twords ", "a b c d", "a b c d e", "Ünï x", "ünï x", "x " * 400]
    for _ in range(12):  # small groups around the threshold
        base = words(rng.randint(20, 120))
        texts += [edited(base, k) for k in (0, 0, 1, 1, 2, 2, 3, 4)]
    hub = words(150)  # one large group: some linked through the base only, some with nothing
    texts += [edited(hub, rng.choice([1, 2, 3, 3, 4, 5, 6])) for _ in range(90)] + [" ".join(hub)]
    chain = words(300)  # each similar to the next
    texts += [" ".join(chain[8 * i : 8 * i + 100]) for i in range(20)]
    texts += texts[20:24]
    rng.shuffle(texts)
    return [(i * 3 + 5, t) for i, t in enumerate(texts)] + [(5, "one"), (11, texts[2]), (None, texts[3])]


@pytest.mark.parametrize("small_bucket", [1, 64])
def test_against_all_pairs(spark, small_bucket):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, node string, label int").repartition(3)
    got = M.near_duplicates(df, small_bucket=small_bucket).select("doc_id", "n_shingles", "component_id", "kept").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_bound():
    least = M.least_matches()
    assert list(least) == [32, 64, 96, 128] and all(x < y for x, y in zip(least.values(), list(least.values())[1:], strict=False))
    rng = np.random.default_rng(3)
    true = rng.random((20000, 128)) < 0.75  # pairs at the threshold: the chance of losing one is about MISS a batch
    a = np.zeros((20000, 128), np.uint32)
    assert len(M.pruned(a, (~true).astype(np.uint32))) == 20000
    assert len(M.pruned(a[:1000], (rng.random((1000, 128)) > 0.3).astype(np.uint32))) == 0


def test_components(spark, tmp_path):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = M.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: find(x) for e in links if e[0] != e[1] for x in e}
