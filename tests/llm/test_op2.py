"""Mixing: targets against a loop that shares the excess again, and what the rows take."""

import math
import random
from collections import defaultdict

from loomstone.llm import op2_mixing as X
from loomstone.llm.common import Scratch

DOCS = [
    (1, "a b c d e f g h", "s1"), (2, None, "s1"), (3, "", None), (4, " x\x0by\x1cz é ", None), (5, "one", "a"), (6, "one two three", "a"), (6, "one two three", "a"), (7, "w " * 300, "big"), (8, "w " * 500, "big"),
    (9, "t", "Z"), (None, "null id here", "a"), (10, "q r", "mid"), (11, "  ", "void"),
]


def shared(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "x", 2.0) for r in rows], "doc_id long, text string, source string, size string, rate double").repartition(3)


def test_targets_and_copies(spark):
    got = X.mix(frame(spark)).collect()
    assert len(got) == len(DOCS)
    sizes = defaultdict(int)
    import re

    n = {(d, s): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, s in DOCS}
    for d, _, s in DOCS:
        sizes[s] += n[d, s]
    want = shared(dict(sizes))
    by_size = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_size.setdefault(r["source_size"], []).append(r)
    for s, total in sizes.items():
        rows = [r for r in by_size[total]]
        assert any(math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9) for r in rows)
    mixed = X.materialise(frame(spark))
    assert mixed.columns == frame(spark).columns
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-9
    assert sorted(map(str, X.mix(frame(spark)).collect())) == sorted(map(str, got))


def solved(spark, classes, aims, constrained):
    """multipliers, rates and what was measured; classes: (source, size, x, n), aims: source -> (size, target)."""
    c = spark.createDataFrame([(False, *r) for r in classes], "missing boolean, name string, size long, x double, n long")
    s = spark.createDataFrame([(False, k, a, t >= 2 * a, t) for k, (a, t) in aims.items()], "missing boolean, name string, source_size long, full boolean, target double")
    found, shared, mean, measured = X.balance(c, s, Scratch(spark, "test"), constrained)
    rows = c.join(found, X.SOURCE).select("name", "size", "x", "n", X.rate_of(shared, mean, 2.0).alias("rate")).collect()
    return rows, shared, mean, measured


def test_newton_from_the_corpus_as_it_is(spark):
    aims = {"a": (100, 199.0), "b": (100, 1.0), "c": (10**12, 3.0), "d": (7, 7.0), "e": (0, 0.0), "f": (5, 0.0), "g": (50, 100.0)}
    rows, _, _, measured = solved(spark, [(k, a, 0.0, 1) for k, (a, _) in aims.items()], aims, False)
    for r in rows:
        assert math.isclose(r["rate"] * r["size"], aims[r["name"]][1], rel_tol=1e-10, abs_tol=1e-9)
    assert measured["residual"] <= X.TOLERANCE and measured["passes"] > 3


def plain_balance(classes, aims):
    """The same rates by bisection within bisection."""
    total = sum(n * z for _, z, _, n in classes)
    mean = sum(n * z * x for _, z, x, n in classes) / total

    def rates(mu):
        out = {}
        for s, (size, target) in aims.items():
            own = [(z * n, x - mean, (s, z, x)) for t, z, x, n in classes if t == s]
            if target >= 2 * size:
                out |= {k: 2.0 for _, _, k in own}
                continue
            lo, hi = -60.0, 60.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if sum(w * min(2.0, math.exp(mid + mu * x)) for w, x, _ in own) > target else (mid, hi)
            out |= {k: min(2.0, math.exp(lo + mu * x)) for _, x, k in own}
        return out, mean

    def drift(mu):
        r, _ = rates(mu)
        return sum(n * z * r[s, z, x] * (x - mean) for s, z, x, n in classes)

    lo, hi = -1.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if drift(mid) > 0 else (mid, hi)
    return rates(lo)[0], lo


def test_a_shared_constraint_needs_more_than_a_rate_per_source(spark):
    rng = random.Random(4)
    classes = [(s, z, math.log(z), rng.randint(1, 40)) for s, low in (("long", 300), ("short", 5), ("mid", 60), ("other", 90)) for z in rng.sample(range(low, 6 * low), 12)] + [("full", z, math.log(z), 2) for z in (80, 90)]
    size = {s: sum(z * n for t, z, _, n in classes if t == s) for s in ("long", "short", "mid", "other", "full")}
    aims = {s: (size[s], f * size[s]) for s, f in {"long": 1.5, "short": 1.7, "mid": 1.3, "other": 1.9, "full": 2.0}.items()}
    rows, shared, mean, measured = solved(spark, classes, aims, True)
    want, mu = plain_balance(classes, aims)
    assert measured["residual"] <= X.TOLERANCE and measured["shared_residual"] <= X.TOLERANCE and abs(shared) < X.TILT
    assert math.isclose(shared, mu, rel_tol=1e-6)
    for r in rows:
        assert math.isclose(r["rate"], want[r["name"], r["size"], r["x"]], rel_tol=1e-6) and r["rate"] <= 2
    one_rate = sum(r["n"] * r["size"] * aims[r["name"]][1] / size[r["name"]] * (r["x"] - mean) for r in rows)
    total = sum(r["n"] * r["size"] * abs(r["x"] - mean) for r in rows)
    assert abs(one_rate) > 0.01 * total  # target / size per source does not meet the constraint
    assert len({round(r["rate"], 6) for r in rows if r["name"] == "long"}) > 6


def test_mix_with_a_covariate_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 400 if i % 3 else 30), f"s{i % 3}") for i in range(600)]
    got = X.mix(frame(spark, rows), covariate=X.log_size).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 for s in target)
    partial = [r for r in got if r["size"] and r["taken"] % r["size"]]
    assert len(partial) <= len(target)  # all others are whole copies
    assert sorted(map(str, X.mix(frame(spark, rows).repartition(7), covariate=X.log_size).select("doc_id", "taken").collect())) == sorted(str(r) for r in [type(g)(doc_id=g["doc_id"], taken=g["taken"]) for g in got])


def test_equal_rows_at_the_cut(spark):
    rows = [(7, "a b c", "s")] * 400 + [(i, "x " * 5, "s") for i in range(100)] + [(None, "q r", "t")] * 300 + [(1, "z " * 50, "u")] * 20
    got = X.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 for s in target)
    mixed = X.materialise(frame(spark, rows)).collect()
    words = defaultdict(int)
    for r in mixed:
        words[r["source"]] += len(r["text"].split())
    assert sorted(words.values()) == sorted(taken.values())


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"source {i:03d}") for i in range(300)]
    sizes = {f"source {i:03d}": 1 + i % 7 for i in range(300)}
    want = shared(sizes)
    for r in X.mix(frame(spark, rows)).collect():
        assert math.isclose(r["target"], want[f"source {r['doc_id']:03d}"], rel_tol=1e-9)


def test_empty_and_wordless(spark):
    assert X.mix(frame(spark, DOCS[:0])).count() == 0
    assert [r["taken"] for r in X.mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]
