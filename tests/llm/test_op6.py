"""Content-defined chunks against a plain version, planted passages, and clean documents."""

import random
import re

import numpy as np
from loomstone.llm import op6_substring_dedup as S
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_chunks(text, reach=S.REACH):
    data = text.encode()
    h, rolled = 0, []
    clean = [32 if b in b" \t\n\x0b\x0c\r" else b for b in data]
    for i in range(len(data)):
        rolled.append(sum(int(S._GEAR[clean[j]]) << (i - j) for j in range(max(0, i - 15), i + 1)) % 2**32 * 0x9E3779B1 % 2**32)
    spans = [m.span() for m in WORD.finditer(data)]
    v = [rolled[e - 1] for _, e in spans]
    out, begin = [], 0
    for i in range(len(v)):
        inner = reach <= i < len(v) - reach
        if i == len(v) - 1 or inner and all(v[i] < x for x in v[i - reach : i]) and all(v[i] <= x for x in v[i + 1 : i + 1 + reach]):
            out.append((tuple(data[a:z] for a, z in spans[begin : i + 1]), 0 if begin == 0 else spans[begin][0], len(data) if i == len(v) - 1 else spans[i + 1][0]))
            begin = i + 1
    return out


def plain_spans(rows, least=S.LEAST_WORDS):
    keyed = []
    for d, t in rows:
        if (d, t) not in keyed:
            keyed.append((d, t))
    return {(d, t): plain_chunks(t or "") for d, t in keyed}


def passage(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def corpus():
    rng = random.Random(5)
    rows = []
    for k in range(60):
        p = passage(rng, 51 + k)
        for j in range(2):
            rows.append((2 * k + j, rng.choice([" ", "\n", "  "]).join(passage(rng, rng.randint(0, 150))) + " " + " ".join(p) + " " + " ".join(passage(rng, rng.randint(0, 150)))))
    hot = " ".join(passage(rng, 80))
    rows += [(200 + i, " ".join(passage(rng, 30)) + "\n" + hot + " " + " ".join(passage(rng, 10))) for i in range(40)]
    return rows + [(300, None), (301, ""), (302, "short text"), (303, "short text"), (304, "é " * 100), (None, hot), (200, "the same id, another text"), (302, "short text")]


def test_chunks(spark):
    rows = corpus()
    got = {}
    for r in S.chunks(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r["doc_id"], []).append((r["place"], r["n_words"], r["begin_byte"], r["end_byte"]))
    for i, (_, t) in enumerate(rows):
        want = plain_chunks(t or "")
        assert sorted(got.get(i, [])) == [(k, len(w), a, z) for k, (w, a, z) in enumerate(want)]
        assert all(len(w) > S.REACH for w, _, _ in want[:-1])


def test_spans_against_plain(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, digest int").repartition(4)
    got = S.repeated_spans(df).collect()
    keys = {(r["doc_id"], r["text"]): r["row_key"] for r in df.select("doc_id", "text", S.row_key()).collect()}
    chunks = plain_spans(rows)
    order = lambda d, t, k: ((d is not None, d or 0), keys[d, t], k)
    first, count = {}, {}
    for (d, t), c in chunks.items():
        for k, (w, _, _) in enumerate(c):
            first[w] = min(first.get(w, order(d, t, k)), order(d, t, k))
            count[w] = count.get(w, 0) + 1
    want = set()
    for (d, t), c in chunks.items():
        k = 0
        while k < len(c):
            z = k
            while z < len(c) and count[c[z][0]] > 1 and order(d, t, z) > first[c[z][0]]:
                z += 1
            if z > k and (n := sum(len(x[0]) for x in c[k:z])) >= S.LEAST_WORDS:
                want.add((d, c[k][1], c[z - 1][2], n, z - k))
            k = max(z, k + 1)
    assert {(r["doc_id"], r["begin_byte"], r["end_byte"], r["n_words"], r["n_chunks"]) for r in got} == want and len(got) == len(want)
    caught = {r["doc_id"] for r in got}
    assert caught >= {2 * k + 1 for k in range(60)} and not caught & {2 * k for k in range(60)}
    assert len(caught & set(range(200, 240))) == 40
    clash = df.withColumnsRenamed({"digest": "row_key"}).withColumn("cuts", F.lit(2))
    assert {(r["row_key"], r["cuts"]) for r in S.remove_spans(clash, S.repeated_spans(clash)).collect()} == {(1, 2)}
    cut = {(r["doc_id"], r["text"]) for r in S.remove_spans(df, S.repeated_spans(df)).collect()}
    by = {}
    for d, a, z, *_ in want:
        by.setdefault(d, []).append((a, z))
    for d, t in rows:
        if t is not None and d in by and (d, t) != (200, "the same id, another text"):
            raw = t.encode()
            for a, z in sorted(by[d], reverse=True):
                raw = raw[:a] + raw[z:]
            assert (d, raw.decode()) in cut
        else:
            assert (d, t) in cut
    assert S.remove_spans(df, S.repeated_spans(df)).count() == len(rows)


def test_shifts(spark):
    rng = random.Random(8)
    p = passage(rng, 400)
    a, b = plain_chunks(" ".join(p)), plain_chunks(" ".join(passage(rng, 3) + p[:200] + ["new"] + p[200:]))
    same = {w for w, _, _ in a} & {w for w, _, _ in b}
    assert len(same) >= 0.9 * len(a) and np.isfinite(len(same))


def test_empty(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
