"""The whole pipeline against plain Python: rows judged one by one, all pairs, plain chunks, bisection, whole-text encoding."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
from loomstone.llm import op2_mixing as X
from loomstone.llm import op3_language_id as L
from loomstone.llm import op6_substring_dedup as S
from loomstone.llm import textvec as V
from test_op1 import expected
from test_op2 import plain_balance, shared
from test_op4 import whole
from test_op6 import plain_chunks
from test_pipeline import corpus

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def languages(rows, model):
    def believed(text):
        b = next(V.blocks(pa.array([text], pa.string())))
        found = L.features(b)
        lang, score, _ = model.predict(b, found)
        return lang[0] != "und" and score[0] >= P.LEAST_SCORE and model.likeness(b, found, lang)[0] >= P.LEAST_SCORE

    return [r for r in rows if believed(r[1])]


def near_duplicates(rows):
    groups = expected([(i, r[1]) for i, r in enumerate(rows)])  # components by place
    best = {}
    for (i, _, component, _), r in zip(groups, rows, strict=True):
        rank = (r[0] is None, r[0] or 0)
        if component not in best or rank < best[component][0]:
            best[component] = (rank, i)
    return [rows[i] for _, i in best.values()]


def substrings(rows, keys):
    order = lambda r, k: ((r[0] is not None, r[0] or 0), keys[r[0], r[1]], k)
    chunks = [plain_chunks(r[1]) for r in rows]
    first, count = {}, Counter()
    for r, c in zip(rows, chunks, strict=True):
        for k, (w, _, _) in enumerate(c):
            first[w] = min(first.get(w, order(r, k)), order(r, k))
            count[w] += 1
    out = []
    for r, c in zip(rows, chunks, strict=True):
        raw, k, cuts = r[1].encode(), 0, []
        while k < len(c):
            z = k
            while z < len(c) and count[c[z][0]] > 1 and order(r, z) > first[c[z][0]]:
                z += 1
            if z > k and sum(len(x[0]) for x in c[k:z]) >= S.LEAST_WORDS:
                cuts.append((c[k][1], c[z - 1][2]))
            k = max(z, k + 1)
        for a, z in reversed(cuts):
            raw = raw[:a] + raw[z:]
        if WORDS.search(raw.decode()):
            out.append((r[0], raw.decode(), *r[2:]))
    return out


def mixture(rows):
    size = [len(WORDS.findall(r[1])) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    target = shared(dict(total))
    classes = Counter((r[3], n, math.log(max(n, 1))) for r, n in zip(rows, size, strict=True))
    rates, _ = plain_balance([(s, z, x, n) for (s, z, x), n in classes.items()], {s: (total[s], target[s]) for s in total})
    out = []
    for s in total:
        line, rest = [], math.floor(target[s] + 0.5)
        for r, n in zip(rows, size, strict=True):
            if r[3] == s:
                rate = rates[s, n, math.log(max(n, 1))]
                whole_part = math.floor(rate + 1e-9)
                digest = hashlib.md5(b"" if r[0] is None else str(r[0]).encode()).hexdigest()
                part = rate - whole_part
                line.append((int(digest[:13], 16) / 16**13 / part if part > 1e-9 else 1e18, digest, n, whole_part, r))
                rest -= whole_part * n
        for _, _, n, times, r in sorted(line, key=lambda x: x[:2]):
            more = max(0, min(n, rest))
            rest -= more
            out += [r] * (times + (more == n > 0))
            if 0 < more < n:
                out.append((r[0], "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r[1])[:more]), *r[2:]))
    return out


def pieces(rows):
    out = Counter()
    for r in rows:
        ids = np.array([*whole(r[1]), 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            out[r[0], p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    return out


def test_run_against_plain_python(spark, tmp_path):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model = L.train(df.where(L.crc_mod("doc_id", 4) != 2))
    kept = near_duplicates(languages(rows, model))
    keys = {(r["doc_id"], r["text"]): r["row_key"] for r in df.select("doc_id", "text", S.row_key()).collect()}
    want = pieces(mixture(substrings(kept, keys)))
    got = P.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert X.TILT == 1.0  # what the bisection assumes
