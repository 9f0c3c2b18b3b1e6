"""Quality rules against a plain version over Python strings."""

import random
import re
from collections import Counter

import pytest
from loomstone.llm.op7_quality_rules import MAX_LINE_SHARE, MAX_NGRAM_SHARE, repetition_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))

    def inside(n):
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(windows)
        return {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(n)}

    rep = len(inside(5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = Counter(lines)
    base = len(words) < 10 or 100 * rep > 20 * len(words)
    bad = any(sum(len(words[i]) for i in inside(n)) / max(chars, 1) > t for n, t in MAX_NGRAM_SHARE.items())
    in_lines = sum(len("".join(WORD.findall(x))) for x in lines if count[x] > 1) / max(chars, 1)
    return (len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(count), rep, base, not (base or bad or in_lines > MAX_LINE_SHARE))


def texts():
    rng = random.Random(3)
    vocabulary = ["a", "bé", "the", "日本", "x y", "c#", "of", "<b>", " ", "naïve"]
    out = [None, "", " \n\t", "\n\n", "one", "a b c d e a b c d e a b c d e", "same line\nsame line\nother\n same line", "x\x1cy \x0bz\r\n" * 20, "ab " * 50000]
    for _ in range(150):
        k = rng.choice([3, 10, 30, 200])
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t ", "\r\n"]) for _ in range(k)))
    for _ in range(30):  # mostly clean, with one passage repeated
        w = [str(rng.random())[2:9] for _ in range(120)]
        out.append(" ".join(w[:50] + w[10 : 10 + rng.randrange(12)] + w[50:]))
    return out


def test_against_plain(spark):
    rows = [(i, t, "en", None) for i, t in enumerate(texts())] + [(3, texts()[5], "en", None), (None, "lost id " * 3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string").repartition(3)
    got = repetition_rules(df).collect()
    want = sorted(((i,) + plain(t) for i, t, *_ in rows), key=repr)
    assert sorted((tuple(r[:8]) for r in got), key=repr) == want
    assert any(r.kept for r in got)
    assert any(not r.kept and not r.base_failed for r in got)


def test_empty_table(spark):
    assert repetition_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_blocks_do_not_change_results(limit):
    import pyarrow as pa
    from loomstone.llm import op7_quality_rules as Q
    from loomstone.llm import textvec as V

    t = texts()
    got = []
    for b in V.blocks(pa.array(t), limit):
        m = Q.measure(b, MAX_NGRAM_SHARE, MAX_LINE_SHARE)
        got += list(zip(*(m[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), strict=True))
    assert got == [plain(x) for x in t]
