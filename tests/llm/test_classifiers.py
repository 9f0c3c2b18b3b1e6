"""Language identification and the quality classifier: held-out accuracy and odd rows."""

import random
import zlib

import pytest
from loomstone.llm import op3_language_id as L
from loomstone.llm import op9_quality_classifier as Q

SYLLABLES = {
    "en": ["the", "ing", "and", "th", "er", "wh", "sh"], "de": ["der", "sch", "und", "ung", "ei", "ü", "ß"], "fr": ["le", "eau", "qu", "é", "è", "oi", "ç"], "es": ["el", "ción", "ñ", "os", "ado", "rr", "ll"],
}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 60)), lang) for i in range(600)]
    return out + [(1000, None, "en"), (1001, "", "fr"), (1002, "123 !?", None), (1003, text(rng, "de", 20), None), (1004, "日本語", None), (None, text(rng, "es", 20), "es")]


def test_languages(spark, rows):
    df = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double").repartition(4)
    got = {r["doc_id"]: r for r in L.identify(df).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[0] is not None and r[0] < 600 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[r[0]]["held_out"] for r in held)
    assert sum(got[d]["lang_pred"] == lang for d, _, lang in held) / len(held) > 0.97
    for d in (1000, 1001, 1002):
        assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
    assert got[1003]["lang_pred"] == "de" and got[1004]["lang_pred"] in SYLLABLES and all(0 <= r["score"] <= 1 for r in got.values())
    kept = L.keep_believed(df, L.train(df), 0.25)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {r[0] for r in rows if r[1] and r[2]} - {1001}


def test_nothing_or_one_language_to_learn(spark, rows):
    schema = "doc_id long, text string, lang string"
    none = L.identify(spark.createDataFrame([(i, t, None) for i, t, _ in rows[:10]], schema)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = L.identify(spark.createDataFrame([(i, t, "en") for i, t, _ in rows[:10]], schema)).collect()
    assert {r["lang_pred"] for r in one} == {"en"}
    assert L.identify(spark.createDataFrame([], schema)).count() == 0


def test_families_hold_their_languages():
    assert L.family_of("en") == L.family_of("de") != L.family_of("fr") and L.family_of("xx") == "only xx"


def test_quality(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = [text(rng, "en", 1) for _ in range(rng.randint(20, 80))]
        docs.append((i, " ".join(words) + "." if good else " ".join(rng.choice(words[:4]).upper() + rng.choice("#$%!") for _ in words)))
        if i % 2:
            labels.append((i, int(good)))
    truth = {i: t.endswith(".") for i, t in docs}
    docs += [(900, None), (901, ""), (901, ""), (None, "x")]
    d = spark.createDataFrame([(*r, 1, "en") for r in docs], "doc_id long, text string, y int, lang string").repartition(3)
    y = spark.createDataFrame(labels + [(None, 1), (3, None), (5, 7), (7, 0), (7, 1)], "doc_id long, quality int")
    got = Q.classify(d, y).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert held and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = Q.classify(d, y.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert Q.classify(d.limit(0), y).count() == 0
