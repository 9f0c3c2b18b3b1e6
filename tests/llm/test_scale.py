"""Hot groups, odd ids and very long texts: what may not be lost, and what may not meet in one place."""

import random
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
import pytest
from loomstone.llm import op3_language_id as L
from loomstone.llm import op4_packing as K
from loomstone.llm import op6_substring_dedup as S
from loomstone.llm import textvec as V
from loomstone.llm.common import Scratch
from test_classifiers import text


@pytest.mark.parametrize("doc_id", [7, None])
def test_languages_are_learned_whatever_the_ids(spark, doc_id):
    rng = random.Random(2)
    rows = [(doc_id, text(rng, lang, 12), lang) for lang in ("en", "fr") for _ in range(3600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = L.train(df)
    assert model.langs == ["en", "fr"]
    got = Counter(r["lang_pred"] for r in L.predict(df, model).collect())
    assert abs(got["en"] - 3600) < 100 and sum(got.values()) == 7200
    assert L.train(df, per_language=50, most_rows=60).langs == ["en", "fr"]


def test_one_text_that_is_a_third_of_all_teaches_once(spark):
    rng = random.Random(3)
    rows = [(1, "the same text in the one language", "en")] * 3000 + [(i, text(rng, "de", 12), "de") for i in range(300)] + [(i, text(rng, "fr", 12), f"l{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = L.train(df, per_language=40, most_rows=100, most_languages=2)
    assert model.langs == ["de", "en"]  # the most frequent ones


def test_near_duplicates_of_one_id_or_none(spark, tmp_path):
    rng = random.Random(5)
    base = [str(rng.random())[2:8] for _ in range(100)]
    near = lambda k: " ".join([*base[:k], "other", *base[k + 1 :]])
    far = " ".join(str(rng.random())[2:8] for _ in range(60))
    rows = [(5, near(3), "a"), (5, near(50), "b"), (9, near(90), "c"), (9, near(90), "c"), (None, far, "d"), (None, far + " tail", "e"), (None, "", "f"), (1, " \n", "g"), (1, " \n", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = P.near_duplicates(spark, df, str(tmp_path)).collect()
    ids = Counter(r["doc_id"] for r in got if r["text"].strip())
    assert ids == {5: 1, None: 1} and sorted(r["text"] for r in got if not r["text"].strip()) == ["", " \n"]
    assert P.near_duplicates(spark, df.limit(0), str(tmp_path)).count() == 0


def test_equal_pieces_spread_over_groups(spark):
    rows = [(7, "alpha beta gamma delta " * 20)] * 3000 + [(i, "x y z " * (i % 40)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = K.tokenise(df, K.tokenizer_file()).drop("ids")
    packed = K.pack(pieces, 4000, group=500, alike=50).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in packed)
    assert len(packed) == 4000 and len(groups) == 8 and max(groups.values()) < 1000


def test_equal_rows_are_cut_into_chunks_once(spark):
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    one, other = words(80), words(80)
    df = spark.createDataFrame([(3, one)] * 500 + [(4, other), (None, one)], "doc_id long, text string").repartition(4)
    rows = S.once(df, "doc_id", "text", Scratch(spark, "test"))
    assert rows.count() == 3
    spans = S.repeated_spans(df)
    assert {(r["doc_id"], r["first_doc_id"]) for r in spans.collect()} == {(3, None)}
    left = S.remove_spans(df, spans).groupBy("doc_id", "text").count().collect()
    assert {(r["doc_id"], r["text"], r["count"]) for r in left} == {(3, "", 500), (4, other, 1), (None, one, 1)}


LONG = ["", "a", "é" * 700, "x" * 5000, "one\ntwo two\n\n three " * 300, " ", "word " * 999 + "tail", "\n" * 50, "日本語 テスト " * 200, "y" * 513 + " " + "y" * 512]


def results(texts, limit):
    out = []
    for b in V.blocks(pa.array(texts), limit):
        w, r = V.words(b), V.lines(b)
        out += [(w.hash[x:y].tolist(), (w.begin[x:y] - b.at[i]).tolist()) for i, (x, y) in enumerate(zip(w.at[:-1], w.at[1:], strict=True))]
        out += [r.hash[x:y].tolist() for x, y in zip(r.at[:-1], r.at[1:], strict=True)]
    return out


def test_pieces_of_long_texts_give_what_whole_texts_give(monkeypatch):
    from loomstone.llm import op1_minhash as M
    from loomstone.llm import op7_quality_rules as Q
    from loomstone.llm import op9_quality_classifier as C

    def everything():
        b = next(V.blocks(pa.array(LONG), 1 << 20))
        w = V.words(b)
        sets, at = M.shingle_sets(b)
        return [
            w.begin, w.end, w.hash, V.lines(b).hash, *L.features(b), L.has_letter(b), sets, at, S.gear(b, w.end - 1), S.chunk_ends(b, w), C.statistics(b),
            *Q.measure(b, Q.MAX_NGRAM_SHARE, Q.MAX_LINE_SHARE).values(), V.byte_counts(b, V.SPACE),
        ]

    whole = everything()
    for piece in (16, 37, 1000):
        monkeypatch.setattr(V, "PIECE", piece)
        for x, y in zip(whole, everything(), strict=True):
            np.testing.assert_allclose(x, y, rtol=1e-12)


def test_memory_of_a_long_text_is_that_of_its_words():
    import tracemalloc

    from loomstone.llm import op1_minhash as M
    from loomstone.llm import op7_quality_rules as Q
    from loomstone.llm import op9_quality_classifier as C

    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 8 << 20, dtype=np.uint8)
    raw[rng.random(len(raw)) < 0.15] = 32
    b = next(V.blocks(pa.array([raw.tobytes().decode()])))
    limits = {  # bytes of memory a byte of text
        "words": (lambda: V.words(b), 8), "language": (lambda: L.features(b), 2), "letters": (lambda: L.has_letter(b), 2), "shingles": (lambda: M.shingle_sets(b), 14), "chunks": (lambda: S.chunk_ends(b, V.words(b)), 16),
        "rules": (lambda: Q.measure(b, Q.MAX_NGRAM_SHARE, Q.MAX_LINE_SHARE), 24), "statistics": (lambda: C.statistics(b), 24),
    }
    for name, (run, most) in limits.items():
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        print(name, peak / len(raw))
        assert peak < most * len(raw), name


def test_long_words_have_strong_hashes():
    flip = str.maketrans("ab", "ba")
    s = "a"
    for _ in range(12):
        s += s.translate(flip)
    a, b = s, s.translate(flip)  # such pairs are alike to polynomials modulo powers of two
    h = V.words(next(V.blocks(pa.array([f"{a} {b}"]), 1 << 20))).hash
    assert h[0] != h[1]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    with open(K.tokenizer_file(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"].pop()  # keeps case
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    from tokenizers import Tokenizer

    texts = ["Some Text here", "", "ABC abc"]
    w = K.WordIds(str(path))
    assert not w.by_word and K.WordIds(K.tokenizer_file()).by_word
    ids, at = w.encode(next(V.blocks(pa.array(texts))))
    t = Tokenizer.from_file(str(path))
    assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
