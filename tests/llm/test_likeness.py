"""The pipeline's language stage rejects texts with letters that are in no learned language, and keeps those that are."""

import random

import corpus_pipeline as P
import pytest
from test_classifiers import SYLLABLES, text

FOREIGN = [
    "日本語の文章はここにあります。これは学習されていない言語です。", "Это предложение написано на другом языке и не должно пройти.", "Αυτό είναι ένα κείμενο στα ελληνικά.",
    "Dzień dobry, to zdanie jest napisane po polsku i nie powinno przejść.", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ=QkFTRTY0ZGF0YQ",
]


@pytest.mark.parametrize("langs", [list(SYLLABLES), ["en"], ["en", "fr"]])
def test_language_stage_rejects_what_no_learned_language_is_like(spark, tmp_path, langs):
    rng = random.Random(3)
    rows = [(i, text(rng, lang := langs[i % len(langs)], rng.randint(3, 60)), lang) for i in range(400)]
    foreign = [(1000 + i, x, None) for i, x in enumerate([*FOREIGN, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(300))])]
    df = spark.createDataFrame([*rows, *foreign, (2000, text(rng, langs[0], 20), None)], "doc_id long, text string, lang string").repartition(3)
    kept = {r["doc_id"] for r in P.language(spark, df, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows} | {2000}


def test_one_text_of_a_language_gives_nothing_to_compare(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([(0, text(rng, "en", 20), "en"), (1, text(rng, "en", 20), None), (2, "12", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in P.language(spark, df, str(tmp_path)).collect()} == {0, 1}
