"""A shared passage whose words repeat with a small period is found between differing texts."""

import random

import pytest
from loomstone.llm import op6_substring_dedup as S


@pytest.mark.parametrize("phrase", ["again", "very well", "one two three"])
def test_repeated_phrase_shared_by_documents(spark, phrase):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    shared = " ".join((phrase.split() * 60)[:60])
    rows = [(i, f"{words(40)} {shared} {words(40)}") for i in range(5)]
    spans = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    text = {i: t.encode() for i, t in rows}
    gone = {i: sum(len(text[i][r["begin_byte"] : r["end_byte"]].split()) for r in spans if r["doc_id"] == i) for i in text}
    assert all(gone[i] >= 32 for i in range(1, 5))
    assert all(set(text[r["doc_id"]][r["begin_byte"] : r["end_byte"]].decode().split()) <= set(phrase.split()) for r in spans)
