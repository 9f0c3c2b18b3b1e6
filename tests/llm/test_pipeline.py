"""The pipeline's stages on a small corpus: what each keeps, and that run() is the stages in order."""

import random

import corpus_pipeline as P
from loomstone.llm.common import Scratch


def corpus():
    rng = random.Random(9)
    syllables = {"en": ["the", "ing", "and", "th", "er", "wh"], "fr": ["le", "eau", "qu", "é", "oi", "ç"]}
    words = lambda lang, n: ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 5))) for _ in range(n)]
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        rows.append((i, " ".join(words(lang, rng.randint(60, 140))), lang, f"s{i % 4}"))
    shared = " ".join(words("en", 70))
    rows += [(200 + i, " ".join(words("en", 50)) + "\n" + shared + "\n" + " ".join(words("en", 50)), "en", "s0") for i in range(6)]
    for i in range(10):  # near copies of the first ten
        w = rows[i][1].split(" ")
        w[5] = "changed"
        rows.append((300 + i, " ".join(w), rows[i][2], "s1"))
    rows += [(400, rows[3][1], None, "s2"), (401, None, "en", "s2"), (402, "123 !!", None, None), (403, "", "fr", None), (5, rows[5][1], rows[5][2], "s1"), (None, " ".join(words("fr", 80)), "fr", None)]
    return [(*r, len(r[1] or "")) for r in rows], shared


def test_stages(spark, tmp_path):
    rows, shared = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    scratch, docs, kept = Scratch(spark, "test"), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        docs = scratch.cut(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == df.columns
    ids = {n: {r["doc_id"] for r in x} for n, x in kept.items()}
    assert len(P.STAGES) == 5 and ids["language"] == {r[0] for r in rows} - {401, 402, 403}
    assert ids["near_duplicates"] == ids["language"] - {*range(300, 310), 400} and len(kept["near_duplicates"]) == len(ids["near_duplicates"])
    middle = " ".join(shared.split()[12:58])
    assert sum(middle in r["text"] for r in kept["substrings"]) == 1 and ids["substrings"] == ids["near_duplicates"]
    clean = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 120}
    assert all(r["text"] == clean[r["doc_id"]] for r in kept["substrings"] if r["doc_id"] in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in kept["substrings"] + kept["mixture"])
    n = lambda x: sum(len(r["text"].split()) for r in x)
    assert abs(n(kept["mixture"]) - 1.5 * n(kept["substrings"])) <= 5
    assert P.run(spark, str(tmp_path)).count() == len(kept["packing"])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
