"""Extra columns whose names the operators use themselves."""

import random

import corpus_pipeline as P
from loomstone.llm import op5_ann as A
from loomstone.llm import op8_chat_format as C
from loomstone.llm import op9_quality_classifier as Q
from pyspark.sql import functions as F
from test_classifiers import text


def test_classifier_search_and_chats(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, text(rng, "en", 20) + "." * (i % 2), 0.5, [1.0], 1, True) for i in range(60)], "doc_id long, text string, score double, stats array<double>, y int, held_out boolean")
    labels = spark.createDataFrame([(i, i % 2, 7) for i in range(60)], "doc_id long, quality int, label_id long")
    plain = Q.classify(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    assert sorted(map(tuple, Q.classify(docs, labels).collect())) == sorted(map(tuple, plain.collect()))
    vectors = spark.createDataFrame([(i, [rng.random(), rng.random()], 1, 2, [3], 4) for i in range(50)], "vec_id long, embedding array<double>, dim int, shard int, ids array<int>, vec int")
    only = vectors.select("vec_id", "embedding")
    assert sorted(map(tuple, A.search(vectors, F.col("vec_id") % 20 == 0).collect())) == sorted(map(tuple, A.search(only, F.col("vec_id") % 20 == 0).collect()))
    chats = spark.createDataFrame([(c, t, "user", f"{c % 3} {t}", 1, 2) for c in range(9) for t in range(1 + c)], "conv_id long, turn long, role string, text string, turns int, n_turns int")
    assert sorted(map(tuple, C.format_chats(chats).collect())) == sorted(map(tuple, C.format_chats(chats.select("conv_id", "turn", "role", "text")).collect()))


def test_pipeline_stages_pass_them_on(spark, tmp_path):
    rng = random.Random(6)
    names = "score double, row string, size long, taken long, digest string, row_key long, root long, cuts string, rate double, key string, place string, number long, missing boolean, name string"
    rows = [(i, text(rng, lang := ["en", "fr"][i % 2], 60), lang, f"s{i % 3}", 0, float(i), f"r{i}", i, i, "d", 1, 2, "c", 0.1, "k", "p", 3, True, "n") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + names)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r["row"] == f"r{r['doc_id']}" and r["size"] == r["doc_id"] and r["score"] == float(r["doc_id"]) for r in got), name
    assert P.packing(spark, df, str(tmp_path)).count() >= 40
