"""A training corpus from documents: STAGES in order, each over all rows that its predecessor kept.

Counted as part of the subpackage of training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from loomstone.llm import op1_minhash, op2_mixing, op3_language_id, op4_packing, op6_substring_dedup
from loomstone.llm.common import ROW, Scratch
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Below this score or this likeness a language is not believed.
LEAST_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled rows teach; rejects those without a letter and those whose language
    is not believed, as their letters are unlike those of the texts that teach it. With nothing to learn from, it rejects only
    null texts and those without a letter. Every row is judged by its text alone, so repeated rows stay together; other columns
    pass, whatever their names; long texts are read in pieces; an empty table stays empty."""
    model = op3_language_id.train(docs.where(op3_language_id.crc_mod("doc_id", 4) != 2))
    return op3_language_id.keep_believed(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of documents that are linked, that with the smallest doc_id (a null id is the largest; of
    equal ids the smallest digest of the row), and of rows equal in id and text one. Texts without words stay, each different
    row once. Rows move as structs, so extra columns may have any name; memory is that of the operator."""
    found = op1_minhash.near_duplicates(docs)
    one = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks_id"), "doc_id", *ROW)).alias("one"))
    alone = found.where("root is null").select(*ROW)  # texts without words are linked with nothing
    kept = Scratch(spark, "kept").cut(one.select(*[f"one.{c}" for c in ROW]).unionByName(alone).distinct(), "keys")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *op1_minhash.row_keys())
    return keyed.join(kept, ROW, "left_semi").dropDuplicates(ROW).select("row.*")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated spans out of the texts; a document of which no word is left goes, as does a null or empty text. n_chars
    follows the text. Rows equal in id and text are cut alike; other columns pass, whatever their names."""
    scratch = Scratch(spark, "spans")
    spans = scratch.cut(op6_substring_dedup.repeated_spans(docs, scratch=scratch), "spans")
    scratch.keep_only(spans)
    cut = op6_substring_dedup.remove_spans(docs, spans)
    return cut.where(F.col("text").rlike(op2_mixing.WORD)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents as the target weights of their sources ask for, and keeps the mean logarithm of their
    lengths, so that the mixture of sources does not shift how long documents are. A null source is a source; a null or empty
    text has no words and goes; ties (equal ids and sizes) are interchangeable; other columns pass, whatever their names; an
    empty table stays empty."""
    mixed = op2_mixing.materialise(docs, covariate=op2_mixing.log_size)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens: a row per piece. A null or empty text is a piece that holds the end
    id only; repeated rows are packed once each; only id and text are read; an empty table gives no row."""
    return op4_packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("mixture", mixture),
    ("packing", packing),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = scratch.cut(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
