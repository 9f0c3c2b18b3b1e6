"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document has some twenty statistics, transformed by logarithms and square roots so that they are about normal.
Learning takes moments (count, sums, products) of all labelled rows, summed where the rows are; the driver sees one
matrix per class. Each class covariance is shrunk towards the pooled one and that towards its diagonal; its Cholesky factor is
kept, and a score is the logistic of the difference of the two log densities (Mahalanobis distance, determinant, prior).

Defined results: a null text counts as empty and is scored like any other; labels other than 0 and 1, without an id, or
contradicting one another for an id, teach nothing; with fewer than two rows of a class every score is the share of
label 1 (0.5 without labels); repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import textvec as V
from loomstone.llm.common import Scratch, crc_mod, lean, table

STATISTICS = (
    "chars words word_length word_spread upper digit punctuation beyond_ascii symbol line_length short_words distinct_words top_word "
    "repeated_words repeated_lines plain_lines capital_words letterless_words stops longest_word entropy bracket quote"
).split()
TO_POOLED, TO_DIAGONAL = 0.30, 0.10
SCHEMA = "doc_id long, held_out boolean, stats array<double>"


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_PUNCT = _table(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_SYMBOL, _BRACKET, _QUOTE, _STOP = _table(b"#*$%&|<>@\\^~_=+"), _table(b"()[]{}"), _table(b"\"'`"), _table(b".!?")


def statistics(b: V.Block) -> np.ndarray:
    """One row per document of a block, one column per entry of STATISTICS."""
    w, rows = V.words(b), V.lines(b)
    size = np.maximum(np.diff(b.at), 1)
    n = np.diff(w.at)
    n1 = np.maximum(n, 1)
    share = lambda t: np.sqrt(V.byte_counts(b, t) / size)
    length = w.end - w.begin
    mean = V.per_doc(w.at, length) / n1
    spread = np.sqrt(np.maximum(V.per_doc(w.at, length * length) / n1 - mean * mean, 0))
    doc = w.doc
    salt = V.mix(np.arange(b.docs, dtype=V.U) + V.U(1))
    codes, _ = pd.factorize(w.hash ^ salt[doc])
    count = np.bincount(codes) if len(codes) else np.zeros(0, int)
    first = np.zeros(len(codes), bool)
    first[np.unique(codes, return_index=True)[1]] = True
    top = np.zeros(b.docs)
    np.maximum.at(top, doc, count[codes] if len(codes) else np.zeros(0))
    longest = np.zeros(b.docs)
    np.maximum.at(longest, doc, length)
    h, at = V.grams(w, 3)
    again = np.zeros(len(w.hash))
    again[at] = pd.Series(h ^ salt[doc[at]]).duplicated(keep="first").to_numpy()
    full = np.searchsorted(w.begin, rows.end, "left") > np.searchsorted(w.begin, rows.begin, "left")
    of = rows.doc
    n_lines = np.maximum(np.bincount(of, full, b.docs), 1)
    twice = np.zeros(len(of), bool)
    twice[full] = pd.Series(rows.hash[full] ^ salt[of[full]]).duplicated(keep="first").to_numpy()
    last = b.data[np.maximum(rows.end - 1, 0)] if len(b.data) else np.zeros(len(of), np.uint8)
    plain = full & ~_STOP[last]
    letters = V.span_counts(lambda i, j: _LETTER[b.data[i:j]], len(b.data), w.begin, w.end)
    begin = b.data[w.begin] if len(w.begin) else np.zeros(0, np.uint8)
    cells = np.zeros((b.docs, 256))
    for lo in range(0, len(b.data), V.PIECE):
        hi = min(len(b.data), lo + V.PIECE)
        d0, d1 = int(np.searchsorted(b.at, lo, "right")) - 1, int(np.searchsorted(b.at, hi, "left"))
        where = np.repeat(np.arange(d1 - d0), np.diff(np.clip(b.at[d0 : d1 + 1], lo, hi)))
        cells[d0:d1] += np.bincount(where * 256 + b.data[lo:hi], minlength=(d1 - d0) * 256).reshape(-1, 256)
    cells /= size[:, None]
    entropy = -(cells * np.log(np.maximum(cells, 1e-12))).sum(axis=1)
    out = [
        np.log1p(size), np.log1p(n), np.log1p(mean), np.log1p(spread), share(_UPPER), share(_DIGIT), share(_PUNCT), share(np.arange(256) >= 128), share(_SYMBOL),
        np.log1p(size / n_lines), np.sqrt(V.per_doc(w.at, length <= 3) / n1), V.per_doc(w.at, first) / n1, np.sqrt(top / n1), np.sqrt(V.per_doc(w.at, again) / n1),
        np.sqrt(np.bincount(of, twice, b.docs) / n_lines), np.sqrt(np.bincount(of, plain, b.docs) / n_lines), np.sqrt(V.per_doc(w.at, _UPPER[begin]) / n1),
        np.sqrt(V.per_doc(w.at, letters == 0) / n1), np.sqrt(V.byte_counts(b, _STOP) / n1), np.log1p(longest), entropy, share(_BRACKET), share(_QUOTE),
    ]
    return np.column_stack(out)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in V.blocks(batch.column(2)):
                s = statistics(b)
                arrays = pa.ListArray.from_arrays(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32), s.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.docs), batch.column(1).slice(b.first, b.docs), arrays], ["doc_id", "held_out", "stats"])

    held_out = crc_mod(id_col, 3) == 1
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)


@dataclass
class Discriminant:
    """Per class: mean, the inverse of the Cholesky factor of its covariance, and the constant of its log density."""

    means: list[np.ndarray]
    roots: list[np.ndarray]
    constants: list[float]
    default: float = 0.5

    @classmethod
    def of_moments(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
        """moments: class -> count, sums, sums of products."""
        count = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
        total = sum(count.values())
        if min(count.values()) < 2:
            return cls([], [], [], count[1] / total if total else 0.5)
        mean = {k: moments[k][1] / count[k] for k in (0, 1)}
        cov = {k: moments[k][2] / count[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
        pooled = sum(count[k] * cov[k] for k in (0, 1)) / total
        floor = 1e-6 + 1e-4 * np.diag(pooled)
        out = cls([], [], [])
        for k in (0, 1):
            c = (1 - to_pooled) * cov[k] + to_pooled * pooled
            c = (1 - to_diagonal) * c + np.diag(to_diagonal * np.diag(pooled) + floor)
            root = np.linalg.cholesky(c)
            out.means.append(mean[k])
            out.roots.append(np.linalg.inv(root))
            out.constants.append(float(np.log(count[k] / total) - np.log(np.diag(root)).sum()))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.default)
        d = [c - 0.5 * (((x - m) @ r.T) ** 2).sum(axis=1) for m, r, c in zip(self.means, self.roots, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(d[1] - d[0], -500, 500)))


def learn(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant:
    """From all rows of stats that have one label. Sums of products leave the executors one row per class, entry and task."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").alias("label_id"))
    y = y.agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z").select("label_id", F.col("y").cast("int").alias("y"))
    d = len(STATISTICS)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + len(upper[0])))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                z = x[y == k]
                sums[k] += np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z)[upper]))
        k, i = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(sums.ravel())], ["y", "i", "v"])

    joined = stats.join(y, stats["doc_id"] == y["label_id"]).select("y", "stats")
    found = joined.mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + d + len(upper[0])))
    for r in found:
        sums[r["y"], r["i"]] = r["v"]
    moments = {}
    for k in (0, 1):
        square = np.zeros((d, d))
        square[upper] = sums[k, 1 + d :]
        moments[k] = (sums[k, 0], sums[k, 1 : 1 + d], square + np.triu(square, 1).T)
    return Discriminant.of_moments(moments)


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    stats = (scratch or Scratch(docs.sparkSession, "quality")).cut(document_statistics(docs), "statistics")
    kept = labels.where(crc_mod("doc_id", 3) != 1)
    model = learn(stats.where("not held_out"), kept)
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
