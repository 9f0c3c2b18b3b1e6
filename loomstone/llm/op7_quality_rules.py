"""Quality rules: repetition coverage.

For each document, rolling hashes of word n-grams of several lengths (numpy, over whole Arrow batches) mark the n-grams
that occur twice or more within it, and the characters inside them are measured against all word characters; lines
that occur twice or more are measured likewise. A document is kept while no coverage is above its threshold and the
base rules hold.

Defined results: a null or empty text has no words, fails the base rule on length and is not kept; repeated rows get
one row each; a document's result depends on nothing else. Columns of the input other than id and text are ignored.
The work is a narrow map: no shuffle, memory bounded by one Arrow batch and a quarter of a megabyte of text (or the words of the
longest text: some 120 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import textvec as V
from loomstone.llm.common import lean, table

#: Largest share of a document's word characters inside repeated n-grams of each length, and inside repeated lines.
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_SHARE = 0.20
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_POINT = (np.arange(256) & 0xC0) != 0x80  # a character's first byte
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_ngram_share double, dup_line_share double, worst_ngram int"
)


def measure(b: V.Block, ngram_share: dict[int, float], line_share: float) -> dict[str, np.ndarray]:
    """The figures of each document of a block."""
    w = V.words(b)
    n_words = np.diff(w.at)
    chars = V.span_counts(lambda i, j: _POINT[b.data[i:j]], len(b.data), w.begin, w.end)
    word_chars = V.per_doc(w.at, chars)
    doc = w.doc
    salt = V.mix(np.arange(b.docs, dtype=V.U) + V.U(1))
    bad = np.zeros(b.docs, bool)
    worst, worst_n, repeat5 = np.zeros(b.docs), np.zeros(b.docs, np.int32), np.zeros(b.docs, np.int64)
    for n in sorted({5, *ngram_share}):
        h, first = V.grams(w, n)
        again = first[pd.Series(h ^ salt[doc[first]]).duplicated(keep=False).to_numpy()]
        size = len(w.hash) + 1
        inside = np.cumsum(np.bincount(again, minlength=size) - np.bincount(again + n, minlength=size))[:-1] > 0
        if n == 5:
            repeat5 = V.per_doc(w.at, inside)
        if n in ngram_share:
            share = V.per_doc(w.at, np.where(inside, chars, 0)) / np.maximum(word_chars, 1)
            bad |= share > ngram_share[n]
            worst_n = np.where(share > worst, n, worst_n).astype(np.int32)
            worst = np.maximum(worst, share)
    row = V.lines(b)
    k0, k1 = np.searchsorted(w.begin, row.begin, "left"), np.searchsorted(w.begin, row.end, "left")
    full = k1 > k0
    of = row.doc
    key = row.hash[full] ^ salt[of[full]]
    earlier = pd.Series(key).duplicated(keep="first").to_numpy()
    twice = pd.Series(key).duplicated(keep=False).to_numpy()
    total = np.concatenate(([0], np.cumsum(chars)))
    line_chars = (total[k1] - total[k0])[full]
    in_lines = np.bincount(of[full], np.where(twice, line_chars, 0), b.docs) / np.maximum(word_chars, 1)
    base_failed = (n_words < 10) | (100 * repeat5 > 20 * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": V.byte_counts(b, _SYMBOL),
        "n_dup_lines": np.bincount(of[full], earlier, b.docs).astype(np.int64), "n_repeat_words": repeat5, "base_failed": base_failed,
        "kept": ~(base_failed | bad | (in_lines > line_share)), "dup_ngram_share": worst, "dup_line_share": in_lines, "worst_ngram": worst_n,
    }


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram_share: dict[int, float] | None = None, line_share: float = MAX_LINE_SHARE) -> DataFrame:
    """One row per document with its figures and the verdict ``kept``."""
    limits = dict(MAX_NGRAM_SHARE if ngram_share is None else ngram_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for b in V.blocks(texts):
                out = measure(b, limits, line_share)
                yield pa.RecordBatch.from_arrays([ids.slice(b.first, b.docs), *map(pa.array, out.values())], ["doc_id", *out])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in SQL: every window as text, counted within its document."""
    spans = " UNION ALL ".join(f"SELECT {n} AS n, {most} AS most" for n, most in MAX_NGRAM_SHARE.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
c AS (SELECT k, len(ws) AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0) AS word_chars FROM w),
p AS (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
spans AS ({spans}),
g AS (SELECT k, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM p JOIN spans ON i + n - 1 <= len(ws)),
twice AS (SELECT k, n, unnest(starts) AS i FROM (SELECT k, n, gram, list(i) AS starts FROM g GROUP BY k, n, gram HAVING count(*) > 1)),
inside AS (SELECT DISTINCT k, n, unnest(range(i, i + n)) AS i FROM twice),
cover AS (SELECT inside.k, n, count(*) AS words, sum(length(ws[i])) AS chars FROM inside JOIN w ON w.k = inside.k GROUP BY inside.k, n),
shares AS (SELECT c.k, s.n, s.most, coalesce(v.chars, 0) / CAST(greatest(word_chars, 1) AS DOUBLE) AS share, coalesce(v.words, 0) AS words FROM c CROSS JOIN spans s LEFT JOIN cover v ON v.k = c.k AND v.n = s.n),
ngrams AS (SELECT k, max(share) AS worst, bool_or(share > most) AS bad, max(CASE WHEN n = 5 THEN words END) AS repeated, coalesce(arg_max(n, share * 1000 - n / 1e6) FILTER (share > 0), 0) AS worst_n FROM shares GROUP BY k),
rows AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT k, line, count(*) AS times, any_value(coalesce(list_sum([length(x) FOR x IN regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')]), 0)) AS chars FROM rows WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k, line),
l AS (SELECT k, sum(times - 1) AS dup, coalesce(sum(times * chars) FILTER (times > 1), 0) AS dup_chars FROM lines GROUP BY k),
f AS (SELECT d.doc_id, n_words, word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, repeated AS n_repeat_words, worst, worst_n, bad,
  coalesce(dup_chars, 0) / CAST(greatest(word_chars, 1) AS DOUBLE) AS line_share, n_words < 10 OR 100 * repeated > 20 * n_words AS base_failed FROM d JOIN c USING (k) JOIN ngrams USING (k) LEFT JOIN l USING (k))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT (base_failed OR bad OR line_share > {MAX_LINE_SHARE}) AS kept, worst AS dup_ngram_share, line_share AS dup_line_share, CAST(worst_n AS INTEGER) AS worst_ngram FROM f"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {"op7_quality_rules": oracle()}
