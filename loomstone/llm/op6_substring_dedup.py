"""Substring dedup: content-defined chunking with a gear rolling hash.

A gear hash of the last 16 bytes (white space counts as a space) rolls over each text. A chunk ends after a word where
that hash is the least among the words within ``REACH`` on either side; so where chunks end depends on some thirty
bytes around only, and after an insertion the old chunks come back within a few words. Chunks have more than REACH
words, about 2 * REACH + 1 on average. Where words repeat with a period of REACH or less, no hash is the least; there a
chunk ends after every ``LONGEST`` words, counted from where the hashes begin to repeat; a text that is nothing
else stays one chunk (and meets only texts equal to it). Each chunk's digest, of 128 bits, covers its words. Rows equal
in id and text are made one before they are cut into chunks.

The first chunk of a digest, in the order of (doc_id, digest of the row, place), stays; later ones are duplicates. Runs of
consecutive duplicate chunks of ``LEAST_WORDS`` words or more in all are removed; shorter ones are what any two texts
may share. Half digests are counted first, before and after a shuffle of nothing else, and a bounded bit map of those that
occur twice lets other chunks stay where they are. For the rest, first places are aggregated per digest and meet the chunks
in a join whose hot keys Spark can split; so a passage that a third of all documents share stays with no one task.

Defined results: null and empty texts have no chunk and stay as they are; rows equal in id and text count as one
document; rows that share an id but not a text are apart; ties have the order above; other columns are kept apart by
name; a very long text takes memory for its words, some 60 bytes a word; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.llm import textvec as V
from loomstone.llm.common import ROW, Scratch, any_row, lean, narrowed, parted, row_keys, table

REACH = 3
LONGEST = 16
LEAST_WORDS = 16
CHUNKS = "doc_id long, row_key long, row_key2 long, place int, digest long, digest2 long, n_words int, begin_byte int, end_byte int"
DIGEST = ["digest", "digest2"]
_OTHER = V.U(0xC2B2AE3D27D4EB4F)
_GEAR = np.random.Generator(np.random.PCG64(65537)).integers(0, 2**32, 256, dtype=np.uint32)
_CLEAN = np.where(V.SPACE, 32, np.arange(256)).astype(np.uint8)


def gear(b: V.Block, places: np.ndarray) -> np.ndarray:
    """The rolling hash after each of these bytes (ascending): the sum of the last 16 bytes' values, each shifted by its distance."""
    out = np.zeros(len(places), np.uint32)
    for s in range(0, len(b.data), V.PIECE):
        e = min(len(b.data), s + V.PIECE)
        i, j = np.searchsorted(places, (s, e), "left")
        low = max(0, s - 15)
        h = _GEAR[_CLEAN[b.data[low:e]]]
        d0, d1 = int(np.searchsorted(b.at, low, "right")) - 1, int(np.searchsorted(b.at, e, "left"))
        within = np.arange(low, e) - np.repeat(b.at[d0:d1], np.diff(np.clip(b.at[d0 : d1 + 1], low, e)))
        for step in (1, 2, 4, 8):
            if step < len(h):
                h[step:] += np.where(within[step:] >= step, h[:-step] << np.uint32(step), 0).astype(np.uint32)
        out[i:j] = h[places[i:j] - low]
    return out


def chunk_ends(b: V.Block, w: V.Spans, reach: int = REACH) -> np.ndarray:
    """Whether a chunk ends after each word. The last word of a document ends one."""
    v = gear(b, w.end - 1) * np.uint32(0x9E3779B1)
    doc = w.doc
    least = np.ones(len(v), bool)
    for d in range(1, reach + 1):
        if len(v) > d:
            same = doc[d:] == doc[:-d]
            least[d:] &= same & (v[d:] < v[:-d])  # a document's first words end no chunk
            least[:-d] &= ~same | (v[:-d] <= v[d:])
            least[:d] = False
    last = w.at[1:][np.diff(w.at) > 0] - 1
    n = len(v)
    again = np.zeros(n, bool)
    for d in range(1, reach + 1):
        if n > d:
            again[d:] |= (doc[d:] == doc[:-d]) & (v[d:] == v[:-d])
    if again.any():
        whole = np.zeros(b.docs, bool)
        for d in range(1, reach + 1):
            if n > d:
                whole |= V.per_doc(w.at, np.append(np.zeros(d, bool), (doc[d:] == doc[:-d]) & (w.hash[d:] != w.hash[:-d]))) == 0
        again &= ~whole[doc]
        place = np.arange(n)
        run = place - np.maximum.accumulate(np.where(again, 0, place))  # words since the hashes began to repeat, 0 elsewhere
        least[: max(n - reach, 0)] |= (run > 0)[: max(n - reach, 0)] & (run % LONGEST == 0)[: max(n - reach, 0)] & (run[reach:] > run[: max(n - reach, 0)])
    for d in range(reach):  # nor do the last ones: a chunk has more than reach words
        near = last - d
        least[near[near >= 0]] = False
    least[last] = True
    return least[:n]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per chunk of every text."""
    text = F.col(text_col).cast("string")
    return _chunks(docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_keys(id_col, text_col), text.alias("text")), reach)


def _chunks(rows: DataFrame, reach: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in V.blocks(batch.column(3)):
                w = V.words(b)
                n = len(w.hash)
                if not n:
                    continue
                end = np.flatnonzero(chunk_ends(b, w, reach)) + 1
                begin = np.concatenate(([0], end[:-1]))
                doc = w.doc[begin]
                digest = V.span_hashes(lambda i, j: w.hash[i:j], n, begin, end)  # noqa: B023
                digest2 = V.span_hashes(lambda i, j: V.mix(w.hash[i:j] ^ _OTHER), n, begin, end)  # noqa: B023
                first = np.searchsorted(doc, np.arange(b.docs), "left")
                place = np.arange(len(doc)) - first[doc]
                last = np.append(doc[1:] != doc[:-1], True)
                following = np.append(w.begin[end[:-1]], 0)
                head = place == 0
                begin_byte = np.where(head, b.at[doc], w.begin[begin]) - b.at[doc]
                end_byte = np.where(last, b.at[doc + 1], following) - b.at[doc]
                taken = pa.array(doc)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).slice(b.first, b.docs).take(taken) for k in range(3)], pa.array(place, pa.int32()), pa.array(digest.view(np.int64)), pa.array(digest2.view(np.int64)),
                    pa.array(end - begin, pa.int32()), pa.array(begin_byte, pa.int32()), pa.array(end_byte, pa.int32()),
                ], ["doc_id", "row_key", "row_key2", "place", "digest", "digest2", "n_words", "begin_byte", "end_byte"])

    return rows.where(F.length("text") > 0).mapInArrow(lean(run), CHUNKS)


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    return row_keys(id_col, text_col)[0]


def once(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """doc_id, row_key, row_key2 and text of docs, rows equal in id and text once. Only rows that may have an equal one are
    moved, after those of a task were made one."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    again = scratch.cut(rows.groupBy(*ROW).count().where("count > 1").select("row_key"), "again")
    if not any_row(again):
        return rows
    some, rest = parted(rows, "row_key", again, "row_key")
    return rest.unionByName(some.dropDuplicates(ROW))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, least_words: int = LEAST_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """The spans to remove: doc_id, row_key and row_key2, begin_byte, end_byte, n_words, n_chunks, and first_doc_id, where
    the first chunk of the span occurs first."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    c = scratch.cut(_chunks(once(docs, id_col, text_col, scratch), reach), "chunks")
    here = F.struct("doc_id", *ROW, "place")
    again = scratch.cut(c.groupBy("digest").count().where("count > 1").select("digest"), "again")
    some = narrowed(c, "digest", again, "digest")  # all chunks that occur twice, and perhaps others
    first = some.groupBy(*DIGEST).agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*DIGEST, "first")
    first = scratch.cut(first, "first")
    later = some.join(first, DIGEST).where(here > F.col("first"))
    runs = later.withColumn("run", F.col("place") - F.row_number().over(W.partitionBy("doc_id", *ROW).orderBy("place")))
    spans = runs.groupBy("doc_id", *ROW, "run").agg(
        F.min("begin_byte").alias("begin_byte"), F.max("end_byte").alias("end_byte"), F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_chunks"),
        F.min(F.struct("place", "first"))["first"]["doc_id"].alias("first_doc_id"),
    )
    return spans.where(F.col("n_words") >= least_words).drop("run")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans cut out of their texts; all rows and columns stay."""
    cuts = spans.groupBy(*ROW).agg(F.array_sort(F.collect_set(F.struct("begin_byte", "end_byte"))).alias("cuts"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_keys(id_col, text_col))
    joined = rows.join(cuts, ROW, "left")
    # between cuts, from the end of one to the beginning of the next, in bytes
    whole = F.col("row")[text_col]
    raw = whole.cast("binary")
    ends = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda x: x["end_byte"]))
    begins = F.concat(F.transform("cuts", lambda x: x["begin_byte"]), F.array(F.octet_length(whole)))
    left = F.zip_with(ends, begins, lambda a, z: F.substring(raw, a + 1, F.greatest(z - a, F.lit(0))))
    text = F.when(F.col("cuts").isNull(), whole).otherwise(F.aggregate(left, F.lit("").cast("binary"), lambda x, y: F.concat(x, y)).cast("string"))
    return joined.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop(*ROW)


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
