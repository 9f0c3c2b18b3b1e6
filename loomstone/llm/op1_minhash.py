"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct 5-word shingles. Documents with equal sets (by a digest of 128 bits) are one node, which has
a number of its own. Every node has a signature of
128 minima, cut into 32 bands of 4; nodes that agree in a band are candidates (a pair at the threshold is missed with
probability (1 - 0.75^4)^32, about 5e-6). A candidate's signatures are compared 32 minima at a time; after each batch the
posterior of the similarity (uniform prior) decides, and a pair whose probability of reaching the threshold is below
``MISS`` is dropped. Survivors are confirmed on the full sets.

No group emits all its pairs. Round one compares each member of a bucket with the bucket's first member only, then with
the member that has most links. Links give components. Round two takes buckets that still hold several components, and compares members outside of the bucket's
largest component with the members of other components: every pair that could still join two components, and no other.
Large buckets do that in blocks of 512 by 512 inside a task, which confirm what survives there and give out links only. The last components come from
hooking to smaller neighbours and pointer jumping over written tables.

Skew: copies meet in aggregates that combine before the shuffle; joins on a bucket, a first member or a root are between
written tables, so Spark can split their hot keys. Nothing is collected but counts.

Defined results: a text without words (or null) has an empty set, is linked with nothing and is its own component; with
fewer words than five the whole sequence is the one shingle; repeated rows and rows that share an id are documents like
others; a null id takes part, and is a component's id only where it has no other; other columns are not looked at and may
have any name; a very long text is hashed in pieces and takes memory for its words, some 60 bytes a word; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import textvec as V
from loomstone.llm.common import ROW, Scratch, any_row, lean, narrowed, row_keys, table

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
BATCH = 32
MISS = 1e-6
SMALL_BUCKET = 64
BLOCK = 512
_K = BANDS * ROWS
_FACTORS = np.random.Generator(np.random.PCG64(1009)).integers(0, 2**63, _K, dtype=V.U) * V.U(2) + V.U(1)
SETS = "doc_id long, row_key long, row_key2 long, n_shingles long, k1 long, k2 long, signature binary"


def shingle_sets(b: V.Block, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, ascending, one document after the other; and where each begins."""
    w = V.words(b, V.lower_ascii(b.data))
    count = np.diff(w.at)
    h, first = V.grams(w, n)
    if b.docs == 1 and count[0] >= n:  # perhaps a very long text
        del w, first
        h = np.unique(h)
        return h, np.array([0, len(h)])
    doc = w.doc[first] if len(first) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.full(len(short), V.U(n))
        for j in range(n - 1):
            has = count[short] > j
            whole[has] = V.mix(whole[has] * V.U(V._STEP) + w.hash[w.at[short[has]] + j])
        h, doc = np.concatenate((h, whole)), np.concatenate((doc, short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(b.docs + 1), "left")


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minima of the sets that aren't empty, a row of _K unsigned 32-bit numbers each."""
    begin = at[:-1][np.diff(at) > 0]
    out = np.empty((len(begin), _K), np.uint32)
    for k in range(_K):
        out[:, k] = np.minimum.reduceat(((h * _FACTORS[k]) >> V.U(32)).astype(np.uint32), begin) if len(begin) else 0
    return out


def digests(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    n = np.diff(at)
    k1, k2 = np.zeros(len(n), V.U), np.zeros(len(n), V.U)
    full = n > 0
    if full.any():
        k1[full] = np.add.reduceat(V.mix(h ^ V.U(0xA5A5A5A5)), at[:-1][full])
        k2[full] = np.bitwise_xor.reduceat(V.mix(h ^ V.U(0x5A5A5A5A5A)), at[:-1][full])
    return V.mix(k1 + n.astype(V.U)), k2


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the size of its set, a 128-bit digest of it (k1, k2) and its signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in V.blocks(batch.column(3)):
                h, at = shingle_sets(b)
                n = np.diff(at)
                full = n > 0
                k1, k2 = digests(h, at)
                s = iter(signatures(h, at))
                signature = pa.array([next(s).astype("<u4").tobytes() if f else None for f in full], pa.binary())
                part = batch.slice(b.first, b.docs)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(3)], pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), signature], ["doc_id", "row_key", "row_key2", "n_shingles", "k1", "k2", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), SETS)


def full_sets(texts: DataFrame) -> DataFrame:
    """From node and text to node and the set itself (binary, ascending 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in V.blocks(batch.column(1)):
                h, at = shingle_sets(b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.docs), pa.array([h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "members"])

    return texts.mapInArrow(lean(run), "node long, members binary")


@lru_cache
def least_matches(threshold: float = PERCENT / 100, miss: float = MISS, batch: int = BATCH, total: int = _K) -> dict[int, int]:
    """After n minima compared, the fewest matches m at which the posterior, Beta(m + 1, n - m + 1), still gives the
    threshold or more a probability of ``miss``: that is P(Binomial(n + 1, threshold) <= m)."""
    out = {}
    for n in range(batch, total + 1, batch):
        log = [lgamma(n + 2) - lgamma(i + 1) - lgamma(n + 2 - i) + i * np.log(threshold) + (n + 1 - i) * np.log(1 - threshold) for i in range(n + 2)]
        out[n] = int(np.searchsorted(np.cumsum(np.exp(log)), miss, "left"))
    return out


def pruned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of signature rows that no batch of minima rules out."""
    alive, match = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in least_matches().items():
        match[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
        alive = alive[match[alive] >= least]
    return alive


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (ascending) reach the threshold."""
    z = np.concatenate((x, y))
    z.sort(kind="stable")
    both = int(np.count_nonzero(z[1:] == z[:-1]))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def sizes_fit(a, b):
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _signature_check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, _K) for i in (2, 3))
        keep = pa.array(pruned(a, b))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])


def _set_check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            ok.append(similar(np.frombuffer(x.as_buffer(), V.U), np.frombuffer(y.as_buffer(), V.U)))
        keep = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])


class NearDuplicates:
    """The steps over one corpus; every table is written before the next one reads it."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, small_bucket: int = SMALL_BUCKET):
        self.docs, self.id_col, self.text_col, self.scratch, self.small_bucket = docs, id_col, text_col, scratch, small_bucket

    def nodes(self) -> None:
        """Documents with equal sets as one node, numbered where the table is written: equal numbers are equal sets."""
        heavy = self.scratch.cut(document_sets(self.docs, self.id_col, self.text_col), "documents")
        n = heavy.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("label"), F.min(F.struct(*ROW)).alias("row"), F.first("signature").alias("signature"))
        self.node = self.scratch.cut(n.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "n_shingles", "label", "row.row_key", "row.row_key2", "signature"), "nodes")
        bands = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("signature", 1 + 4 * ROWS * i, 4 * ROWS)) for i in range(BANDS)]))
        in_bands = self.node.select("node", bands.alias("bucket"))
        heads = in_bands.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("high"))
        heads = self.scratch.cut(heads.where("head <> high").select("bucket", "head"), "heads")
        self.members = self.scratch.cut(in_bands.join(heads, "bucket"), "members")
        # full sets of the nodes that have a candidate, one row of each
        wanted = self.members.select(F.col("node").alias("w_node")).distinct()
        wanted = self.scratch.cut(self.node.drop("label").join(wanted, F.col("node") == F.col("w_node"), "left_semi"), "wanted")
        self.signature = wanted.select("node", "n_shingles", "signature")
        texts = narrowed(self.docs.select(*row_keys(self.id_col, self.text_col), F.col(self.text_col).cast("string").alias("text")), "row_key", wanted, "row_key")
        texts = texts.join(wanted.select(*ROW, "node"), ROW).select("node", "text")
        self.sets = self.scratch.cut(full_sets(texts).dropDuplicates(["node"]), "sets")
        self.documents = self.scratch.cut(heavy.drop("signature"), "documents")
        self.node = self.scratch.cut(self.node.drop("signature", "row_key", "row_key2"), "labelled")
        self.scratch.drop(heavy, heads)

    def signed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes that the sequential test leaves."""
        pairs = self.scratch.cut(pairs, "pairs")
        side = lambda c: self.signature.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(sizes_fit(F.col("n_a"), F.col("n_b"))).select("a", "b", "s_a", "s_b")
        return both.mapInArrow(lean(_signature_check), "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        pairs = self.scratch.cut(pairs, "survivors")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        sets = narrowed(self.sets, "node", nodes, "node")
        side = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"s_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")
        return self.scratch.cut(both.mapInArrow(lean(_set_check), "a long, b long"), "links")

    def first_round(self) -> DataFrame:
        """Links between members and the first member of a bucket; then, in buckets whose members are still apart, between
        members and the one with most links so far, which is the likeliest centre of a group of copies."""
        links = self.confirmed(self.signed(self.members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()))
        degree = links.select(F.explode(F.array("a", "b")).alias("d_node")).groupBy("d_node").agg(F.count(F.lit(1)).alias("degree"))
        m = self.apart(components(links, self.scratch))
        ranked = m.join(self.scratch.cut(degree, "degrees"), F.col("node") == F.col("d_node"))
        centre = self.scratch.cut(ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node", "root")).alias("c")).select("bucket", F.col("c.node").alias("centre"), F.col("c.root").alias("c_root")), "centres")
        again = m.join(centre, "bucket").where(F.col("root") != F.col("c_root")).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
        return self.scratch.cut(links.unionByName(self.confirmed(self.signed(again))), "links")

    def apart(self, roots: DataFrame) -> DataFrame:
        """Members of buckets that hold several components: bucket, node, root, main (the root of most), n and n_main."""
        m = self.members.select("bucket", "node").join(roots.select(F.col("node").alias("in_node"), "root"), F.col("node") == F.col("in_node"), "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        counts = m.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("parts"), F.max("count").alias("n_main"))
        counts = self.scratch.cut(counts.where("parts > 1").drop("parts"), "open")
        return self.scratch.cut(m.join(counts, "bucket"), "open_members")

    def second_round(self, roots: DataFrame) -> DataFrame:
        """Links between different components (roots: node, root) in one bucket."""
        m = self.apart(roots)
        if not any_row(m):
            return m.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0)
        out = m.where(F.col("root") != F.col("main"))
        other = m.select("bucket", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("main").alias("main_b"))
        cross = (F.col("root") != F.col("root_b")) & ((F.col("root_b") == F.col("main_b")) | (F.col("node") < F.col("b")))
        small = out.where(F.col("n") <= self.small_bucket).join(other, "bucket").where(cross).select(F.col("node").alias("a"), "b").distinct()
        links = self.confirmed(self.signed(small))
        large = m.where(F.col("n") > self.small_bucket)
        return self.scratch.cut(links.unionByName(self.in_blocks(large)), "links") if any_row(large) else links

    def in_blocks(self, m: DataFrame) -> DataFrame:
        """Links across components in large buckets, found block by block; of the links of a node to one component in a block,
        the first. A pair is looked at in the first band that it shares."""
        m = m.join(self.signature.withColumnRenamed("node", "s_node"), F.col("node") == F.col("s_node")).drop("s_node")
        m = m.join(self.sets.withColumnRenamed("node", "m_node"), F.col("node") == F.col("m_node")).drop("m_node")
        many = lambda n: F.ceil(n / BLOCK).cast("int")
        rows_n, cols_n = many(F.col("n") - F.col("n_main")), many(F.col("n"))
        own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        rows = m.where(F.col("root") != F.col("main")).withColumn("i", own(1, rows_n)).withColumn("j", upto(cols_n))
        cols = m.withColumn("j", own(2, cols_n)).withColumn("i", upto(rows_n))
        key = ["bucket", "i", "j"]
        columns = [*key, "node", "root", "main", "n_shingles", "signature", "members"]

        def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(x) and len(y):
                y.columns = columns
                sx, sy = (np.frombuffer(b"".join(z["signature"]), "<u4").reshape(-1, _K) for z in (x, y))
                node_y, root_y, size_y = (y[c].to_numpy() for c in ("node", "root", "n_shingles"))
                sets_y = [np.frombuffer(s, V.U) for s in y["members"]]
                main = y["main"].to_numpy() == root_y
                shared = (sx[0].reshape(BANDS, ROWS) == sy[0].reshape(BANDS, ROWS)).all(axis=1)
                for z in (sx, sy):
                    shared &= (z.reshape(-1, BANDS, ROWS) == sx[0].reshape(BANDS, ROWS)).all(axis=2).all(axis=0)
                band = int(np.argmax(shared))  # members of a bucket share its band; if they share several, the first will do
                for i, r in enumerate(x.itertuples()):
                    fits = (root_y != r.root) & (main | (node_y > r.node)) & (100 * np.minimum(size_y, r.n_shingles) >= PERCENT * np.maximum(size_y, r.n_shingles))
                    at = np.flatnonzero(fits)
                    if band:
                        earlier = (sy[at, : band * ROWS] == sx[i, : band * ROWS]).reshape(-1, band, ROWS).all(axis=2).any(axis=1)
                        at = at[~earlier]
                    at = at[pruned(np.broadcast_to(sx[i], (len(at), _K)), sy[at])]
                    own_set, linked = np.frombuffer(r.members, V.U), set()
                    for k in at:
                        if root_y[k] not in linked and similar(own_set, sets_y[k]):
                            linked.add(root_y[k])
                            found.append((r.node, node_y[k]))
            return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

        cols = cols.select(*[F.col(c).alias(f"{c}_y") for c in columns])  # both sides come from one table
        return rows.select(*columns).groupBy(*key).cogroup(cols.groupBy(*[f"{c}_y" for c in key])).applyInPandas(compare, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root of every node in links (a, b): each component has one root, its smallest node.

    Every node hooks to its smallest smaller neighbour; pointers jump until all show roots; links between roots are what
    is left, and the next turn works on those."""
    e = scratch.cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    roots = scratch.cut(e.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while any_row(e):
        p = scratch.cut(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "parents")
        while True:
            up = p.select(F.col("node").alias("up_node"), F.col("root").alias("up_root"))
            q = scratch.cut(p.join(up, F.col("root") == F.col("up_node"), "left").select("node", F.coalesce("up_root", "root").alias("root"), F.col("up_root").isNotNull().alias("moved")), "parents")
            scratch.drop(p)
            p = q
            if not any_row(p.where("moved")):
                break
        p = p.select("node", "root")
        to = p.select(F.col("node").alias("was"), F.col("root").alias("becomes"))
        nxt = e.join(to, F.col("hi") == F.col("was"), "left").select(F.coalesce("becomes", "hi").alias("hi"), "lo")
        nxt = nxt.join(to, F.col("lo") == F.col("was"), "left").select("hi", F.coalesce("becomes", "lo").alias("lo")).where("hi <> lo")
        nxt = scratch.cut(nxt.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
        roots = scratch.cut(roots.join(to, F.col("root") == F.col("was"), "left").select("node", F.coalesce("becomes", "root").alias("root")), "roots")
        e = nxt
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept, and row_key and row_key2 (a digest of id and text) and root (a
    number of the component; null for an empty set)."""
    own, scratch = scratch is None, scratch or Scratch(docs.sparkSession, "minhash")
    s = NearDuplicates(docs, id_col, text_col, scratch, small_bucket)
    s.nodes()
    links = s.first_round()
    roots = components(links, scratch)
    more = s.second_round(roots)
    if any_row(more):
        roots = components(links.unionByName(more), scratch)
    label = s.node.select("node", "label").join(roots, "node").groupBy("root").agg(F.min("label").alias("component_id"))
    label = scratch.cut(label, "labels")
    of = roots.select("node", F.col("root").alias("of")).join(label, F.col("of") == F.col("root")).select(F.col("node").alias("in_node"), "root", "component_id")
    of = s.node.join(of, F.col("node") == F.col("in_node"), "left").select("k1", "k2", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "label").alias("component_id"))
    of = scratch.cut(of, "of")
    if own:
        scratch.keep_only(of, s.documents)
    of = of.withColumnsRenamed({"k1": "of_k1", "k2": "of_k2"})
    out = s.documents.join(of, (F.col("n_shingles") > 0) & (F.col("k1") == F.col("of_k1")) & (F.col("k2") == F.col("of_k2")), "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *ROW, "root")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop(*ROW, "root")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.first, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.first, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
QUERIES = {"op1_minhash": op1_minhash}
ORACLE_SQL = {"op1_minhash": SQL}
