"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard, searched by beams.

Vectors that are equal share one node; a node keeps the smallest ids of its copies, one more than are asked for, which is
all that a result can show of them. Nodes are dealt by a digest to shards, all of one dimension, of a size that grows with the
root of their number (``shard_size``).
A shard's vectors get one more component, which makes all lengths equal, so that the largest inner product is the
smallest distance. Its graph is built in batches: a greedy beam search of the graph so far proposes neighbours, relaxed
pruning drops those that a kept, closer one covers (by the factor ``ALPHA``), reverse edges are added and pruned alike.
Graphs are written as rows; queries, in blocks of ``QUERY_BLOCK``, meet every shard's graph and search it by beams, and
the best of all shards are scored exactly in double precision and ranked.

Memory of a task: one shard, its graph, and one block of queries. Every node is in exactly one graph, and a last pass
links nodes that no beam from the entry reaches, so none is lost.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component take no part, nor do rows
without an id; vectors of different lengths are not compared; a repeated id stands for each of its vectors; fewer
candidates than asked for give fewer rows; other columns may have any name; an empty table gives none. Every dimension that
occurs is one row of the plan, which the driver holds.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.llm.common import Scratch, spread, table

K = 20
QUERY_STEP = 20
SHARD = 8192
LARGEST_SHARD = 1 << 17
QUERY_BLOCK = 2048
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
UNEVEN = 16  # times the median length


def shard_size(n: int) -> int:
    """Nodes of a shard: ``SHARD`` up to some millions of vectors, then growing with the root of their number, so that the
    number of shards which each query must search grows with the root as well."""
    return min(LARGEST_SHARD, max(SHARD, 4 * isqrt(n)))


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have the same length, scaled to 1. In single precision, or in double if the
    longest vector is so much longer than most that distances among these would be lost in rounding."""
    x = x / (np.abs(x).max(initial=0) or 1.0)
    n = np.einsum("ij,ij->i", x, x)
    most = n.max(initial=0) or 1.0
    kind = np.float32 if most <= UNEVEN**2 * np.median(n) else np.float64
    return (np.column_stack((x, np.sqrt(np.maximum(most - n, 0)))) / np.sqrt(most)).astype(kind)


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For every query the ``beam`` nodes found nearest (largest product first, -1 where none). edges: node by degree, -1 padded.
    All queries advance together; each step follows each query's ``expand`` best nodes that it has not followed."""
    q, n = len(queries), len(x)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    ids = np.full((q, beam), n)
    near = np.full((q, beam), -np.inf, x.dtype)
    done = np.ones((q, beam), bool)
    e = entries[:beam]
    ids[:, : len(e)], near[:, : len(e)], done[:, : len(e)] = e, queries @ x[e].T, False
    seen[:, e] = True
    active = np.arange(q)
    while len(active):
        rank = np.argsort(np.where(done[active], np.inf, -near[active]), axis=1, kind="stable")[:, :expand]
        front = np.take_along_axis(ids[active], rank, 1)
        front = np.where(np.take_along_axis(done[active], rank, 1), n, front)
        done[active[:, None], rank] = True
        new = np.where(front[:, :, None] < n, edges[np.minimum(front, n - 1)], -1).reshape(len(active), -1)
        new = np.where(new < 0, n, new)
        new.sort(axis=1)
        fresh = ~seen[active[:, None], new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[active[:, None], new] = True
        row, col = np.nonzero(fresh)
        at = new[row, col]
        width = int(fresh.sum(axis=1).max(initial=0))
        if width:
            more = np.full((len(active), width), n)
            score = np.full((len(active), width), -np.inf, x.dtype)
            place = (np.cumsum(fresh, axis=1) - 1)[row, col]
            more[row, place] = at
            score[row, place] = np.einsum("ij,ij->i", queries[active[row]], x[at])
            all_ids, all_near = np.concatenate((ids[active], more), 1), np.concatenate((near[active], score), 1)
            all_done = np.concatenate((done[active], more >= n), 1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            ids[active], near[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_near, all_done))
        active = active[(~done[active]).any(axis=1)]
    return np.where(ids < n, ids, -1), near


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node its neighbours among candidates (-1 padded): the closest one, then the closest that no kept one is
    ``alpha`` times closer to than the node, and so on; places that stay free go to the closest of the dropped."""
    n = len(nodes)
    c = np.where(candidates == nodes[:, None], -1, candidates)
    order = np.argsort(np.where(c < 0, np.iinfo(np.int64).max, c), axis=1, kind="stable")
    c = np.take_along_axis(c, order, 1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    v = x[np.maximum(c, 0)]
    d = np.where(c < 0, np.inf, 2 - 2 * np.einsum("nd,ncd->nc", x[nodes], v))
    order = np.argsort(d, axis=1, kind="stable")
    c, d, v = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    d = np.maximum(d, 0)
    between = np.maximum(2 - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    live = np.isfinite(d)
    out = np.full((n, degree), -1)
    count = np.zeros(n, int)
    rows = np.arange(n)
    left = live.copy()
    for _ in range(degree):
        if not left.any():
            break
        k = np.argmax(left, axis=1)
        has = left[rows, k]
        out[rows[has], count[has]] = c[rows[has], k[has]]
        count += has
        left[rows[has], k[has]] = False
        live[rows[has], k[has]] = False
        left &= ~(has[:, None] & (alpha * alpha * between[rows, k] <= d))
    for j in range(c.shape[1]):
        spare = live[:, j] & (count < degree)
        out[rows[spare], count[spare]] = c[spare, j]
        count += spare
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node by degree, -1 padded) and entry nodes of a shard."""
    x = lifted(vectors)
    n = len(x)
    centre = x.mean(axis=0)
    start = int(np.argmax(x @ centre))
    order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    edges = np.full((n, degree), -1)
    done = min(n, degree + 1)
    first = order[:done]
    for a in first:
        others = first[first != a][:degree]
        edges[a, : len(others)] = others
    entries = np.array([start])
    while done < n:
        batch = order[done : done + max(16, min(512, done))]
        found, _ = beam_search(x, edges, entries, x[batch], beam)
        edges[batch] = robust_prune(x, batch, found, degree, alpha)
        a, b = np.repeat(batch, degree), edges[batch].ravel()
        a, b = a[b >= 0], b[b >= 0]
        turn = np.argsort(b, kind="stable")
        a, b = a[turn], b[turn]
        to, at, many = np.unique(b, return_index=True, return_counts=True)
        have = (edges[to] >= 0).sum(axis=1)
        slot = np.arange(len(b)) - np.repeat(at, many)
        easy = np.repeat(have + many <= degree, many)
        edges[b[easy], np.repeat(have, many)[easy] + slot[easy]] = a[easy]
        for lo in range(0, len(hard := np.flatnonzero(have + many > degree)), 256):
            part = hard[lo : lo + 256]
            width = int(many[part].max())
            more = np.full((len(part), width), -1)
            for i, h in enumerate(part):
                more[i, : many[h]] = a[at[h] : at[h] + many[h]]
            edges[to[part]] = robust_prune(x, to[part], np.concatenate((edges[to[part]], more), 1), degree, alpha)
        done += len(batch)
    return edges, np.concatenate((entries, unreached(edges, start)))


def unreached(edges: np.ndarray, start: int) -> np.ndarray:
    """One node of each part of the graph that walks from start don't reach; they become entries too."""
    reached = np.zeros(len(edges), bool)
    out: list[int] = []
    todo = np.array([start])
    while True:
        while len(todo):
            reached[todo] = True
            nxt = np.unique(edges[todo])
            todo = nxt[(nxt >= 0) & ~reached[nxt]]
        rest = np.flatnonzero(~reached)
        if not len(rest):
            return np.array(out, int)
        out.append(int(rest[0]))
        todo = rest[:1]


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part: id, and vec in double precision without negative zeros."""
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    r = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
    good = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("vec", lambda c: c != 0)
    return r.where(good).withColumn("vec", F.transform("vec", lambda c: c + F.lit(0.0)))


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: dim, vec, and the k + 1 smallest ids of each (limited before the shuffle too)."""
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.size("vec").alias("dim"), "vec", "ids")


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", shard: int | None = None, query_block: int = QUERY_BLOCK, degree: int = DEGREE, beam: int = SEARCH_BEAM, scratch: Scratch | None = None) -> DataFrame:
    """Each query row's k nearest other rows: query_id, rank, vec_id, score. is_query: a condition on the rows of vectors."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "ann")
    nodes = scratch.cut(nodes_of(usable(vectors, id_col, vec_col), k), "nodes")
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}
    plan = spark.createDataFrame([(d, spread(n, shard or shard_size(n))) for d, n in sizes.items()] or [(0, 1)], "dim int, shards int")
    dealt = nodes.join(F.broadcast(plan), "dim").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = rows["ids"].map(lambda x: x[0]).to_numpy().argsort(kind="stable")
        x = np.stack(rows["vec"].to_numpy()).astype(np.float64)[order]
        ids = rows["ids"].to_numpy()[order]
        edges, entries = build_graph(x, degree)
        flat = np.concatenate([np.asarray(i, np.int64) for i in ids])
        at = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "x": [x.tobytes()], "edges": [edges.astype(np.int32).tobytes()], "entries": [entries.astype(np.int32).tobytes()], "ids": [flat.tobytes()], "at": [at.tobytes()]})

    index = scratch.cut(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, x binary, edges binary, entries binary, ids binary, at binary"), "index")
    asked = usable(vectors.where(is_query), id_col, vec_col).distinct().select(F.col("id").alias("query_id"), F.xxhash64("vec").alias("query_row"), "vec", F.size("vec").alias("dim"))
    blocks = spread(asked.count(), query_block)
    asked = asked.join(F.broadcast(plan), "dim")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "vec"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(graph):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query_row": "int64", "vec_id": "int64", "score": "float64"})
        g = graph.iloc[0]
        x = np.frombuffer(g["x"]).reshape(-1, int(g["dim"]))
        edges = np.frombuffer(g["edges"], np.int32).reshape(len(x), -1).astype(np.int64)
        entries, ids, at = np.frombuffer(g["entries"], np.int32).astype(np.int64), np.frombuffer(g["ids"], np.int64), np.frombuffer(g["at"], np.int64)
        y = lifted(x)
        q = np.stack(queries["vec"].to_numpy()).astype(np.float64)
        width = max(beam, len(entries))
        out = []
        step = max(16, min(512, (64 << 20) // len(x)))
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            even = part / np.abs(part).max(axis=1, keepdims=True)
            scaled = np.column_stack((even / np.linalg.norm(even, axis=1, keepdims=True), np.zeros(len(part)))).astype(y.dtype)
            found, _ = beam_search(y, edges, entries, scaled, width)
            row, col = np.nonzero(found >= 0)
            node = found[row, col]
            score = (part[row] * x[node]).sum(axis=1)
            many = at[node + 1] - at[node]
            copy = np.repeat(at[node] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            hit = pd.DataFrame({"query_id": queries["query_id"].to_numpy()[lo + np.repeat(row, many)], "query_row": queries["query_row"].to_numpy()[lo + np.repeat(row, many)], "vec_id": ids[copy], "score": np.repeat(score, many)})
            hit = hit[hit["vec_id"] != hit["query_id"]].sort_values(["query_row", "query_id", "score", "vec_id"], ascending=[True, True, False, True], kind="stable")
            out.append(hit.groupby(["query_row", "query_id"], sort=False).head(k))
        return pd.concat(out)

    key = ["dim", "shard", "block"]
    found = asked.groupBy(*key).cogroup(graphs.groupBy(*key)).applyInPandas(look, "query_id long, query_row long, vec_id long, score double")
    order = W.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


QUERIES = {"op5_ann": op5_ann}
ORACLE_SQL: dict[str, str] = {}
