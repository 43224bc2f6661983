"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beams.

Distinct vectors are dealt to shards of a bounded size. A shard builds its graph in numpy: greedy searches propose
neighbours, and pruning with a relaxed distance keeps an edge only where no kept one leads there anyhow. Queries stream
past every shard's graph, and scores are taken on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Vectors of a shard.
SHARD = 8192
DEGREE, RELAX = 32, 1.2
BUILD_BEAM, SEARCH_BEAM = 64, 160
#: Nodes that a beam expands at a time, and places where it starts.
STRIDE, STARTS = 4, 16
TOP, EVERY = 20, 20


def _squares(a: np.ndarray, at: np.ndarray, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Squared distances from each row of q to its own row of places, but for |q|^2."""
    return norms[at] - 2 * np.matmul(a[at], q[:, :, None])[:, :, 0]


def beam(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and distances that best-first searches of ``width`` end with, nearest first; -1 where there are fewer."""
    n, m = len(x), len(q)
    rows = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    ids = np.broadcast_to(starts, (m, len(starts))).copy()
    dist = _squares(x, ids, q, norms)
    seen[rows, ids] = True
    done = np.zeros(ids.shape, bool)
    live = np.arange(m)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        k = min(STRIDE, open_.shape[1])
        best = np.argpartition(open_, k - 1, 1)[:, :k]
        use = np.isfinite(np.take_along_axis(open_, best, 1))
        at = live[:, None]
        done[at, best] = True
        near = np.where(use[:, :, None], graph[np.where(use, ids[at, best], 0)], n).reshape(len(live), -1)
        near = np.sort(np.where(near < 0, n, near), 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[at, near]
        seen[at, near] = True
        d = np.where(fresh, _squares(x, np.where(fresh, near, 0), q[live], norms), np.inf)
        all_ids, all_d = np.concatenate([ids[live], np.where(fresh, near, -1)], 1), np.concatenate([dist[live], d], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        w = min(width, all_d.shape[1])
        pick = np.argpartition(all_d, w - 1, 1)[:, :w]
        if ids.shape[1] != w:
            grow = w - ids.shape[1]
            ids, dist, done = np.pad(ids, ((0, 0), (0, grow)), constant_values=-1), np.pad(dist, ((0, 0), (0, grow)), constant_values=np.inf), np.pad(done, ((0, 0), (0, grow)), constant_values=True)
        ids[live], dist[live], done[live] = (np.take_along_axis(v, pick, 1) for v in (all_ids, all_d, all_done))
        live = live[(~done[live] & np.isfinite(dist[live])).any(1)]
    order = np.argsort(dist, 1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def pruned(x: np.ndarray, norms: np.ndarray, node: np.ndarray, ids: np.ndarray, relax: float, degree: int, most: int = 256) -> np.ndarray:
    """``prune`` for ``most`` nodes at a time."""
    return np.concatenate([prune(x, norms, node[k : k + most], ids[k : k + most], relax, degree) for k in range(0, len(node), most)])


def prune(x: np.ndarray, norms: np.ndarray, node: np.ndarray, ids: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """Robust pruning of each node's candidates (-1: none): the nearest stays, and takes away those it is much nearer to."""
    ids = np.sort(ids, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    bad = (ids < 0) | (ids == node[:, None])
    at = np.where(bad, 0, ids)
    d = np.where(bad, np.inf, np.maximum(_squares(x, at, x[node], norms) + norms[node][:, None], 0))
    order = np.argsort(d, 1, kind="stable")
    at, d = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
    alive, out, rows = np.isfinite(d), np.full((len(node), degree), -1, np.int32), np.arange(len(node))
    own, points = norms[at], x[at]
    # All candidates against each other in one product; each choice then reads a row of it.
    inner = np.matmul(points, points.transpose(0, 2, 1))
    for k in range(degree):
        first = alive.argmax(1)
        has = alive[rows, first]
        if not has.any():
            break
        chosen = at[rows, first]
        out[has, k] = chosen[has]
        between = own + norms[chosen][:, None] - 2 * inner[rows, first]
        alive &= (relax * relax * between > d) & has[:, None]
        alive[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, relax: float = RELAX, width: int = BUILD_BEAM, seed: int = 7, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The graph of points ``x`` (n, d) as rows of neighbours, -1 where there are fewer, and the places to start from."""
    n, rng = len(x), np.random.default_rng(seed)
    norms = np.einsum("nd,nd->n", x, x)
    middle = int(np.argmin(norms - 2 * x @ x.mean(0)))
    starts = np.unique(np.append(rng.choice(n, min(n, STARTS), replace=False), middle))
    if n <= degree + 1:
        full = np.broadcast_to(np.arange(n), (n, n))
        graph = np.full((n, degree), -1, np.int32)
        graph[:, : n - 1] = full[~np.eye(n, dtype=bool)].reshape(n, n - 1)
        return graph, starts
    graph = rng.integers(0, n, (n, degree), dtype=np.int32)
    for alpha in (1.0, relax):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            node = order[k : k + batch]
            found, _ = beam(x, norms, graph, starts, x[node], width)
            graph[node] = pruned(x, norms, node, np.concatenate([found, graph[node]], 1), alpha, degree)
            # Edges back, nearest first; a node with too many is pruned.
            source, target = np.repeat(node, degree), graph[node].ravel()
            source, target = source[target >= 0], target[target >= 0]
            gap = norms[source] + norms[target] - 2 * np.einsum("ed,ed->e", x[source], x[target])
            by = np.lexsort((gap, target))
            source, target = source[by], target[by]
            into, first, count = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, count)
            most = min(int(count.max()), 2 * degree)
            extra = np.full((len(into), most), -1, np.int32)
            fits = place < most
            extra[np.repeat(np.arange(len(into)), count)[fits], place[fits]] = source[fits]
            graph[into] = pruned(x, norms, into, np.concatenate([graph[into], extra], 1), alpha, degree)
    return graph, starts


def lifted(v: np.ndarray) -> np.ndarray:
    """Points with one coordinate more, all of one length: the nearest to (q, 0) has the largest inner product with q."""
    square = np.einsum("nd,nd->n", v, v)
    return np.column_stack([v, np.sqrt(np.maximum(square.max() - square, 0))]).astype(np.float32)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (double; no minus zero): rows with an id and a vector without null, non-finite and only-zero values."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    return v.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rep", kind="stable")
    graph, starts = build(lifted(np.stack(rows.v.tolist())))
    return pd.DataFrame({"shard": rows.shard, "dim": rows.dim, "rep": rows.rep, "v": rows.v, "near": list(graph), "start": np.isin(np.arange(len(rows)), starts)})


def index(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """shard, dim, rep, v, near, start: the graphs of distinct vectors (rep, v), a shard for each ``shard`` or so."""
    n = distinct.count()
    shards = max(2, -(-n // shard)) if n > 64 else 1
    dealt = distinct.select("rep", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"))
    return written(dealt.groupBy("shard", "dim").applyInPandas(_built, "shard int, dim int, rep long, v array<double>, near array<int>, start boolean"))


class _Shard:
    """A shard's graph, once all of its nodes have come."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values("rep", kind="stable")
        self.v, self.rep = np.stack(nodes.v.tolist()), nodes.rep.to_numpy()
        self.x, self.graph = lifted(self.v), np.stack(nodes.near.tolist()).astype(np.int32)
        self.norms, self.starts = np.einsum("nd,nd->n", self.x, self.x), np.flatnonzero(nodes.start.to_numpy(bool))

    def search(self, q: np.ndarray, names: np.ndarray, top: int, width: int) -> Iterator[pd.DataFrame]:
        for k in range(0, len(q), 512):
            part = q[k : k + 512]
            ids, _ = beam(self.x, self.norms, self.graph, self.starts, np.column_stack([part, np.zeros(len(part))]).astype(np.float32), width)
            score = np.where(ids >= 0, np.einsum("qd,qkd->qk", part, self.v[ids]), -np.inf)
            order = np.lexsort((self.rep[ids], -score))[:, :top]
            ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
            good = ids >= 0
            yield pd.DataFrame({"q": np.repeat(names[k : k + 512], good.sum(1)), "rep": self.rep[ids[good]], "score": score[good]})


def _searcher(top: int, width: int):
    """Rows of one shard after the other, its nodes (q null) before its queries, which may be many and come in batches."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, held, shard = None, [], None
        for b in batches:
            for key, rows in b.groupby(["shard", "dim"], sort=False):
                if key != place:
                    place, held, shard = key, [], None
                node = rows.q.isna().to_numpy()
                if node.any():
                    held.append(rows[node])
                if not node.all():
                    if shard is None and held:
                        shard, held = _Shard(pd.concat(held)), []
                    if shard:
                        asked = rows[~node]
                        yield from shard.search(np.stack(asked.v.tolist()), asked.q.to_numpy(np.int64), top, width)

    return search


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, shard: int = SHARD, width: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its ``top`` nearest others.

    Nearness is the largest inner product; ties go to the smaller vec_id. Rows without an id, and null, zero and
    non-finite vectors take no part; an empty vector is a zero one. Vectors of another dimension aren't compared. Equal
    vectors are one node of the graph and come back as all their ids, the smallest first, so copies are found
    exactly. Rows that share an id count once, with the vector that sorts first. With fewer others there are fewer ranks; no rows give no rows.
    """
    # Of rows with one id the smallest vector counts; written down, so that all that follows sees the same.
    v = written(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")))
    same = Window.partitionBy("v").orderBy("vec_id")
    # row_number <= top + 1 is cut in every task before the shuffle: a vector that a third of all rows share is no burden.
    first = written(v.withColumn("r", F.row_number().over(same)).where(F.col("r") <= top + 1))
    distinct = first.where("r = 1").select(F.col("vec_id").alias("rep"), "v")
    members = first.select("vec_id", "v").join(distinct, "v").select("rep", "vec_id")
    asked = written(v.where(F.col("vec_id") % every == 0).join(distinct, "v").select(F.col("vec_id").alias("query_id"), "rep", "v"))
    queries = asked.groupBy(F.col("rep").alias("q")).agg(F.first("v").alias("v"))
    graph = index(distinct, shard)

    places = written(graph.select("shard", "dim").distinct())
    many = queries.select("q", "v", F.size("v").alias("dim")).join(F.broadcast(places), "dim")  # one row for each shard of SHARD vectors
    # Each graph is shuffled once, and the queries stream past it.
    nodes = graph.withColumn("q", F.lit(None).cast("long"))
    both = nodes.unionByName(many, allowMissingColumns=True)
    both = both.repartition(max(places.count(), 1), "shard", "dim").sortWithinPartitions("shard", "dim", F.col("q").asc_nulls_first())
    hits = both.mapInPandas(_searcher(top + 1, width), "q long, rep long, score double")

    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    hits = written(hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1).select("q", "rep", "score"))
    each = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = hits.join(members, "rep").withColumn("r", F.row_number().over(each)).where(F.col("r") <= top + 1).select("q", "vec_id", "score")
    final = asked.select("query_id", F.col("rep").alias("q")).join(rows, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return final.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
