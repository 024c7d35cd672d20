"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors are one node, so that a very common vector is searched once; its rows
come back at the end, smallest ids first.  Nodes are dealt to shards of about
``shard_rows`` by hash.  In a shard, nodes enter the graph in growing batches: a beam
search from the entry point proposes neighbours, robust pruning keeps a diverse set
(a candidate goes if a kept neighbour is closer to it by the factor ``alpha``), and
reverse edges are added and pruned likewise.  Every shard's graph is built once and its
edges are staged with the vectors.  Every query is then searched by beam in
every shard, in blocks of ``query_rows`` queries, and the shards' best are merged.

For inner products the vectors get one more component that makes their norms equal, so
that the largest inner product is the smallest distance; distances are doubles, which still
tell short vectors apart beside one of a 10,000 times longer norm.  Reported scores are exact
inner products of the original vectors in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without an id; a vector is compared with vectors of its own length
only; with fewer candidates than ``k`` all are returned; ties go to smaller ids, within
what the beam found;
rows that repeat an id and vector are candidates like others, once per row, except for a
query's own id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage


class RobustGraph:
    """A directed graph over the rows of ``points`` (equal norms) with at most ``degree`` edges out."""

    def __init__(self, points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 1024, edges: np.ndarray | None = None):
        self.points = np.ascontiguousarray(points, np.float64)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        self.edges = np.full((len(points), degree), -1, np.int32) if edges is None else edges
        center = self.points.mean(axis=0)
        self.entry = int(np.argmax(self.points @ center)) if len(points) else 0
        if edges is None:
            self._build(batch)

    def _build(self, batch: int) -> None:
        points = self.points
        order = np.random.default_rng(len(points)).permutation(len(points))
        order = np.concatenate([[self.entry], order[order != self.entry]]).astype(np.int64)
        at = 1
        while at < len(order):  # batches grow with the graph
            to = min(len(order), at + min(batch, max(8, at // 2)))
            self._insert(order[at:to])
            at = to

    def _distances(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """1 - inner product of each row's point with its row of candidate indices, ties by index; inf for -1."""
        d = 1 - np.matmul(self.points[others], rows[:, :, None])[:, :, 0] + others * 1e-14
        d[others < 0] = np.inf
        return d

    def search(self, queries: np.ndarray, beam: int | None = None, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Indices and distances of the ``beam`` nearest found for each query, nearest first; -1 where fewer."""
        beam, n = beam or self.beam, len(queries)
        ids = np.full((n, beam), -1, np.int32)
        ids[:, 0] = self.entry
        dist = self._distances(queries, ids)
        done = ids < 0
        rows = np.arange(n)
        active = rows
        while len(active):
            waiting = np.where(done[active], np.inf, dist[active])
            pick = np.argsort(waiting, axis=1)[:, :expand] if expand > 1 else waiting.argmin(axis=1)[:, None]
            live = np.isfinite(np.take_along_axis(waiting, pick, 1))
            some = live.any(axis=1)
            active, pick, live = active[some], pick[some], live[some]
            if not len(active):
                break
            from_ids = np.where(live, np.take_along_axis(ids[active], pick, 1), -1)
            marked = done[active]
            np.put_along_axis(marked, pick, True, 1)
            done[active] = marked
            near = self.edges[from_ids].reshape(len(active), -1)
            near[np.repeat(from_ids < 0, self.degree, axis=1)] = -1
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen = (near[:, :, None] == ids[active][:, None, :]).any(axis=2)
            near[seen] = -1
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_dist = np.concatenate([dist[active], self._distances(queries[active], near)], axis=1)
            all_done = np.concatenate([done[active], near < 0], axis=1)
            best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_dist, best, 1), axis=1, kind="stable"), 1)
            ids[active] = np.take_along_axis(all_ids, best, 1)
            dist[active] = np.take_along_axis(all_dist, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1) | ~np.isfinite(dist[active])
            ids[active] = np.where(np.isfinite(dist[active]), ids[active], -1)
        return ids, dist

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning of each node's candidates (indices, -1 for none) to ``degree`` diverse ones."""
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        dist = self._distances(self.points[nodes], candidates)
        order = np.argsort(dist, axis=1, kind="stable")
        candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
        vectors = self.points[candidates]
        between = 1 - np.matmul(vectors, vectors.transpose(0, 2, 1))
        open_, out = np.isfinite(dist), np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            some = open_.any(axis=1)
            if not some.any():
                break
            first = open_.argmax(axis=1)
            out[some, k] = candidates[rows, first][some]
            open_ &= self.alpha * between[rows, first] > dist
            open_[rows, first] = False
        return out

    def _insert(self, nodes: np.ndarray) -> None:
        ids, _ = self.search(self.points[nodes])
        self.edges[nodes] = self._prune(nodes, ids)
        source = np.repeat(nodes, self.degree)
        target = self.edges[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order].astype(np.int32), target[order]
        touched, start, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, count)
        # nodes that very many point at are pruned piece by piece
        for low in range(0, int(count.max(initial=0)), 2 * self.degree):
            use = (place >= low) & (place < low + 2 * self.degree)
            some = np.unique(target[use])
            more = np.full((len(some), 2 * self.degree), -1, np.int32)
            more[np.searchsorted(some, target[use]), place[use] - low] = source[use]
            joined = np.concatenate([self.edges[some], more], axis=1)
            fits = (joined >= 0).sum(axis=1) <= self.degree
            packed = -np.sort(-joined[fits], axis=1)[:, : self.degree]
            self.edges[some[fits]] = packed
            full = np.flatnonzero(~fits)
            for part in np.array_split(full, max(1, len(full) // 512)):
                if len(part):
                    self.edges[some[part]] = self._prune(some[part], joined[part])


def _level(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Scale by the longest norm and append what is missing to norm 1."""
    scaled = vectors / longest
    return np.concatenate([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))], axis=1)


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>), its length and two hashes of it, of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    positive = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    return rows.withColumn("v", positive).withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.reverse("v")), "dim": F.size("v")})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _points(v: np.ndarray) -> np.ndarray:
    return _level(v, float(np.sqrt((v**2).sum(axis=1)).max()))


def build_graphs(nodes: DataFrame, shard_rows: int, degree: int, beam: int, alpha: float) -> DataFrame:
    """Deal nodes (node, h, h2, v, dim) to shards and build each shard's graph: adds shard, shards and edges, staged."""
    per = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(per, "dim").withColumn("shard", F.pmod(F.xxhash64("h"), F.col("shards")).cast("int"))

    def build(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values(["node", "h"], kind="stable")
        graph = RobustGraph(_points(_matrix(points["v"])), degree, beam, alpha)
        return points.assign(place=np.arange(len(points)), edges=list(graph.edges))

    schema = "dim int, node long, h long, h2 long, v array<double>, shards int, shard int, place int, edges array<int>"
    # a graph costs far more than its bytes tell, so the exchange is given its number of partitions and not left to be coalesced
    total = per.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    dealt = dealt.select("dim", "node", "h", "h2", "v", "shards", "shard").repartition(max(1, 2 * total), "dim", "shard")
    return stage(dealt.groupBy("dim", "shard").applyInPandas(build, schema), "graph")


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int, query_rows: int, degree: int, beam: int, alpha: float) -> DataFrame:
    """query_id, node, h, h2 and score of the k + 1 best nodes found for each query (id, v, dim) in every shard of its length."""
    blocks = max(1, -(-queries.count() // query_rows))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = graphs.withColumn("block", each)
    shards = graphs.select(F.col("dim").alias("_dim"), F.col("shard").alias("_shard")).distinct()
    right = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).join(shards, F.col("dim") == F.col("_dim"))
    right = right.select("id", "v", "block", F.col("_dim").alias("dim"), F.col("_shard").alias("shard"))

    def search(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "node": [], "h": [], "h2": [], "score": []})]
        if len(points) and len(asked):
            points = points.sort_values("place", kind="stable")
            x = _matrix(points["v"])
            graph = RobustGraph(_points(x), degree, beam, alpha, edges=_matrix(points["edges"]).astype(np.int32))
            for part in np.array_split(np.arange(len(asked)), max(1, len(asked) // 256)):
                q = _matrix(asked["v"].iloc[part])
                flat = np.concatenate([q / np.sqrt((q**2).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))], axis=1)
                ids, _ = graph.search(flat, max(beam, k + 1))
                exact = np.einsum("qd,qcd->qc", q, x[ids])
                exact[ids < 0] = -np.inf
                best = np.lexsort((ids, -exact), axis=1)[:, : k + 1]  # places ascend with ids
                row = np.repeat(np.arange(len(q)), best.shape[1])
                found, value = np.take_along_axis(ids, best, 1).ravel(), np.take_along_axis(exact, best, 1).ravel()
                keep = found >= 0
                nodes = points[["node", "h", "h2"]].iloc[found[keep]]
                out.append(nodes.assign(query_id=asked["id"].to_numpy()[part][row[keep]], score=value[keep])[out[0].columns])
        return pd.concat(out[1:] or out)

    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(search, "query_id long, node long, h long, h2 long, score double")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "node", "h")
    return found.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).drop("nth")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_every: int = 20, shard_rows: int = 20_000, query_rows: int = 20_000, beam: int = 160, degree: int = 32, alpha: float = 1.2) -> DataFrame:
    """query_id, rank, id and score of the ``k`` nearest rows of each row whose id is divisible by ``query_every``."""
    rows = stage(clean_vectors(vectors, id_col, vector_col), "vectors")
    same = Window.partitionBy("h", "h2").orderBy("id")
    # of equal vectors only the k + 1 smallest ids can be among the k nearest
    members = stage(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1), "members")
    graphs = build_graphs(members.where("nth = 1").withColumnRenamed("id", "node"), shard_rows, degree, max(64, beam // 2), alpha)
    queries = rows.where(F.col("id") % query_every == 0).select("id", "v", "dim")
    found = search_graphs(graphs, queries, k, query_rows, degree, beam, alpha)
    ranked = found.join(members.select("h", "h2", "id"), ["h", "h2"]).where("id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return ranked.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
