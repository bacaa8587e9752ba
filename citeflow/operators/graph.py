"""Graph measures and communities.

Graphs come from ``mapping.graph`` and so have a bounded number of edges;
every graph (column ``graph``) is one task with numpy.  ``pagerank_large`` and
``degree`` are joins and aggregations for graphs of any size."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeflow.sources import scratch

#: Edges that ``centralities`` and ``communities`` take: their task holds a
#: matrix of at most twice as many nodes squared.
MOST_EDGES = 2000


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): unweighted; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def pagerank_large(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): weighted PageRank by joins, for graphs of any size, until
    the ranks change by less than ``tolerance`` a node in all (the change
    shrinks by ``damping`` a round, so it ends).  Each round is a written
    table of the checkpoint folder, so its plan doesn't grow."""
    arcs = edges.select("src", "dst", "weight").union(edges.where("src <> dst").select("dst", "src", "weight"))
    out = arcs.groupBy("src").agg(F.sum("weight").alias("total"))
    arcs = scratch.written(arcs.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    ranks = arcs.select(F.col("src").alias("node")).distinct()
    n = max(1, ranks.count())
    ranks = scratch.written(ranks.withColumn("rank", F.lit(1.0 / n)))
    while True:
        got = arcs.join(ranks, arcs.src == ranks.node).groupBy(F.col("dst").alias("node")).agg(((1 - damping) / n + damping * F.sum(F.col("p") * F.col("rank"))).alias("new"))
        both = scratch.written(got.join(ranks, "node").select("node", F.col("new").alias("rank"), F.abs(F.col("new") - F.col("rank")).alias("moved")))
        scratch.forget(ranks)
        moved, ranks = both.agg(F.sum("moved")).first()[0] or 0.0, both
        if moved < n * tolerance:
            scratch.forget(arcs)
            return ranks.select("node", "rank")


def _matrix(e: pd.DataFrame):
    names = sorted(set(e.src) | set(e.dst))
    at = {x: i for i, x in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for s, d, x in zip(e.src.map(at), e.dst.map(at), e.weight, strict=True):
        w[s, d] = w[d, s] = x
    return names, w


def _paths(w: np.ndarray, s: int):
    """Distances from s (weights as lengths), the order nodes are settled in,
    path counts and predecessors."""
    n = len(w)
    dist, count, before, order, done = np.full(n, np.inf), np.zeros(n), [[] for _ in range(n)], [], np.zeros(n, bool)
    dist[s], count[s], queue = 0, 1, [(0.0, s)]
    while queue:
        d, v = heapq.heappop(queue)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for u in np.flatnonzero(w[v]).tolist():
            new = d + w[v, u]
            if u == v:
                continue
            if new < dist[u] - 1e-12:
                dist[u], count[u], before[u] = new, count[v], [v]
                heapq.heappush(queue, (new, u))
            elif abs(new - dist[u]) <= 1e-12 and not done[u]:
                count[u] += count[v]
                before[u].append(v)
    return dist, order, count, before


def _degree(w: np.ndarray) -> np.ndarray:
    hop = w != 0
    return (hop.sum(1) + np.diag(hop)).astype(int)


def _betweenness(w: np.ndarray) -> np.ndarray:
    """Shares of shortest paths, weights as lengths."""
    n = len(w)
    between = np.zeros(n)
    for s in range(n):
        _, order, count, before = _paths(w, s)
        share = np.zeros(n)
        for v in reversed(order):
            for u in before[v]:
                share[u] += count[u] / count[v] * (1 + share[v])
            if v != s:
                between[v] += share[v]
    return between / ((n - 1) * (n - 2)) if n > 2 else between


def _closeness(w: np.ndarray) -> np.ndarray:
    """Reached nodes over their hops, scaled by the share that is reached."""
    n, hop = len(w), (w != 0).astype(float)
    close = np.zeros(n)
    for s in range(n):
        far = _paths(hop, s)[0]
        reached = np.isfinite(far)
        k, total = reached.sum() - 1, far[reached].sum()
        close[s] = (k / total) * (k / (n - 1)) if total > 0 else 0.0
    return close


def _eigenvector(w: np.ndarray) -> np.ndarray:
    """Power iteration; zeros where 1000 rounds don't converge."""
    n = len(w)
    x = np.full(n, 1 / max(n, 1))
    for _ in range(1000):
        y = x + w @ x
        y /= np.linalg.norm(y) or 1
        if np.abs(y - x).sum() < n * 1e-6:
            return y
        x = y
    return 0 * x


def _pagerank(w: np.ndarray) -> np.ndarray:
    """Weighted; the change shrinks by 0.85 a round, so the loop ends."""
    n = len(w)
    p = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
    rank = np.full(n, 1 / max(n, 1))
    while True:
        new = 0.85 * (rank @ p) + 0.15 / n
        if np.abs(new - rank).sum() < n * 1e-6:
            return new
        rank = new


_MEASURES = {"degree": _degree, "betweenness": _betweenness, "eigenvector": _eigenvector, "closeness": _closeness, "pagerank": _pagerank}
MEASURES = tuple(_MEASURES)


def modularity(w: np.ndarray, of: np.ndarray) -> float:
    m, k = w.sum(), w.sum(1)
    return float(((w - np.outer(k, k) / m) * (of[:, None] == of)).sum() / m) if m else 0.0


def _greedy(w: np.ndarray) -> np.ndarray:
    """Merge the pair of communities that gains most modularity, until none gains."""
    of = np.arange(len(w))
    a = (w != 0).astype(float)
    m = a.sum()
    while m:
        ids = np.unique(of)
        hot = (of[:, None] == ids).astype(float)
        between = hot.T @ a @ hot
        k = between.sum(1)
        gain = np.where(between > 0, between / m - np.outer(k, k) / m**2, -1)
        np.fill_diagonal(gain, -1)
        i, j = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[i, j] <= 1e-12:
            return of
        of[of == ids[j]] = ids[i]
    return of


def _propagate(w: np.ndarray) -> np.ndarray:
    """Label propagation in node order; ties go to the own label, else the
    largest.  A label changes only to one that more edges agree with, so the
    loop ends."""
    of, a = np.arange(len(w)), w != 0
    while True:
        was = of.copy()
        for v in range(len(w)):
            around = of[a[v]]
            if len(around):
                labels, n = np.unique(around, return_counts=True)
                best = labels[n == n.max()]
                of[v] = of[v] if of[v] in best else best[-1]
        if (was == of).all():
            return of


def _louvain(w: np.ndarray) -> np.ndarray:
    """Local moves and contraction, weighted, in node order; every move gains
    modularity, so the loops end."""
    of, level = np.arange(len(w)), w.copy()
    while level.sum():
        n, k, m = len(level), level.sum(1), level.sum()
        own, moved = np.arange(n), False
        still = False
        while not still:
            still = True
            for v in range(n):
                links = np.bincount(own, level[v], n)
                links[own[v]] -= level[v, v]
                total = np.bincount(own, k, n)
                total[own[v]] -= k[v]
                gain = links - total * k[v] / m
                gain[links == 0] = -np.inf
                gain[own[v]] = max(gain[own[v]], links[own[v]] - total[own[v]] * k[v] / m)
                best = int(np.argmax(gain))
                if gain[best] > gain[own[v]] + 1e-12:
                    own[v], still, moved = best, False, True
        if not moved:
            break
        _, own = np.unique(own, return_inverse=True)
        hot = (own[:, None] == np.arange(own.max() + 1)).astype(float)
        level, of = hot.T @ level @ hot, own[of]
    return of


COMMUNITIES = {"greedy": _greedy, "label_propagation": _propagate, "louvain": _louvain}


def _bounded(edges: DataFrame) -> DataFrame:
    """The edges as one group, refused above MOST_EDGES; for larger graphs
    there are ``degree``, ``pagerank_large`` and the strongest edges."""
    edges = scratch.written(edges)
    if edges.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges; take the strongest ones (mapping.graph)")
    return edges.withColumn("graph", F.lit(0)).groupBy("graph")


def centralities(edges: DataFrame, wanted: tuple[str, ...] = MEASURES) -> DataFrame:
    """(node, and a column for each measure wanted: degree, betweenness,
    eigenvector, closeness, pagerank)."""

    def run(e: pd.DataFrame) -> pd.DataFrame:
        names, w = _matrix(e)
        return pd.DataFrame({"node": names, **{m: _MEASURES[m](w) for m in wanted}})

    kinds = ", ".join(f"{m} {'long' if m == 'degree' else 'double'}" for m in wanted)
    return _bounded(edges).applyInPandas(run, f"node string, {kinds}")


def communities(edges: DataFrame, how: str = "greedy") -> DataFrame:
    """(node, cluster): clusters from 1, larger first, ties by smallest node.
    An unknown method means greedy."""
    find = COMMUNITIES.get(how, _greedy)

    def run(e: pd.DataFrame) -> pd.DataFrame:
        names, w = _matrix(e)
        of = find(w)
        groups = sorted((-int((of == c).sum()), names[int(np.flatnonzero(of == c)[0])], c) for c in np.unique(of))
        number = {c: i + 1 for i, (_, _, c) in enumerate(groups)}
        return pd.DataFrame({"node": names, "cluster": [number[c] for c in of.tolist()]})

    return _bounded(edges).applyInPandas(run, "node string, cluster int")


def legend(nodes: DataFrame, metric: str) -> DataFrame:
    """(label, node, cluster, value): rank inside the cluster by metric."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(metric), "node"))
    return nodes.select(F.concat_ws("-", "cluster", rank).alias("label"), "node", "cluster", F.col(metric).cast("double").alias("value"))


def styled(nodes: DataFrame, metric: str) -> DataFrame:
    """(node, size, color, title) for drawing."""
    from citeflow.functions.text import orange

    most = nodes.agg(F.coalesce(F.max(metric).cast("double"), F.lit(1.0)).alias("most"))
    v = F.col(metric).cast("double")
    size = 15 + 40 * F.when(F.col("most") != 0, v / F.col("most")).otherwise(0.0)
    title = F.format_string("%s\n%s: %.4f", F.col("node"), F.lit(metric), v)
    return nodes.join(F.broadcast(most), F.lit(True)).select("node", size.alias("size"), orange(v, F.col("most")).alias("color"), title.alias("title"))


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    kept = nodes.select("node")
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def of_cluster(nodes: DataFrame, cluster: int | None) -> DataFrame:
    """The nodes of one cluster, or all."""
    return nodes if cluster is None else nodes.where(F.col("cluster") == cluster)
