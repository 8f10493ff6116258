"""Keywords of users: lists per cluster, concept union, and density clusters of their vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def cluster_keyword_lists(keywords: DataFrame) -> DataFrame:
    """Keywords per sentiment and cluster, in order; -1 is shown as noise."""
    name = F.when(F.col("cluster") == -1, "noise").otherwise(F.col("cluster").cast("string"))
    return keywords.groupBy("sentiment", name.alias("cluster")).agg(F.array_join(F.sort_array(F.collect_set("keyword")), ",").alias("keywords"))


#: Words that are no concept.
EXCLUDED = ("me", "my", "i", "used", "when", "this", "parents", "bring", "sick", "got", "reminds")


def main_concepts(*arrays: Column) -> Column:
    """Union of concept lists in lower case, in order: without those that are part of one of more words, without excluded
    words, and with three characters at least. Null lists are empty."""
    every = F.array_distinct(F.flatten(F.array(*(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda c: F.lower(c)) for a in arrays))))
    size = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    whole = F.filter(every, lambda c: ~F.exists(every, lambda o: F.contains(o, c) & (size(c) < size(o))))
    return F.array_sort(F.filter(whole, lambda c: ~c.isin(*EXCLUDED) & (F.length(F.trim(c)) > 2)))


def _tree(x: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """Edges of a minimum spanning tree over mutual reachability distances, by Prim's method."""
    n = len(x)
    square = (x * x).sum(axis=1)
    row = lambda i: np.sqrt(np.maximum(square + square[i] - 2 * x @ x[i], 0))
    core = np.array([np.partition(row(i), min(k, n) - 1)[min(k, n) - 1] for i in range(n)])
    best, parent, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    edges, now = [], 0
    for _ in range(n - 1):
        left[now] = False
        reach = np.maximum(np.maximum(row(now), core), core[now])
        closer = left & (reach < best)
        best[closer], parent[closer] = reach[closer], now
        now = int(np.flatnonzero(left)[np.argmin(best[left])])
        edges.append((float(best[now]), int(parent[now]), now))
    return sorted(edges)


def density_clusters(x: np.ndarray, least: int = 2) -> np.ndarray:
    """Hierarchical density clusters (mutual reachability, excess of mass); noise is -1."""
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    root = list(range(2 * n - 1))
    size, kids, dist = [1] * n + [0] * (n - 1), {}, {}

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i, (d, a, b) in enumerate(_tree(x, least)):
        a, b, new = find(a), find(b), n + i
        root[a] = root[b] = new
        size[new], kids[new], dist[new] = size[a] + size[b], (a, b), d
    lam = lambda node: 1 / dist[node] if dist[node] > 0 else 1e12
    points: dict[int, list[tuple[int, float]]] = {0: []}
    born, above, below = {0: 0.0}, {0: -1}, {0: []}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            points[cluster].append((node, 1e12))
            continue
        level, parts = lam(node), kids[node]
        large = [p for p in parts if size[p] >= least]
        for p in parts:
            if len(large) == 2:
                new = len(born)
                born[new], above[new], below[new], points[new] = level, cluster, [], []
                below[cluster].append(new)
                stack.append((p, new))
            elif p in large:
                stack.append((p, cluster))
            else:
                leaves = [p]
                while leaves:
                    q = leaves.pop()
                    if q < n:
                        points[cluster].append((q, level))
                    else:
                        leaves += kids[q]
    count = {c: len(points[c]) for c in born}
    for c in sorted(born, reverse=True):
        if above[c] >= 0:
            count[above[c]] += count[c]
    mass = {c: sum(l - born[c] for _, l in points[c]) + sum(count[k] * (born[k] - born[c]) for k in below[c]) for c in born}
    chosen = {}
    for c in sorted(born, reverse=True):
        inner = sum(mass[k] for k in below[c])
        chosen[c] = c != 0 and (not below[c] or mass[c] >= inner)
        mass[c] = mass[c] if chosen[c] else inner
    labels, stack, number = np.full(n, -1), [(0, -1)], 0
    while stack:
        c, label = stack.pop()
        if label < 0 and chosen[c]:
            label, number = number, number + 1
        for p, _ in points[c]:
            labels[p] = label
        stack += [(k, label) for k in sorted(below[c], reverse=True)]
    return labels


def keyword_clusters(vectors: DataFrame, least: int = 2) -> DataFrame:
    """``user_id vec_id cluster`` per user; a user with fewer than two vectors has noise only.

    One group per user, as clusters are of a user's own keywords."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"user_id": pdf.user_id, "vec_id": pdf.vec_id, "cluster": density_clusters(np.stack(pdf.embedding.to_list()).astype(float), least)})

    return vectors.groupBy("user_id").applyInPandas(run, "user_id long, vec_id long, cluster long")
