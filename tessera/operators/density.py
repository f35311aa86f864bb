"""Density clusters: core distances, a minimum spanning tree of mutual reachability, its condensed tree and the clusters that last longest.

Distances are made in blocks of rows (pairs.dealt_blocks) and stay there: a block sends on each row's nearest few, and then the edges of its own spanning tree, as
an edge that closes a circle within a block as its longest is in no smaller tree of the whole. What is left, a few thousand edges for a million pairs, is spanned in rounds of joins.
The tree, one edge a row of the group, is condensed by one task a group: 24 bytes a row, where the distances would be 8 bytes a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .pairs import dealt_blocks, signs_apart, tasks

#: Distances below this count as this when their inverse, a density, is taken.
LEAST = 1e-3
#: Distances that are made at once.
STRIP = 1 << 18


def share_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of differing places among those known in both; 1 where there are none."""
    known, differ = signs_apart(x, y)
    share = differ / np.maximum(known, 1)
    share[known == 0] = 1.0
    return share


def _sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    rows = rows.sort_values("__id", kind="stable")
    a, b = rows[rows["__left"]], rows[~rows["__left"]]
    x, y = (np.array([np.asarray(v, float) for v in s["__vector"]]).reshape(len(s), -1) for s in (a, b))
    return a["__id"].to_numpy(), b["__id"].to_numpy(), x, y, bool(rows["__i"].iloc[0] == rows["__j"].iloc[0])


def _strips(x: np.ndarray, y: np.ndarray, distance: Callable) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all of y) of some rows of x at a time."""
    step = max(1, STRIP // max(1, len(y)))
    for at in range(0, len(x) if len(y) else 0, step):
        yield at, distance(x[at : at + step], y)


def _nearest(x: np.ndarray, y: np.ndarray, near: int, distance: Callable, same: bool) -> list[list[float]]:
    """Of each row of x its least distances to rows of y, `near` of them or as many as there are; not to itself where y is the same."""
    out: list[list[float]] = []
    for at, d in _strips(x, y, distance):
        if same:
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        few = np.partition(d, near - 1, axis=1)[:, :near] if near < d.shape[1] else d
        out += few.tolist() if np.isfinite(few).all() else [v[np.isfinite(v)].tolist() for v in few]
    return out or [[] for _ in x]


def core_distances(df: DataFrame, keys: list[str], id: str, vector: str, near: int, distance: Callable = share_apart, side: int = 4096) -> DataFrame:
    """(keys, id, core): the distance of each row to its `near`-th nearest other, or its farthest where there are fewer; null for a row by itself. Ids are unique within the keys, vectors not null."""
    kind = df.schema[id].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, x, y, same = _sides(rows)
        least = _nearest(x, y, near, distance, same) + ([] if same else _nearest(y, x, near, distance, False))
        return pd.DataFrame({"id": a if same else np.concatenate([a, b]), "least": least})

    found = _by_blocks(df, keys, id, vector, side).applyInPandas(_keyed(run, keys), f"{_kinds(df, keys)}id {kind}, least array<double>")
    every = found.groupBy(*keys, "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, near).alias("least"))
    return every.select(*keys, F.col("id").alias(id), F.array_max("least").alias("core"))


def _by_blocks(df: DataFrame, keys: list[str], id: str, vector: str, side: int) -> GroupedData:
    """Each two blocks of rows as a group; dealt by number, as few bytes are much work."""
    return dealt_blocks(df, keys, id, vector, side).repartition(tasks(df), *keys, "__i", "__j").groupBy(*keys, "__i", "__j")


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _keyed(run: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str]) -> Callable:
    def named(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = run(rows)
        for at, k in enumerate(keys):
            out.insert(at, k, pd.Series([key[at]] * len(out), index=out.index, dtype=object))
        return out

    return named


def spanned(weights: np.ndarray) -> list[tuple[int, int]]:
    """The edges (row, column) of a minimum spanning tree of the rows and columns of a matrix, each edge a cell: it grows from the first row by the nearest node, time and again."""
    rows, columns = weights.shape
    turned = np.empty((columns, rows))  # a column's cells lie far apart
    for at in range(0, rows, 64):
        turned[:, at : at + 64] = weights[at : at + 64].T
    near_row, near_column = np.full(rows, np.inf), weights[0].copy()
    by_row, by_column = np.zeros(rows, np.int64), np.zeros(columns, np.int64)
    open_row, open_column = np.ones(rows, bool), np.ones(columns, bool)
    open_row[0] = False
    out = []
    for _ in range(rows + columns - 1):
        r, c = near_row.argmin(), near_column.argmin()  # infinite where a node is taken
        if open_column[c] and (not open_row[r] or near_column[c] <= near_row[r]):
            out.append((int(by_column[c]), int(c)))
            open_column[c], near_column[c] = False, np.inf
            closer = (turned[c] < near_row) & open_row
            np.copyto(near_row, turned[c], where=closer)
            np.copyto(by_row, c, where=closer)
        else:
            out.append((int(r), int(by_row[r])))
            open_row[r], near_row[r] = False, np.inf
            closer = (weights[r] < near_column) & open_column
            np.copyto(near_column, weights[r], where=closer)
            np.copyto(by_column, r, where=closer)
    return out


def _own_tree(weights: np.ndarray) -> list[tuple[int, int]]:
    """The same of a square matrix whose rows and columns are the same nodes."""
    n = len(weights)
    near, by, open_ = weights[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    open_[0], near[0] = False, np.inf
    out = []
    for _ in range(n - 1):
        c = int(near.argmin())
        out.append((int(by[c]), c))
        open_[c], near[c] = False, np.inf
        closer = (weights[c] < near) & open_
        np.copyto(near, weights[c], where=closer)
        np.copyto(by, c, where=closer)
    return out


def reachability_edges(df: DataFrame, keys: list[str], id: str, vector: str, near: int, written: Callable[[DataFrame], DataFrame], distance: Callable = share_apart, side: int = 4096) -> DataFrame:
    """(keys, a, b, weight): of each two blocks the spanning tree by mutual reachability, the greatest of a distance and its ends' core distances. Their union holds a tree of the whole."""
    kind = df.schema[id].dataType.simpleString()
    core = written(core_distances(df, keys, id, vector, near, distance, side))
    with_core = df.select(*keys, id, vector).join(core, [*keys, id]).withColumn("__with", F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(F.coalesce("core", F.lit(0.0)))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        last = lambda x, y: np.maximum(distance(x[:, :-1], y[:, :-1]), np.maximum(x[:, -1:], y[:, -1][None, :]))
        a, b, x, y, same = _sides(rows)
        w = np.zeros((len(a), len(b)))
        for at, d in _strips(x, y, last):
            w[at : at + len(d)] = d
        edges = (_own_tree(w) if same else spanned(w)) if w.size else []
        i, j = np.array(edges, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": pd.Series(np.minimum(a[i], b[j]), dtype=a.dtype), "b": pd.Series(np.maximum(a[i], b[j]), dtype=a.dtype), "weight": w[i, j]})

    return _by_blocks(with_core, keys, id, "__with", side).applyInPandas(_keyed(run, keys), f"{_kinds(df, keys)}a {kind}, b {kind}, weight double")


def spanning_tree(edges: DataFrame, keys: list[str], written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, a, b, weight): the least spanning forest of the edges (keys, a, b, weight), of equal weights the edge of least ends first.

    Rounds: every component takes its least edge to another, and the components that hang together become one, of which the root is found by doubling its members' reach. At most log2 of the nodes' number
    of rounds. Loops, and all but the least of parallel edges, of nodes and then of components, are left out."""
    live = written(edges.filter("a <> b").groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("weight").alias("weight")).withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    taken = []
    while not live.isEmpty():
        ends = live.select(*keys, F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("to")))).alias("e"), "weight", "a", "b")
        pick = written(ends.groupBy(*keys, "e.c").agg(F.min(F.struct("weight", "a", "b", F.col("e.to").alias("to"))).alias("x")).select(*keys, "c", "x.*"))
        taken.append(pick.select(*keys, "a", "b", "weight").distinct())
        # Only two components that took the same edge point at each other: the lesser is the root.
        back = pick.select(*keys, F.col("c").alias("to"), F.col("to").alias("__back"))
        root = pick.select(*keys, "c", "to").join(back, [*keys, "to"]).select(*keys, "c", F.when((F.col("__back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        root = written(root)
        while True:
            far = root.select(*keys, F.col("c").alias("to"), F.col("to").alias("__far"))
            new = written(root.join(far, [*keys, "to"]).select(*keys, "c", F.col("__far").alias("to"), (F.col("__far") != F.col("to")).alias("__moved")))
            root = new.drop("__moved")
            if new.filter("__moved").isEmpty():
                break
        named = lambda c: root.select(*keys, F.col("c").alias(c), F.col("to").alias(f"__{c}"))  # noqa: E731, B023
        met = live.join(named("ca"), [*keys, "ca"]).join(named("cb"), [*keys, "cb"])
        between = met.filter("__ca <> __cb").groupBy(*keys, F.least("__ca", "__cb").alias("ca"), F.greatest("__ca", "__cb").alias("cb")).agg(F.min(F.struct("weight", "a", "b")).alias("x"))
        live = written(between.select(*keys, "x.a", "x.b", "x.weight", "ca", "cb"))
    out = edges.select(*keys, "a", "b", "weight").limit(0)
    for x in taken:
        out = out.unionByName(x)
    return out


def hierarchy(weights: np.ndarray, ends: np.ndarray, n: int) -> tuple[list[list[int]], list[float], list[int]]:
    """What the edges of a tree over n points join, least weights first, edges of one weight at once: of each node its parts, its weight and its number of points. The points are the first n."""
    parts, height, count = [[] for _ in range(n)], [0.0] * n, [1] * n
    top, name = list(range(n)), list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    order = np.argsort(weights, kind="stable")
    levels = np.flatnonzero(np.diff(weights[order], prepend=-1.0))
    for level in np.split(order, levels[1:]):
        joined: dict[int, list[int]] = {}
        for e in level:
            a, b = find(int(ends[e, 0])), find(int(ends[e, 1]))
            own, other = joined.pop(a, None) or [name[a]], joined.pop(b, None) or [name[b]]
            own, other = (own, other) if len(own) >= len(other) else (other, own)
            own.extend(other)
            top[b], joined[a] = a, own
        for root, own in joined.items():
            name[root] = len(parts)
            parts.append(own)
            height.append(float(weights[level[0]]))
            count.append(sum(count[k] for k in own))
    return parts, height, count


def stable_clusters(weights: np.ndarray, ends: np.ndarray, n: int, size: int, whole: bool = False) -> tuple[np.ndarray, dict[int, float]]:
    """Each point's cluster (-1: none) and the clusters' stabilities, from a spanning tree.

    From the whole down: parts of fewer than `size` points leave their cluster at a density of 1 / weight; where two or more larger parts are left, each is a cluster born there. A cluster's
    stability is the sum over its points of the densities they leave at, less that of its birth (0 for the whole). Those are kept that are at least as stable as all kept ones within them; the whole only if asked for."""
    parts, height, count = hierarchy(weights, ends, n)
    left_from = np.zeros(n, np.int64)
    parent, birth, stability = [-1], [0.0], [0.0]
    stack = [(len(parts) - 1, 0)] if len(parts) > n else []
    while stack:
        node, c = stack.pop()
        density = 1 / max(height[node], LEAST)
        large = [k for k in parts[node] if count[k] >= size]
        stability[c] += (density - birth[c]) * (count[node] - (count[large[0]] if len(large) == 1 else 0))
        below = [k for k in parts[node] if count[k] < size]
        while below:
            k = below.pop()
            if k < n:
                left_from[k] = c
            below.extend(parts[k])
        if len(large) == 1:
            stack.append((large[0], c))
        for k in large if len(large) > 1 else []:
            stack.append((k, len(parent)))
            parent.append(c)
            birth.append(density)
            stability.append(0.0)
    best, within, chosen = stability.copy(), [0.0] * len(parent), [False] * len(parent)
    for c in range(len(parent) - 1, -1, -1):
        chosen[c] = stability[c] >= within[c] - 1e-12 and (c > 0 or (whole and len(parts) > n))
        best[c] = stability[c] if chosen[c] else within[c]
        if c:
            within[parent[c]] += best[c]
    final = [-1] * len(parent)
    for c in range(len(parent)):  # parents come first
        above = final[parent[c]] if c else -1
        final[c] = above if above >= 0 else c if chosen[c] else -1
    label = np.array(final, np.int64)[left_from]
    return label, {c: stability[c] for c in set(label.tolist()) - {-1}}


def clusters(df: DataFrame, keys: list[str], id: str, vector: str, size: int, near: int, written: Callable[[DataFrame], DataFrame], distance: Callable = share_apart, side: int = 4096, whole: bool = False) -> DataFrame:
    """(keys, id, cluster, stability) of each row: the density cluster it is in, numbered from 0 by the clusters' least ids; null where it is in none.

    size: the fewest points of a cluster, 2 or more; near: see core_distances(). Rows without an id or a vector go, rows of equal keys and ids are one (the least vector)."""
    if size < 2:
        raise ValueError("a cluster has two points at least")
    kind = df.schema[id].dataType.simpleString()
    rows = df.filter(F.col(id).isNotNull() & F.col(vector).isNotNull()).groupBy(*keys, id).agg(F.min(vector).alias(vector))
    rows = written(rows)
    tree = spanning_tree(reachability_edges(rows, keys, id, vector, near, written, distance, side), keys, written)
    points = rows.select(*keys, F.col(id).alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(None).cast("double").alias("weight"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        edge = rows["weight"].notna().to_numpy()
        ids = np.unique(rows["a"].to_numpy()[~edge])
        ends = np.stack([np.searchsorted(ids, rows[c].to_numpy()[edge].astype(ids.dtype)) for c in ("a", "b")], axis=1)
        label, stability = stable_clusters(rows["weight"].to_numpy()[edge], ends, len(ids), size, whole)
        number = {c: k for k, c in enumerate(dict.fromkeys(label[label >= 0].tolist()))}  # in the order of their least ids
        return pd.DataFrame({"id": ids, "cluster": pd.array([number.get(c) for c in label.tolist()], "Int64"), "stability": [stability.get(c) for c in label.tolist()]})

    found = tree.unionByName(points).groupBy(*keys).applyInPandas(_keyed(run, keys), f"{_kinds(df, keys)}id {kind}, cluster long, stability double")
    return found.withColumnRenamed("id", id)
