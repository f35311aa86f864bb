"""Exact assignments of rows to columns, and the best few of them in order.

A group is a square table of weights, some tens of rows wide; groups are many, and Spark deals them. Within one, the best
assignment comes from shortest augmenting paths over reduced costs; the next ones from Murty's partition: what is left of the
solutions without one that is known falls into parts, each of which keeps some of its pairs and forbids one. Weights
count to 1e-9, as integers, so ties are ties: of equal sums the assignment that is least, column by column of its rows, comes first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_UNIT = 10**9


def _potentials(cost: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a square integer table: each row's column in an assignment of least cost, and the potentials that prove it; None if there is none."""
    n = len(cost)
    u, v = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    row_of = np.full(n + 1, -1)  # of each column; the last is where a path begins
    far = np.iinfo(np.int64).max // 4
    for row in range(n):
        row_of[n], at = row, n
        least, before, done = np.full(n, far), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[at] >= 0:
            done[at] = True
            here = row_of[at]
            reach = np.where(allowed[here], cost[here] - u[here] - v[:n], far)
            better = ~done[:n] & (reach < least)
            least[better], before[better] = reach[better], at
            nearest = int(np.where(done[:n], far, least).argmin())
            step = least[nearest]
            if done[nearest] or step >= far:
                return None
            passed = np.flatnonzero(done)
            u[row_of[passed]] += step
            v[passed] -= step
            least[~done[:n]] -= np.where(least[~done[:n]] < far, step, 0)
            at = nearest
        while at != n:
            row_of[at], at = row_of[before[at]], before[at]
    column = np.empty(n, np.int64)
    column[row_of[:n]] = np.arange(n)
    return column, u, v[:n]


def _least(column: np.ndarray, tight: np.ndarray) -> np.ndarray:
    """The least, row by row, of the assignments within `tight` pairs, given one of them."""
    n, column = len(column), column.copy()
    row_of = np.empty(n, np.int64)
    row_of[column] = np.arange(n)

    def freed(row: int, wanted: int) -> list[tuple[int, int]] | None:
        """How the owner of `wanted` and others behind `row` move up, so that `row` gets it and leaves its own."""
        path, seen = {}, {wanted}
        queue = [int(row_of[wanted])]
        while queue:
            owner = queue.pop()
            for c in np.flatnonzero(tight[owner]).tolist():
                if c in seen:
                    continue
                seen.add(c)
                path[c] = owner
                if c == column[row]:
                    moves = []
                    while True:
                        mover = path[c]
                        moves.append((mover, c))
                        c = int(column[mover])
                        if c == wanted:
                            return moves
                if row_of[c] > row:
                    queue.append(int(row_of[c]))
        return None

    for row in range(n):
        for c in np.flatnonzero(tight[row, : column[row]]).tolist():
            if row_of[c] < row:
                continue
            moves = freed(row, c)
            if moves is not None:
                for mover, to in [*moves, (row, c)]:
                    column[mover] = to
                row_of[column] = np.arange(n)
                break
    return column


def assignment(weights: np.ndarray, locked: dict[int, int] | None = None, forbidden: set[tuple[int, int]] | None = None) -> tuple[int, tuple[int, ...]] | None:
    """The greatest sum of integer weights[i, s(i)] over permutations s with the locked pairs and none of the forbidden, and the least such s; None if there is none."""
    n = len(weights)
    allowed = np.ones((n, n), bool)
    for i, j in (locked or {}).items():
        allowed[i, :] &= np.arange(n) == j
        allowed[:, j] &= np.arange(n) == i
    for i, j in forbidden or ():
        allowed[i, j] = False
    if not n:
        return 0, ()
    found = _potentials(-weights, allowed)
    if found is None:
        return None
    column, u, v = found
    column = _least(column, allowed & (-weights - u[:, None] - v[None, :] == 0))
    return int(weights[np.arange(n), column].sum()), tuple(column.tolist())


def assignments(weights: np.ndarray, most: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """The first `most` assignments by sum, descending, then by themselves."""
    heap, n = [], len(weights)

    def add(locked: dict[int, int], forbidden: set[tuple[int, int]]) -> None:
        found = assignment(weights, locked, forbidden)
        if found is not None:
            heapq.heappush(heap, (-found[0], found[1], sorted(locked.items()), sorted(forbidden)))

    add({}, set())
    for _ in range(most):
        if not heap:
            return
        less, one, locked, forbidden = heapq.heappop(heap)
        yield -less, one
        fixed = dict(locked)
        for row in range(n):
            if row not in fixed:
                add(fixed, {*forbidden, (row, one[row])})
                fixed = fixed | {row: one[row]}


def best_assignments(weights: DataFrame, keys: dict[str, str], row: str, column: str, weight: str, most: int = 1) -> DataFrame:
    """The `most` best assignments of each key's rows to its columns: keys, rank (from 1), the row and column ids of each pair, and total.

    A pair without a row in `weights`, or of a null weight, is forbidden; of several rows of a pair the greatest counts. Rows and columns are taken in the
    order of their ids. A key with more of one than of the other, or whose pairs allow no assignment, has no result."""
    kinds = [weights.schema[c].dataType.simpleString() for c in (row, column)]
    shape = ", ".join([*(f"`{k}` {t}" for k, t in keys.items()), "rank long", f"`{row}` {kinds[0]}", f"`{column}` {kinds[1]}", "total double"])

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        i, j = np.unique(cells[row], return_inverse=True), np.unique(cells[column], return_inverse=True)
        out = []
        n = len(i[0])
        if n == len(j[0]):
            least = np.iinfo(np.int64).min
            table = np.full((n, n), least)
            known = cells[weight].notna().to_numpy()
            np.maximum.at(table, (i[1][known], j[1][known]), np.rint(cells[weight].to_numpy(float)[known] * _UNIT).astype(np.int64))
            barred = {(int(a), int(b)) for a, b in zip(*np.nonzero(table == least), strict=True)}
            found = assignments(np.where(table == least, 0, table), most) if not barred else _without(table, barred, most)
            for rank, (total, one) in enumerate(found, 1):
                out += [(*key, rank, i[0][a], j[0][b], total / _UNIT) for a, b in enumerate(one)]
        return pd.DataFrame(out, columns=[*keys, "rank", row, column, "total"])

    return weights.select(*keys, row, column, weight).groupBy(*keys).applyInPandas(run, shape)


def _without(table: np.ndarray, barred: set[tuple[int, int]], most: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """assignments() where some pairs are never allowed: they cost more than all else together."""
    known = table[table != np.iinfo(np.int64).min]
    span = int(np.abs(known).max()) if len(known) else 0
    low = -(2 * len(table) * span + 1)
    filled = table.copy()
    for i, j in barred:
        filled[i, j] = low
    for total, one in assignments(filled, most):
        if any((i, j) in barred for i, j in enumerate(one)):
            return
        yield total, one
