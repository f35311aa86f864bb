"""Parent-child and trio scores along a contig, as models of `paths`.

A child has two strands, and so has each parent. Normal states say which strand of the child a parent's strand matches; each
has a burst beside it, where the match is left open: entered at -error, left at no cost, and every row in it at BURST. All
costs count from the first row on. Missing alleles (null or below 0) fit anything. With several sites a row, a site counts
only where no allele of it is missing, and a burst costs as much as its sites, one at least.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .paths import Model

MISMATCH, BURST_PAIR, BURST_TRIO = -4.605170, -0.693147, -1.386


def _alleles(rows: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, bool]:
    """(row, column, site) alleles, -1 where missing; and whether rows have several sites."""
    many = len(rows) and isinstance(rows[columns[0]].iloc[0], (list, np.ndarray))
    if many:
        whole = np.stack([np.stack([np.nan_to_num(np.asarray(x, float), nan=-1.0) for x in rows[c]]) for c in columns], 1).astype(np.int64)
    else:
        whole = rows[columns].fillna(-1).to_numpy(np.int64)[:, :, None]
    return np.maximum(whole, -1), bool(many)


def _emissions(rows: pd.DataFrame, columns: list[str], pairs: list[list[tuple[int, int]]], mismatch: float, burst: float) -> tuple[np.ndarray, np.ndarray]:
    """What each normal state, and a burst, adds at a row. pairs: of each state, the pairs of columns that it holds equal."""
    x, many = _alleles(rows, columns)
    known = (x >= 0).all(axis=1) if many else None
    differ = lambda a, b: (x[:, a] != x[:, b]) & (known if many else (x[:, a] >= 0) & (x[:, b] >= 0))
    emit = np.stack([mismatch * sum(differ(a, b).sum(axis=1) for a, b in held) for held in pairs], 1)
    return emit, burst * (np.maximum(known.sum(axis=1), 1) if many else np.ones(len(rows)))


def _with_bursts(move: np.ndarray, emit: np.ndarray, burst: np.ndarray, error: float) -> np.ndarray:
    """Matrices over the normal states and their bursts from those of normal steps."""
    t, n = emit.shape
    out = np.full((t, 2 * n, 2 * n), -np.inf)
    one = np.arange(n)
    out[:, :n, :n] = move
    out[:, n + one, one] = 0.0
    out[:, :, :n] += emit[:, None, :]
    out[:, one, n + one] = burst[:, None] - error
    out[:, n + one, n + one] = burst[:, None]
    return out


def _costs(rows: pd.DataFrame, phase: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    switch, stay = (rows[c].to_numpy(float)[:, None, None] for c in ("switch", "stay"))
    return switch, stay, np.where(rows["hom"].to_numpy(bool), 0.0, -phase)[:, None, None]


def _start(n: int, error: float) -> np.ndarray:
    return np.concatenate((np.zeros(n), np.full(n, -error)))


def pair(error: float, phase: float, mismatch: float = MISMATCH) -> Model:
    """A child (c1, c2) and one parent (p1, p2), with `switch`, `stay` and `hom` (whether the child's strands may change for nothing).

    State 2 * parent strand + child strand. From a state one may stay, change the child's strand (at `phase`, unless hom), or the parent's (at `switch`), not both."""
    columns = ["c1", "c2", "p1", "p2"]
    pairs = [[(s & 1, 2 + (s >> 1))] for s in range(4)]
    one = np.arange(4)
    apart = one[:, None] ^ one[None, :]

    def matrices(rows: pd.DataFrame) -> np.ndarray:
        switch, stay, flip = _costs(rows, phase)
        move = np.select([apart == 0, apart == 1, apart == 2], [stay, stay + flip, switch], -np.inf)
        return _with_bursts(move, *_emissions(rows, columns, pairs, mismatch, BURST_PAIR), error)

    return Model(_start(4, error), [*columns, "switch", "stay", "hom"], matrices)


def trio(error: float, phase: float, mismatch: float = MISMATCH) -> Model:
    """A child and two parents (p1, p2; q1, q2). State 4 * phase + 2 * strand of the first + strand of the second; in phase 0 the first gives the child's first strand.

    A step costs `switch` or `stay` for each parent and one `stay` more; a change of phase costs `phase` too, unless hom."""
    columns = ["c1", "c2", "p1", "p2", "q1", "q2"]
    pairs = [[(s >> 2, 2 + (s >> 1 & 1)), (1 - (s >> 2), 4 + (s & 1))] for s in range(8)]
    one = np.arange(8)
    apart = one[:, None] ^ one[None, :]
    turns = (apart & 1) + (apart >> 1 & 1)

    def matrices(rows: pd.DataFrame) -> np.ndarray:
        switch, stay, flip = _costs(rows, phase)
        move = turns * switch + (3 - turns) * stay + np.where(apart >> 2, flip, 0.0)
        return _with_bursts(move, *_emissions(rows, columns, pairs, mismatch, BURST_TRIO), error)

    return Model(_start(8, error), [*columns, "switch", "stay", "hom"], matrices)


def strands_of(state: int) -> tuple[int, int] | None:
    """The strands of both parents in a normal state of a trio; None in a burst."""
    return None if state >= 8 else (state >> 1 & 1, state & 1)
