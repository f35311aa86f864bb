"""Scores, best paths and posteriors of hidden states along ordered rows, in pieces that combine.

A row is a matrix: what it adds to the score of each step from a state before it to a state at it, its emission included.
Matrices multiply, with a maximum (best path) or a log-sum (likelihood) in place of the sum, and the product doesn't
depend on where it is cut. So a sequence is cut into pieces by ranges of its order column; Spark deals the pieces to
tasks, and one matrix of a piece travels on, however many rows it has. A key with very many rows is many pieces. A path is
traced back in two steps: over the matrices of its pieces, which gives the state at the end of each, and then within each
piece on its own. Posteriors take the products before and behind each piece, and both recursions within it.

A task takes its sorted pieces some thousands of rows at a time, and steps through all of these side by side: a step is one
numpy operation over a (piece, state, state) array. The number of partitions is fixed, as rows are few bytes and much work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a step of a task, and elements of the arrays that it makes at once.
ROWS, ELEMENTS = 1 << 16, 1 << 22


@dataclass
class Model:
    """start: the score of each state before the first row. matrices: of ordered rows, (row, state before, state). columns: what it reads."""

    start: np.ndarray
    columns: list[str]
    matrices: Callable[[pd.DataFrame], np.ndarray]
    likelihood: bool = False

    @property
    def states(self) -> int:
        return len(self.start)

    def over(self, each: np.ndarray, axis: int) -> np.ndarray:
        """The maximum, or the log-sum, of scores; that of impossible ones is impossible."""
        top = each.max(axis=axis)
        if not self.likelihood:
            return top
        base = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(each - np.expand_dims(base, axis)).sum(axis=axis)) + base

    def times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The products of matrices, pair by pair."""
        step = max(1, ELEMENTS // max(1, a.shape[1] * b.shape[1] * b.shape[2]))
        parts = [self.over(a[k : k + step, :, :, None] + b[k : k + step, None, :, :], 2) for k in range(0, len(a), step)]
        return np.concatenate(parts) if parts else np.zeros((0, a.shape[1], b.shape[2]))

    def combined(self, m: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The product of each group's matrices, which stand together, halving their number at each step."""
        while len(group):
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            odd = (np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))) % 2 == 1
            if not odd.any():
                break
            right = np.flatnonzero(odd)
            m[right - 1] = self.times(m[right - 1], m[right])
            m, group = m[~odd], group[~odd]
        return m, group

    def products(self, rows: pd.DataFrame, group: np.ndarray) -> np.ndarray:
        """The product of the rows of each group."""
        step, parts = max(2, ELEMENTS // self.states**2), []
        for at in range(0, len(rows), step):
            parts.append(self.combined(self.matrices(rows.iloc[at : at + step]), group[at : at + step]))
        return self.combined(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))[0]


def _grouped(rows: pd.DataFrame, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group, and where each begins; equal rows stand together."""
    group = rows.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    return group, np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))


def _whole(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Sorted rows in frames of whole groups, with _grouped(); small frames are put together."""
    held, n, limit = [], 0, ROWS
    for frame in frames:
        if frame.empty:
            continue
        held.append(frame)
        n += len(frame)
        if n < limit:
            continue
        table = pd.concat(held, ignore_index=True)
        group, begin = _grouped(table, by)
        cut = begin[-1]
        if cut:
            yield table.iloc[:cut], group[:cut], begin[:-1]
        held = [table.iloc[cut:]]
        n = len(held[0])
        limit = max(ROWS, 2 * n)
    if held:
        table = pd.concat(held, ignore_index=True)
        yield table, *_grouped(table, by)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    return df.repartition(_tasks(df), *by).sortWithinPartitions(*by, *order)


def _pieces(df: DataFrame, keys: dict[str, str], order: str, model: Model, width: float, *also: str) -> DataFrame:
    """The rows with their piece."""
    columns = dict.fromkeys([*model.columns, *also])
    return df.select(*keys, F.floor(F.col(order) / width).cast("long").alias("piece"), F.col(order), *[c for c in columns if c != order and c not in keys])


def _typed(keys: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in keys.items())


def _products(pieces: DataFrame, keys: dict[str, str], order: str, model: Model) -> DataFrame:
    by = [*keys, "piece"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group, begin in _whole(frames, by):
            m = model.products(rows, group)
            yield rows.iloc[begin][by].assign(n=np.diff(np.append(begin, len(rows))), matrix=list(m.reshape(len(m), -1)))

    return _dealt(pieces, by, order).mapInPandas(run, f"{_typed(keys)}, piece long, n long, matrix array<double>")


def _stacked(rows: pd.DataFrame, column: str, *shape: int) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in rows[column]]).reshape(len(rows), *shape)


def scores(df: DataFrame, keys: dict[str, str], order: str, model: Model, width: float = 1 << 16) -> DataFrame:
    """keys, n (rows) and score: that of the best path, or the log-likelihood. `width` is the range of the order column that is one piece."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group, begin in _whole(frames, [*keys]):
            m, _ = model.combined(_stacked(rows, "matrix", model.states, model.states), group)
            total = model.over(model.over(model.start[None, :, None] + m, 1), 1)
            yield rows.iloc[begin][[*keys]].assign(n=np.add.reduceat(rows["n"].to_numpy(), begin), score=total)

    products = _products(_pieces(df, keys, order, model, width), keys, order, model)
    return _dealt(products, [*keys], "piece").mapInPandas(run, f"{_typed(keys)}, n long, score double")


def _ends(products: DataFrame, keys: dict[str, str], model: Model) -> DataFrame:
    """Of each piece: the scores of states before it and (likelihood) behind it, the best path's state at its end, and the whole score."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _, begin in _whole(frames, [*keys]):
            matrices = _stacked(rows, "matrix", model.states, model.states)
            before, behind, last, score = [], [None] * len(rows), [0] * len(rows), np.empty(len(rows))
            for a, b in zip(begin.tolist(), np.append(begin[1:], len(rows)).tolist(), strict=True):
                now = [model.start]
                for m in matrices[a:b]:
                    now.append(model.over(now[-1][:, None] + m, 0))
                before += now[:-1]
                score[a:b] = model.over(now[-1], 0)
                if model.likelihood:
                    after = np.zeros(model.states)
                    for k in range(b - 1, a - 1, -1):
                        behind[k], after = after, model.over(matrices[k] + after[None, :], 1)
                    continue
                last[b - 1] = int(now[-1].argmax())
                for k in range(b - 1, a, -1):
                    last[k - 1] = int((now[k - a] + matrices[k][:, last[k]]).argmax())
            yield rows[[*keys, "piece"]].assign(before=before, behind=behind, last=last, score=score)

    return _dealt(products, [*keys], "piece").mapInPandas(run, f"{_typed(keys)}, piece long, before array<double>, behind array<double>, last long, score double")


class _Steps:
    """Groups of rows side by side: step t has the t-th row of each group that has as many. `begin` and `size` are the groups', longest first from here on."""

    def __init__(self, model: Model, rows: pd.DataFrame, begin: np.ndarray, size: np.ndarray):
        self.model, self.rows = model, rows
        self.order = np.argsort(-size, kind="stable")
        self.begin, self.size = begin[self.order], size[self.order]
        self.active = np.searchsorted(-self.size, -np.arange(1, self.size[0] + 1), "right") if len(size) else np.zeros(0, int)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of the rows, their matrices) of each step."""
        yield from self._blocks(range(len(self.active)))

    def reversed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self._blocks(range(len(self.active) - 1, -1, -1))

    def _blocks(self, steps: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        while at < len(steps):
            some, n = [], 0
            while at < len(steps) and (not some or (n + self.active[steps[at]]) * self.model.states**2 <= ELEMENTS):
                some.append(self.begin[: self.active[steps[at]]] + steps[at])
                n += len(some[-1])
                at += 1
            matrices, done = self.model.matrices(self.rows.iloc[np.concatenate(some)]), 0
            for places in some:
                yield places, matrices[done : done + len(places)]
                done += len(places)


def _with_ends(df: DataFrame, keys: dict[str, str], order: str, model: Model, width: float, *also: str) -> DataFrame:
    """The rows of each piece, sorted, behind a row (`__row` 0) with its ends."""
    pieces = _pieces(df, keys, order, model, width, *also)
    met = _ends(_products(pieces, keys, order, model), keys, model).withColumn("__row", F.lit(0))
    return _dealt(pieces.withColumn("__row", F.lit(1)).unionByName(met, allowMissingColumns=True), [*keys, "piece"], "__row", order)


def best_paths(df: DataFrame, keys: dict[str, str], order: str, model: Model, width: float = 1 << 16) -> DataFrame:
    """The best path of each key as runs of a state: keys, run (from 1), state, start, end (of the order column), n, score (of the whole path).

    Of equal ones the path through the states of least number, from its end on."""
    by = [*keys, "piece"]
    kind = df.schema[order].dataType.simpleString()

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _, head in _whole(frames, by):
            size = np.diff(np.append(head, len(rows))) - 1
            steps = _Steps(model, rows, head + 1, size)
            ends = rows.iloc[head[steps.order]]
            now, back = _stacked(ends, "before", model.states), np.zeros((len(rows), model.states), np.int32)
            for places, m in steps:
                each = now[: len(places), :, None] + m
                back[places], now[: len(places)] = each.argmax(axis=1), each.max(axis=1)
            path, state = np.full(len(rows), -1), ends["last"].to_numpy(np.int64)
            for t in range(len(steps.active) - 1, -1, -1):
                places = steps.begin[: steps.active[t]] + t
                path[places] = state[: len(places)]
                state[: len(places)] = back[places, state[: len(places)]]
            new = np.ones(len(rows), bool)
            new[1:] = path[1:] != path[:-1]
            new[head + 1] = True
            new[head] = False
            inside = np.ones(len(rows), bool)
            inside[head] = False
            first = np.flatnonzero(new & inside)
            until = np.append(first[1:], len(rows)) - 1
            until -= ~inside[until]  # a piece's last run ends before the next piece's head
            place, whole = rows[order].to_numpy(), np.repeat(rows["score"].to_numpy()[head], size + 1)
            yield rows.iloc[first][by].assign(state=path[first], start=place[first], end=place[until], n=until - first + 1, score=whole[first]).astype({"start": place.dtype if kind == "double" else np.int64, "end": place.dtype if kind == "double" else np.int64})

    runs = _with_ends(df, keys, order, model, width).mapInPandas(trace, f"{_typed(keys)}, piece long, state long, start {kind}, end {kind}, n long, score double")
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.when(F.lag("state").over(w) == F.col("state"), 0).otherwise(1)
    joined = runs.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*keys, "run", "state").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.first("score").alias("score"))


def _both_ways(model: Model, rows: pd.DataFrame, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, _Steps]:
    """Scores of the states at each row of what lies up to it and behind it, and of the whole; heads hold what is before and behind their pieces."""
    size = np.diff(np.append(head, len(rows))) - 1
    steps = _Steps(model, rows, head + 1, size)
    ends = rows.iloc[head[steps.order]]
    upto, behind = np.zeros((len(rows), model.states)), np.zeros((len(rows), model.states))
    upto[head[steps.order]] = now = _stacked(ends, "before", model.states)
    for places, m in steps:
        now[: len(places)] = model.over(now[: len(places), :, None] + m, 1)
        upto[places] = now[: len(places)]
    now = _stacked(ends, "behind", model.states)
    for places, m in steps.reversed():
        behind[places] = now[: len(places)]
        now[: len(places)] = model.over(m + now[: len(places), None, :], 2)
    return upto, behind, np.repeat(rows["score"].to_numpy()[head], size + 1), steps


def _shares(scores: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """exp(scores - whole); where nothing is possible, NaN."""
    with np.errstate(invalid="ignore"):
        return np.exp(scores - whole)


def posteriors(df: DataFrame, keys: dict[str, str], order: str, model: Model, width: float = 1 << 16) -> DataFrame:
    """keys, the order column, posterior (the chance of each state at the row, given all rows of the key) and log_likelihood. Chances are null where no path is possible."""
    by, kind = [*keys, "piece"], df.schema[order].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _, head in _whole(frames, by):
            upto, behind, whole, _ = _both_ways(model, rows, head)
            inside = rows["__row"].to_numpy() == 1
            chance = _shares(upto[inside] + behind[inside], whole[inside, None])
            out = rows.loc[inside, [*keys, order]].assign(posterior=list(chance), log_likelihood=whole[inside])
            yield out if kind == "double" else out.astype({order: np.int64})

    return _with_ends(df, keys, order, model, width).mapInPandas(run, f"{_typed(keys)}, `{order}` {kind}, posterior array<double>, log_likelihood double")


def expected_moves(df: DataFrame, keys: dict[str, str], order: str, model: Model, by: dict[str, str], width: float = 1 << 16) -> DataFrame:
    """by, h_from, h_to, expected: how often a path steps from one state to the other at rows of equal `by`, in expectation over all paths.

    Steps into the first row count, from the states before it. Tasks sum over their rows first. Steps that are impossible have no row; keys without a possible path count nothing."""
    pieces = [*keys, "piece"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _, head in _whole(frames, pieces):
            upto, behind, whole, steps = _both_ways(model, rows, head)
            inside = rows["__row"].to_numpy() == 1
            labels = rows[[*by]].copy()
            label = labels.groupby([*by], sort=False, dropna=False).ngroup().to_numpy()
            label[~inside] = -1
            total = np.zeros((label.max() + 1, model.states, model.states))
            for places, m in steps:
                with np.errstate(invalid="ignore"):
                    part = _shares(upto[places - 1][:, :, None] + m + behind[places][:, None, :], whole[places, None, None])
                np.add.at(total, label[places], np.where(np.isfinite(part), part, 0.0))
            first = np.unique(np.where(label >= 0, label, total.shape[0]), return_index=True)
            at = first[1][first[0] < total.shape[0]]
            k, i, j = np.nonzero(total[first[0][first[0] < total.shape[0]]])
            if len(k):
                yield labels.iloc[at[k]].assign(h_from=i, h_to=j, expected=total[first[0][k], i, j])

    rows = _with_ends(df, keys, order, model, width, *by)
    return rows.mapInPandas(run, f"{_typed(by)}, h_from long, h_to long, expected double").groupBy(*by, "h_from", "h_to").agg(F.sum("expected").alias("expected"))


def flat(emissions: list[str], penalty: float) -> Model:
    """States with log emissions, where a switch between any two costs `penalty`."""
    n = len(emissions)
    move = -penalty * (1 - np.eye(n))
    return Model(np.zeros(n), emissions, lambda rows: move[None] + rows[emissions].to_numpy(float)[:, None, :])


def strands(emissions: list[str], switch: str) -> Model:
    """The likelihood of 2^b states, b strands of two that switch apart with chance `switch` on the way to a row, from an even start. Emissions are chances."""
    n = len(emissions)
    bits = n.bit_length() - 1
    turns = np.array([[bin(i ^ j).count("1") for j in range(n)] for i in range(n)])

    def matrices(rows: pd.DataFrame) -> np.ndarray:
        t = rows[switch].to_numpy(float)[:, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):  # at 0 and 1 what doesn't happen is impossible, and none of it costs nothing
            moved = np.where(turns > 0, turns * np.log(t), 0.0) + np.where(turns < bits, (bits - turns) * np.log1p(-t), 0.0)
            return moved + np.log(rows[emissions].to_numpy(float))[:, None, :]

    return Model(np.full(n, -np.log(n)), [*emissions, switch], matrices, likelihood=True)


def burst(emission: str, opening: float, extending: float, uniform: float) -> Model:
    """A log emission, or a burst in its place: opened at `opening`, each of its rows at `extending` + `uniform`; its end costs nothing."""

    def matrices(rows: pd.DataFrame) -> np.ndarray:
        e, out = rows[emission].to_numpy(float), np.empty((len(rows), 2, 2))
        out[:, :, 0] = e[:, None]
        out[:, 0, 1], out[:, 1, 1] = opening + uniform + extending, uniform + extending
        return out

    return Model(np.array([0.0, -np.inf]), [emission], matrices)


def diploid(founders: int, emissions: str, gap: str, rate: float, damping: float, both: float = 1.5) -> Model:
    """Ordered pairs of founders, state h1 * founders + h2, with an array of log emissions a row.

    A switch of one founder costs ln(theta) - damping, spread over the others, theta = gap * rate within [1e-15, 0.5]; of both, `both` times that."""
    h1, h2 = np.divmod(np.arange(founders**2), founders)
    turns = (h1[:, None] != h1[None, :]).astype(int) + (h2[:, None] != h2[None, :])
    spread = np.log(max(1, founders - 1))

    def matrices(rows: pd.DataFrame) -> np.ndarray:
        theta = np.clip(np.maximum(rows[gap].to_numpy(float), 1.0) * rate, 1e-15, 0.5)
        switch, stay = np.log(theta) - damping, np.log1p(-theta)
        cost = np.stack((2 * stay, switch + stay - spread, both * switch - 2 * spread), 1)
        first = np.isnan(rows[gap].to_numpy(float))  # the first row of all has nothing before it
        cost[first] = [0.0, -np.inf, -np.inf]
        return cost[:, turns] + np.stack(rows[emissions].to_numpy())[:, None, :]

    return Model(np.zeros(founders**2), [emissions, gap], matrices)


def bounded(emissions: list[str], most: int) -> Model:
    """States with log emissions and at most `most` switches, which cost nothing: state r * len(emissions) + s after r switches. Before the first row there has been none."""
    n = len(emissions)
    r, s = np.divmod(np.arange((most + 1) * n), n)
    move = np.where((r[:, None] == r[None, :]) & (s[:, None] == s[None, :]) | (r[:, None] + 1 == r[None, :]) & (s[:, None] != s[None, :]), 0.0, -np.inf)
    return Model(np.where(r == 0, 0.0, -np.inf), emissions, lambda rows: move[None] + np.tile(rows[emissions].to_numpy(float), most + 1)[:, None, :])


def unordered(founders: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs a <= b of founders, in the order of a * founders + b: the states of an individual whose two strands have no order."""
    return np.triu_indices(founders)


def folded(founders: int, emissions: str, gap: str, rate: float) -> Model:
    """The likelihood of unordered pairs of founders, of which one at most switches on the way to a row.

    A switch has chance theta = gap * rate, within [1e-15, 0.5], and goes to each other founder alike; the rest of the chance stays on the
    pair, at (1 - theta)^2: that neither strand switches (that both do is left out, so the sum is below 1). emissions: an array of log
    emissions, one a pair. There are founders * (founders + 1) / 2 states, each of which leads to 2 * founders - 1 at most. The first row, of a null gap, has an even start over ordered pairs."""
    a, b = unordered(founders)
    n = len(a)
    ways = np.zeros((n, n))  # by how many switches of one strand a pair becomes another
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        for new in range(founders):
            for kept, left in ((y, x), (x, y)):
                if new != left:
                    ways[k, np.flatnonzero((a == min(new, kept)) & (b == max(new, kept)))[0]] += 1
    with np.errstate(divide="ignore"):
        switches, stays = np.log(ways), np.log(np.eye(n))
    spread = np.log(max(1, founders - 1))

    def matrices(rows: pd.DataFrame) -> np.ndarray:
        distance = rows[gap].to_numpy(float)
        theta = np.clip(np.maximum(np.nan_to_num(distance, nan=1.0), 1.0) * rate, 1e-15, 0.5)[:, None, None]
        move = np.logaddexp(stays + 2 * np.log1p(-theta), switches + np.log(theta) + np.log1p(-theta) - spread)
        move[np.isnan(distance)] = stays
        return move + _stacked(rows, emissions, n)[:, None, :]

    return Model(np.where(a == b, 0.0, np.log(2.0)) - 2 * np.log(founders), [emissions, gap], matrices, likelihood=True)
