"""Phase correction through a pedigree: which of a sample's strands comes from which parent, bin by bin, told by its parents and its children.

A round has two models of `paths`, both over the bins of a chromosome. The first says, for each parent and child, which strand of the parent the child has got. Of a parent the
switches of all its children are then summed by bin. The second corrects each sample that has both parents: a change of its own phase costs much, but it explains at one stroke the switches
of all children that fall there, and leaves those without one to be explained. Rounds follow until no sample changes, as a corrected sample is another's parent or child.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paths import Model, best_paths

#: Log costs of an allele that doesn't fit its parent's, and of a change of phase between heterozygous bins.
MISMATCH, TURN = 4.6, 20.0
_BIN = ["c1", "c2", "p1", "p2", "q1", "q2", "switch", "stay", "free"]


def _emission(rows: pd.DataFrame) -> np.ndarray:
    """(row, state): state 4 * phase + 2 * the first parent's strand + the second's; in phase 0 the first parent gives the first strand. Missing founders fit anything."""
    x = rows[_BIN[:6]].fillna(-1).to_numpy(np.int64)
    differ = lambda a, b: (x[:, a] != x[:, b]) & (x[:, a] >= 0) & (x[:, b] >= 0)
    return -MISMATCH * np.stack([differ(s >> 2, 2 + (s >> 1 & 1)).astype(float) + differ(1 - (s >> 2), 4 + (s & 1)) for s in range(8)], 1)


_APART = np.arange(8)[:, None] ^ np.arange(8)[None, :]
_TURNS = (_APART & 1) + (_APART >> 1 & 1)


def _model(children: bool) -> Model:
    def matrices(rows: pd.DataFrame) -> np.ndarray:
        number = lambda c: rows[c].to_numpy(float)[:, None, None]
        switch, stay = number("switch"), number("stay")
        step = _TURNS * switch + (2 - _TURNS) * stay
        same, other = 0.0, -TURN * (1 - number("free"))
        if children:
            moved, still = number("moved"), number("still")
            same, other = moved * switch + still * stay, other + moved * stay + still * switch
        return step + np.where(_APART >> 2, other, same) + _emission(rows)[:, None, :]

    return Model(np.zeros(8), _BIN + (["moved", "still"] if children else []), matrices)


def _sorted(df: DataFrame) -> DataFrame:
    """For a join by sorting: a table of bins is a few bits a row in its file, by which Spark would take it for small and hold it whole on the driver to broadcast it."""
    return df.hint("merge")


def _trios(painted: DataFrame, pedigree: DataFrame, rate: float) -> DataFrame:
    """(child, father, mother, bin, c1, c2, p1, p2, q1, q2, switch, stay, free): bins that all three have. The first bin of a child steps for nothing."""
    of = lambda who, one, two: painted.select(F.col("sample").alias(who), "bin", F.col("h1").alias(one), F.col("h2").alias(two))
    own = painted.select(F.col("sample").alias("child"), "bin", "width", F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    known = pedigree.filter("father is not null and mother is not null")
    met = own.join(_sorted(known), "child").join(_sorted(of("father", "p1", "p2")), ["father", "bin"]).join(_sorted(of("mother", "q1", "q2")), ["mother", "bin"])
    w = Window.partitionBy("child").orderBy("bin")
    alike = F.coalesce(F.col("c1") == F.col("c2"), F.lit(False))
    chance = F.least(F.greatest(F.col("width") * rate, F.lit(1e-15)), F.lit(0.5))
    first = F.row_number().over(w) == 1
    cost = lambda x: F.when(first, 0.0).otherwise(F.ln(x))
    return met.select("child", "father", "mother", "bin", "c1", "c2", "p1", "p2", "q1", "q2", cost(chance).alias("switch"), cost(1 - chance).alias("stay"), (first | alike | F.coalesce(F.lag(alike).over(w), F.lit(True))).cast("double").alias("free"))


def _by_bin(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Each bin's state, from the runs of its child: a run's start is carried on to the bins before the next one."""
    begun = rows.select("child", "bin").join(_sorted(runs.select("child", F.col("start").alias("bin"), "state")), ["child", "bin"], "left")
    return begun.withColumn("state", F.last("state", ignorenulls=True).over(Window.partitionBy("child").orderBy("bin")))


def inherited(trios: DataFrame, kind: str) -> DataFrame:
    """(parent, child, bin, strand, moved): the strand of each parent that a child has got, and whether it is another than in the bin before.

    Both parents come from one path: in a trio the child's phase and both parents' strands are one state."""
    state = _by_bin(best_paths(trios, {"child": kind}, "bin", _model(False)), trios).join(_sorted(trios.select("child", "bin", "father", "mother")), ["child", "bin"])
    strand = lambda shift: F.call_function("shiftright", "state", F.lit(shift)).bitwiseAND(F.lit(1).cast("bigint")).cast("int")
    both = F.explode(F.array(F.struct(F.col("father").alias("parent"), strand(1).alias("strand")), F.struct(F.col("mother").alias("parent"), strand(0).alias("strand"))))
    each = state.select("child", "bin", both.alias("e")).select("e.parent", "child", "bin", "e.strand")
    return each.withColumn("moved", F.coalesce(F.col("strand") != F.lag("strand").over(Window.partitionBy("parent", "child").orderBy("bin")), F.lit(False)))


def phases(painted: DataFrame, pedigree: DataFrame, kind: str, rate: float = 5e-8) -> DataFrame:
    """(sample, bin, phase): 1 where the strands of a sample with both parents are to be exchanged, so that the first comes from its father.

    painted: (sample, bin, width, h1, h2), bins whole numbers, one row each, founders by number (a class of equal ones in a bin is one number), null or negative if unknown; pedigree: (child, father, mother)."""
    trios = _trios(painted, pedigree, rate)
    got = inherited(trios, kind).groupBy(F.col("parent").alias("child"), "bin").agg(F.sum(F.col("moved").cast("double")).alias("moved"), F.count(F.lit(1)).cast("double").alias("kids"))
    rows = trios.join(_sorted(got), ["child", "bin"], "left").fillna(0.0, ["moved", "kids"]).withColumn("still", F.col("kids") - F.col("moved"))
    state = _by_bin(best_paths(rows, {"child": kind}, "bin", _model(True)), rows)
    return state.select(F.col("child").alias("sample"), "bin", F.call_function("shiftright", "state", F.lit(2)).cast("int").alias("phase"))


def corrected(painted: DataFrame, pedigree: DataFrame, kind: str, written: Callable[[DataFrame], DataFrame], rate: float = 5e-8, rounds: int = 10) -> tuple[DataFrame, int]:
    """The paintings with corrected strands, and how many rounds changed any. Rounds end when none does, or after `rounds`.

    Samples without both parents stay as they are. Each round's tables are written."""
    now = written(painted.select("sample", "bin", "width", "h1", "h2"))
    known = written(pedigree.select("child", "father", "mother"))
    for done in range(rounds):
        turned = written(phases(now, known, kind, rate).filter("phase = 1"))
        if turned.isEmpty():
            return now, done
        swap = F.col("phase").isNotNull()
        now = written(now.join(_sorted(turned), ["sample", "bin"], "left").select("sample", "bin", "width", F.when(swap, F.col("h2")).otherwise(F.col("h1")).alias("h1"), F.when(swap, F.col("h1")).otherwise(F.col("h2")).alias("h2")))
    return now, rounds
