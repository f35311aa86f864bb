"""Pedigree graphs: edges, generations, consistency and cycles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parent_edges(pedigree: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """A row for each known parent: child, slot, parent."""
    slots = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("slot"), F.col(p).alias("parent")) for i, p in enumerate(parents)]))
    return pedigree.select(F.col(child).alias("child"), slots.alias("e")).select("child", "e.slot", "e.parent").filter("parent is not null")


def fam(pedigree: DataFrame, family: str, child: str, father: str, mother: str, sex: str) -> DataFrame:
    """PLINK's six FAM columns; unknown parents and sexes are 0."""
    code = F.when(F.col(sex) == "M", 1).when(F.col(sex) == "F", 2).otherwise(0)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    return pedigree.select(F.lit(family).alias("fid"), F.col(child).cast("string").alias("iid"), text(father).alias("pid"), text(mother).alias("mid"), code.alias("sex"), F.lit(-9).alias("phenotype"))


def written(df: DataFrame) -> DataFrame:
    """The rows, written as a table to the checkpoint folder: the next round begins there. Where none is set a local session (tests) gets one of our own; a cluster gets an error, as its machines share none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    path, schema = f"{context.getCheckpointDir().rstrip('/')}/written-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)  # a checkpoint would hand on the plan's constraints, which grow with each round
    return df.sparkSession.read.schema(schema).parquet(path)


def generations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, generation): roots 1, others one more than their latest parent; null on or behind a cycle, or behind a parent that is no node.

    A round for each generation, however many there are: a child is named when all its parents are. What is left waits
    in the checkpoint folder for the next round; the rounds end when no node is named."""
    edges = written(edges.select("child", "parent").distinct())
    nodes = written(nodes.select("node").distinct())
    left = edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    last = written(nodes.join(left, "node", "left_anti"))
    named = []
    while not last.isEmpty():
        named.append(last.withColumn("generation", F.lit(len(named) + 1)))
        done = edges.join(last.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("done"))
        met = written(left.join(done, "node", "left").select("node", (F.col("open") - F.coalesce("done", F.lit(0))).alias("open")))
        left, last = met.filter("open > 0"), met.filter("open = 0").select("node")
    if not named:
        return nodes.withColumn("generation", F.lit(None).cast("int"))
    return nodes.join(reduce(DataFrame.unionByName, named), "node", "left")


def on_cycles(edges: DataFrame) -> DataFrame:
    """The nodes on or behind a directed cycle and before another: those that stay when nodes without parents, or without children, are peeled off until none is left to peel."""
    left = written(edges.select("child", "parent").distinct())
    n = left.count()
    while True:
        inner = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent")
        left, before = written(inner), n
        n = left.count()
        if n == before:
            break
    return left.select(F.explode(F.array("child", "parent")).alias("node")).distinct()


def unknown_parents(pedigree: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """Edges to a parent that is no one's row."""
    edges = parent_edges(pedigree, child, parents)
    return edges.join(pedigree.select(F.col(child).alias("parent")), "parent", "left_anti")


def _parts(edges: DataFrame) -> DataFrame:
    """(node, part): the least node that each is joined to, in either direction, of a small graph."""
    both = written(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).union(edges.select("parent", "child")).distinct())
    label = written(both.select(F.col("a").alias("node"), F.col("a").alias("part")).distinct())
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("part").alias("near"))
        new = written(label.join(near, "node").select("node", F.least("part", "near").alias("part"), (F.col("near") < F.col("part")).alias("moved")))
        label = new.select("node", "part")
        if new.filter("moved").isEmpty():
            return label


def resolve_cycles(pedigree: DataFrame, child: str, parents: list[str], score: str) -> DataFrame:
    """The pedigree without cycles: time and again, of the nodes on a cycle, the one with most children, then the lowest score, then the least, loses its parents.

    Nodes on cycles are those of strong components; components that an edge joins are one part, and parts are cut side by side, as a cut changes the number
    of children in its own part alone. Later rounds look at what was on cycles. A missing score is 0."""
    now, left = written(pedigree), None
    while True:
        edges = written(parent_edges(now, child, parents).select("child", "parent").distinct())
        left = edges if left is None else left  # no cycle comes to be, so later rounds look where there were some
        on = written(strong_components(left))
        if on.isEmpty():
            return now
        inner = left.join(on.select(F.col("node").alias("child"), F.col("component").alias("c")), "child").join(on.select(F.col("node").alias("parent"), F.col("component").alias("p")), "parent")
        inner = written(inner)
        parts = _parts(inner.filter("c <> p").select(F.col("c").alias("child"), F.col("p").alias("parent")))
        placed = on.join(parts.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("part", "component").alias("part"))
        children = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
        known = now.select(F.col(child).alias("node"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
        first = F.min(F.struct(-F.col("children"), "score", "node"))
        cut = written(placed.join(children, "node").join(known, "node").groupBy("part").agg(first.alias("first")).select(F.col("first.node").alias("__cut")))
        left = inner.select("child", "parent").join(cut, F.col("child") == F.col("__cut"), "left_anti")
        joined = now.join(cut, F.col(child) == F.col("__cut"), "left")
        now = written(joined.withColumns({p: F.when(F.col("__cut").isNull(), F.col(p)) for p in parents}).drop("__cut"))


def _contracted(live: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Edges (a, b) without dead ends and one-way nodes: what is left, whole cycles (node, component), nodes on a way (node, x, y), and nodes that a way leads back to.

    A node of one edge in and one out lies on the way between the two ends of its chain, found by pointer jumping: a chain of any length takes the logarithm of it in joins."""
    cycles, ways, loops = [], [], []
    n = live.count()
    while n:
        inside = live.join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        live = written(inside.select("a", "b"))
        out = live.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("to")).filter("n = 1")
        into = live.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("of")).filter("n = 1")
        chain = written(out.join(into, "node").select("node", "to", "of", F.col("node").alias("least")))
        many = chain.count()
        if many:
            jump = chain
            for _ in range(many.bit_length() + 1):
                ahead = jump.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("least").alias("__least"))
                back = jump.select(F.col("node").alias("of"), F.col("of").alias("__of"))
                met = jump.join(ahead, "to", "left").join(back, "of", "left")
                jump = written(met.select("node", F.coalesce("__to", "to").alias("to"), F.coalesce("__of", "of").alias("of"), F.least("least", F.coalesce("__least", "least")).alias("least")))
            names = chain.select("node")
            whole = jump.join(names.withColumnRenamed("node", "to"), "to", "left_semi")
            cycles.append(whole.select("node", F.col("least").alias("component")))
            way = written(jump.join(names.withColumnRenamed("node", "to"), "to", "left_anti").select("node", F.col("of").alias("x"), F.col("to").alias("y")))
            ways.append(way)
            loops.append(way.filter("x = y").select(F.col("x").alias("node")))
            rest = live.join(names.withColumnRenamed("node", "a"), "a", "left_anti").join(names.withColumnRenamed("node", "b"), "b", "left_anti")
            live = written(rest.select("a", "b").union(way.filter("x <> y").select("x", "y")).distinct())
        now = live.count()
        if now == n and not many:
            break
        n = now
    return live, cycles, ways, loops


def _strong(edges: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of components of several nodes, by one depth-first search."""
    after: dict = {}
    for some in edges:
        for a, b in zip(some["a"].tolist(), some["b"].tolist(), strict=True):
            after.setdefault(a, []).append(b)
            after.setdefault(b, [])
    number: dict = {}
    low: dict = {}
    open_: dict = {}
    out = []
    for root in after:
        walk = [(root, iter(after[root]))] if root not in number else []
        while walk:
            node, ahead = walk[-1]
            if node not in number:
                number[node] = low[node] = len(number)
                open_[node] = None
            for other in ahead:
                if other not in number:
                    walk.append((other, iter(after[other])))
                    break
                if other in open_:
                    low[node] = min(low[node], number[other])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(open_.popitem()[0])
                    out += [(x, node) for x in part] if len(part) > 1 else []
    yield pd.DataFrame(out, columns=["node", "component"])


def strong_components(edges: DataFrame, small: int = 1 << 17) -> DataFrame:
    """(node, component): of the nodes on a directed cycle, an edge to itself included, the least node that each reaches and is reached from. edges: (child, parent).

    Dead ends and one-way nodes go first, however long their chains. Of what is left, each node takes the greatest node that reaches it as its colour; a colour's own node, with those of its
    colour that reach it, is a component. Those are set aside, and what is left is looked at again. Rows never grow beyond the edges; rounds are as many as the contracted graph is deep.
    What is left of `small` edges or fewer is one task's."""
    every = written(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).filter("a is not null and b is not null").distinct())
    live = written(every.filter("a <> b"))
    found, ways, loops = [], [], [every.filter("a = b").select(F.col("a").alias("node"))]
    kind = every.schema["a"].dataType.simpleString()
    while True:
        n = live.limit(small + 1).count()
        if n <= small:
            if n:
                found.append(written(live.repartition(1).mapInPandas(_strong, f"node {kind}, component {kind}")))
            break
        live, cycles, on_ways, looped = _contracted(live)
        found, ways, loops = found + cycles, ways + on_ways, loops + looped
        if live.isEmpty():
            break
        colour = written(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            near = live.join(colour, live["a"] == colour["node"]).groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("near"))
            new = written(colour.join(near, "node", "left").select("node", F.greatest("colour", F.coalesce("near", "colour")).alias("colour"), F.coalesce(F.col("near") > F.col("colour"), F.lit(False)).alias("moved")))
            colour = new.select("node", "colour")
            if new.filter("moved").isEmpty():
                break
        one = colour.select(F.col("node").alias("a"), F.col("colour").alias("ca"))
        two = colour.select(F.col("node").alias("b"), F.col("colour").alias("cb"))
        same = written(live.join(one, "a").join(two, "b").filter("ca = cb").select("a", "b", F.col("ca").alias("component")))
        last = reached = written(colour.filter("node = colour").select("node", F.col("colour").alias("component")))
        while True:
            more = same.join(last.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"), "component").distinct()
            last = written(more.join(reached.select("node"), "node", "left_anti"))
            if last.isEmpty():
                break
            reached = written(reached.unionByName(last))
        several = reached.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
        found.append(written(reached.join(several, "component", "left_semi").select("node", "component")))
        gone = reached.select("node")
        live = written(live.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
    known = reduce(DataFrame.unionByName, found) if found else every.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    loops = written(reduce(DataFrame.unionByName, loops).distinct())

    def with_alone(known: DataFrame, nodes: DataFrame) -> DataFrame:
        """Nodes of an edge to themselves that are in no component are one."""
        alone = nodes.select("node").join(known.select("node"), "node", "left_anti")
        return written(known.unionByName(alone.select("node", F.col("node").alias("component"))))

    on_ways = reduce(DataFrame.unionByName, [w.select("node") for w in ways]) if ways else loops.limit(0)
    known = with_alone(known, loops.join(on_ways, "node", "left_anti"))
    for way in reversed(ways):  # a node on a way is in the component of its ends, if that is one
        x, y = (known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "xy")
        known = known.unionByName(way.join(x, "x").join(y, "y").filter("cx = cy").select("node", F.col("cx").alias("component")))
        known = with_alone(known, loops.join(way, "node", "left_semi"))
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(least, "component").select("node", F.col("least").alias("component"))


def acyclic_choice(trios: DataFrame, child: str, first: str, second: str, score: str, passes: int = 1, tolerance: float = 1e-9) -> DataFrame:
    """One of each child's candidate pairs of parents, so that no one is their own ancestor: child, first, second, score.

    Children whose best candidate isn't ahead of the next are left out. The others choose in order of that margin, then of their ids: the best candidate that
    closes no cycle with what is chosen, if it is ahead of the next such one, or the only one; then each chooses again, `passes` times at most. Only candidates
    within one strong component of all candidates' edges can close a cycle, so all other children choose at once; a component is one task's group, as each of
    its choices depends on those before. A parent may be null. Of equal candidates the first by its parents' ids counts."""
    w = Window.partitionBy(child).orderBy(F.desc(score), F.asc_nulls_first(first), F.asc_nulls_first(second))
    ahead = F.max(F.when(F.col("__row") == 1, F.col(score))).over(Window.partitionBy(child)) - F.max(F.when(F.col("__row") == 2, F.col(score))).over(Window.partitionBy(child))
    rows = trios.select(child, first, second, score).withColumn("__row", F.row_number().over(w)).withColumn("__margin", ahead)
    rows = written(rows.filter(F.col("__margin") > tolerance))
    edges = rows.select(F.col(child).alias("child"), F.explode(F.array(first, second)).alias("parent")).filter("parent is not null")
    place = written(strong_components(edges))
    alone = rows.join(place.select(F.col("node").alias(child)), child, "left_anti").filter("__row = 1").select(child, first, second, score)
    held = rows.join(place.withColumnsRenamed({"node": child, "component": "__part"}), child)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alone.schema.fields)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([child, "__row"], kind="stable")
        own = set(group[child])
        options: dict = {}
        for c, a, b, x, margin in group[[child, first, second, score, "__margin"]].itertuples(index=False):
            parents = [p for p in (a, b) if not pd.isna(p) and p in own]  # the others are no one's descendants here
            options.setdefault(c, (margin, []))[1].append((x, parents, a, b))
        chosen: dict = {}
        below: dict = {c: set() for c in own}

        def reaches(start, ends: list) -> bool:
            stack, seen = [start], {start}
            while stack:
                now = stack.pop()
                if now in ends:
                    return True
                fresh = below[now] - seen
                seen |= fresh
                stack += fresh
            return False

        def best(c):
            open_ = [o for o in options[c][1] if not o[1] or not reaches(c, o[1])]
            return None if not open_ or len(open_) > 1 and open_[0][0] - open_[1][0] <= tolerance else open_[0]

        def put(c, option) -> None:
            if option is not None:
                chosen[c] = option
                for p in option[1]:
                    below[p].add(c)

        order = sorted(options, key=lambda c: (-options[c][0], c))
        for c in order:
            put(c, best(c))
        for _ in range(passes):
            changed = False
            for c in order:
                before = chosen.pop(c, None)
                for p in before[1] if before else ():
                    below[p].discard(c)
                after = best(c)
                put(c, after)
                changed |= after is not before
            if not changed:
                break
        return pd.DataFrame([(c, o[2], o[3], o[0]) for c, o in chosen.items()], columns=[child, first, second, score])

    return alone.unionByName(held.groupBy("__part").applyInPandas(run, shape))


def unsupported(pedigree: DataFrame, child: str, parents: list[str], support: DataFrame, share: str, least: float = 0.9) -> DataFrame:
    """The pedigree, where a child whose `share` in `support` (child, share) is below `least` has no parents; one without a row keeps them."""
    met = pedigree.join(support.select(F.col(child), F.col(share).alias("__share")), child, "left")
    lost = F.coalesce(F.col("__share") < least, F.lit(False))
    return met.withColumns({p: F.when(~lost, F.col(p)) for p in parents}).drop("__share")
