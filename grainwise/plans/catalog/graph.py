"""The graph of definitions: nodes(id, kind, name), edges(src, dst, kind), and what can be reached in it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...sources.staging import discard, shuffle_tasks, staged


#: Rounds that a closure goes step by step before it contracts what is left.
STEP_ROUNDS = 6
#: Rounds up to which a closure reads the edges as they are in each, and doesn't write them without repeats first.
READ_ROUNDS = 2


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def build(nodes: Sequence[DataFrame], edges: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without repeats. They are dealt by key first, to a stated number of tasks, which adaptive execution doesn't merge: few
    repeat, so a task that reads would hold all it has read, and a merged one millions of keys."""
    n = shuffle_tasks(nodes[0].sparkSession)
    return union(nodes).repartition(n, "id").dropDuplicates(["id"]), union(edges).repartition(n, "src", "dst").dropDuplicates(["src", "dst", "kind"])


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


def closure(edges: DataFrame, starts: DataFrame, backwards: bool = False, most: int | None = None, step_rounds: int = STEP_ROUNDS) -> DataFrame:
    """(start, id, depth) of all that starts (id) lead to, cycles included once, within `most` steps if that is given; depth is the least number of steps.

    Edges may repeat. They are dealt by the end they leave and sorted once, and kept so on the executors' disks: a round deals its frontier alone.
    The first rounds go step by step: each joins the frontier alone. What is deeper is contracted: chains of nodes with one
    way in and one way out, however long, and cycles with them, become one edge of their length each, in rounds that grow
    with its logarithm; then each round follows an edge.
    """
    a, b = ("dst", "src") if backwards else ("src", "dst")
    step = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"))
    if most is None or most > READ_ROUNDS:
        step = dealt(step)
    seen = frontier = staged(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct(), "frontier")
    parts, depth = [frontier], 0
    while most is None or depth < most:
        depth += 1
        ahead = frontier.join(step, F.col("id") == F.col("_from")).select("start", F.col("_to").alias("id"), F.lit(depth).alias("depth"))
        # One exchange tells repeats and what was seen apart from what is new.
        frontier = staged(least(ahead.unionByName(union(parts))).filter(F.col("depth") == depth), "frontier")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if depth == step_rounds:
            step = dealt(step) if most is not None and most <= READ_ROUNDS else step
            seen = staged(union(parts), "seen")
            deeper = _closure_of_chains(step, seen, frontier, most)
            step.unpersist()
            discard(*parts)
            return deeper.filter("depth > 0")
    step.unpersist()
    return union(parts).filter("depth > 0")


def dealt(step: DataFrame) -> DataFrame:
    """step (_from, _to) without repeats, dealt by _from to the session's number of shuffle tasks and sorted in each, on disk until unpersisted."""
    step = step.repartition(shuffle_tasks(step.sparkSession), "_from").distinct().sortWithinPartitions("_from").persist(StorageLevel.DISK_ONLY)
    step.count()  # joins know how it is dealt once it is there
    return step


def least(paths: DataFrame) -> DataFrame:
    """(start, id, depth): the shortest of paths."""
    return paths.groupBy("start", "id").agg(F.min("depth").alias("depth"))


def _closure_of_chains(step: DataFrame, seen: DataFrame, frontier: DataFrame, most: int | None) -> DataFrame:
    """seen, carried on from its frontier to the end."""
    edges, inside = contracted(step, frontier.select("id").distinct())
    best, parts, n = seen, [seen], 0
    while True:
        ahead = frontier.join(edges, F.col("id") == F.col("_from")).select("start", F.col("_to").alias("id"), (F.col("depth") + F.col("steps")).alias("depth"))
        if most is not None:
            ahead = ahead.filter(F.col("depth") <= most)
        known = union(parts).groupBy("start", "id").agg(F.min("depth").alias("_known"))
        frontier = staged(least(ahead).join(known, ["start", "id"], "left").filter("_known IS NULL OR depth < _known").select("start", "id", "depth"), "frontier")
        n += 1
        if frontier.isEmpty():
            break
        parts.append(frontier)
    best = staged(least(union(parts)), "seen")
    between = best.join(inside, F.col("id") == F.col("_from")).select("start", F.col("_to").alias("id"), (F.col("depth") + F.col("steps")).alias("depth"))
    if most is not None:
        between = between.filter(F.col("depth") <= most)
    found = staged(least(best.unionByName(between)), "reach")
    discard(edges, inside, best, *parts)
    return found


def contracted(step: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, inside) of a graph of steps (_from, _to): chains between nodes that are in kept (id), or have not just one way in and one way out, as (_from, _to, steps); and the nodes on them, by the steps from the node the chain leaves.

    Each node on a chain points back to the node before it; a round doubles the way twice. Cycles that nothing leads into
    stay unresolved and are left out.
    """
    ways = step.select(F.col("_from").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(step.select(F.col("_to").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    plain = ways.groupBy("id").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).filter("out = 1 AND in = 1").select("id").join(kept, "id", "left_anti")
    plain = staged(plain, "plain")
    back = step.join(plain.select(F.col("id").alias("_to")), "_to").select(F.col("_to").alias("id"), F.col("_from").alias("at"), F.lit(1).alias("steps"))
    back = staged(back.join(plain.select(F.col("id").alias("at"), F.lit(True).alias("open")), "at", "left").select("id", "at", "steps", F.coalesce("open", F.lit(False)).alias("open")), "chains")
    left, before = back.filter("open").count(), None
    while left and left != before:
        for _ in range(2):
            onward = back.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
            longer = back.filter("open").join(onward, "at").select("id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open"))
            back = back.filter("NOT open").unionByName(longer)
        back, before = staged(back, "chains"), left
        left = back.filter("open").count()
    inside = staged(back.filter("NOT open").select(F.col("at").alias("_from"), F.col("id").alias("_to"), "steps"), "chains")
    into = inside.select(F.col("_from"), F.col("_to").alias("_last"), "steps").join(step.withColumnsRenamed({"_from": "_last"}), "_last")
    longer = into.join(plain.select(F.col("id").alias("_to")), "_to", "left_anti").select("_from", "_to", (F.col("steps") + 1).alias("steps"))
    ends = plain.select(F.col("id").alias("_from")), plain.select(F.col("id").alias("_to"))
    short = step.join(ends[0], "_from", "left_anti").join(ends[1], "_to", "left_anti").select("_from", "_to", F.lit(1).alias("steps"))
    edges = staged(longer.unionByName(short).groupBy("_from", "_to").agg(F.min("steps").alias("steps")), "chain-edges")
    discard(plain, back)
    return edges, inside


def neighbourhood(edges: DataFrame, nodes: DataFrame, start: str, depth: int = 2, per_column: int = 12, always: Sequence[str] = ("source",)) -> DataFrame:
    """(id, kind, depth, more): nodes within `depth` steps either way, nearest depth first, and the neighbours of these of a kind in `always`, a step further; at most per_column of a kind and depth, the rest counted in `more`.

    Edges and nodes may repeat. What is reached is written before it meets the edges or nodes, so that where it is small these are read and not dealt.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    begin = nodes.filter(F.col("id") == start).select("id")
    within = closure(both, begin, most=depth).select("id", "depth")
    around = staged(within.unionByName(begin.distinct().select("id", F.lit(0).alias("depth"))), "around")
    beyond = around.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("_within"))
    reached = around.withColumn("_within", F.lit(True)).unionByName(beyond).filter(F.col("id") != start)
    reached = staged(reached.groupBy("id", "_within").agg(F.min("depth").alias("depth")), "reached")
    found = reached.join(nodes.select("id", "kind"), "id").filter(F.col("_within") | F.col("kind").isin(*always))
    found = found.groupBy("id").agg(F.min("depth").alias("depth"), F.min("kind").alias("kind"))
    column = Window.partitionBy("kind", "depth")
    ranked = found.withColumn("_nth", F.row_number().over(column.orderBy("id"))).withColumn("_n", F.count("*").over(column))
    return ranked.filter(F.col("_nth") <= per_column).select("id", "kind", "depth", F.greatest(F.col("_n") - per_column, F.lit(0)).alias("more"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n)."""
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def table_refs(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """refs (id, names array): the names that are tables (name)."""
    return refs.select("id", F.explode("names").alias("name")).distinct().join(tables.select("name").distinct(), "name", "left_semi")


def resolve_fold(inputs: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """(id, folded): an array column of each node united with those of all it depends on."""
    reach = closure(edges, inputs.select("id"))
    own = inputs.select(F.col("id").alias("start"), F.col(column).alias("_v"))
    more = reach.join(inputs.select("id", F.col(column).alias("_v")), "id").select("start", "_v")
    return own.unionByName(more).select("start", F.explode("_v").alias("v")).groupBy(F.col("start").alias("id")).agg(F.array_sort(F.collect_set("v")).alias("folded"))
