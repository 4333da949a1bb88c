"""Graphs of calls, imports and inheritance as edge tables (O-76, O-100, O-105, O-116, O-117, O-127 to O-132, O-136)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import ship, written

ONE_TASK_EDGES = 500_000  # some tens of MB of names


def reversed_edges(edges: DataFrame, source: str = "caller", target: str = "callee") -> DataFrame:
    """(callee, caller), each once (O-127)."""
    return edges.select(F.col(target), F.col(source)).distinct()


def degrees(edges: DataFrame, source: str = "caller", target: str = "callee") -> DataFrame:
    """Node and the edges it has, in and out (O-100)."""
    e = edges.select(source, target).distinct()
    ends = e.select(F.col(source).alias("node")).unionByName(e.select(F.col(target).alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def strongest(edges: DataFrame, most: int = 30, source: str = "caller", target: str = "callee") -> DataFrame:
    """The edges among the ``most`` nodes of highest degree, ties by name (O-136): a top list."""
    top = F.broadcast(degrees(edges, source, target).orderBy(F.desc("degree"), "node").limit(most).select("node"))
    return edges.join(top.withColumnRenamed("node", source), source, "left_semi").join(top.withColumnRenamed("node", target), target, "left_semi")


def busiest(edges: DataFrame, source: str = "caller", target: str = "callee") -> DataFrame:
    """The node with most targets, the smallest name of several (O-116)."""
    return edges.groupBy(source).agg(F.countDistinct(target).alias("targets")).orderBy(F.desc("targets"), source).limit(1)


def reachable(edges: DataFrame, starts: DataFrame, hops: int, source: str = "caller", target: str = "callee") -> DataFrame:
    """(start, node, hops) of all nodes within some hops of each start, by the shortest way; the start itself only over a cycle (O-129). ``starts``: column start."""
    e = written(edges.select(F.col(source).alias("node"), F.col(target).alias("next")).distinct(), "steps")
    front = starts.select("start").distinct().withColumn("node", F.col("start"))
    seen = None
    for k in range(1, hops + 1):
        step = front.join(e, "node").select("start", F.col("next").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        step = written(step.withColumn("hops", F.lit(k)), "reached")
        seen = step if seen is None else seen.unionByName(step)
        if not step.limit(1).count():
            break
        front = step.select("start", "node")
    return seen


def strong_parts(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Node -> smallest node of its strongly connected part, for those on a cycle: a depth-first walk that keeps its own stack."""
    ways: dict[str, list[str]] = {}
    for a, b in edges:
        ways.setdefault(a, []).append(b)
        ways.setdefault(b, [])
    met: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    place: dict[str, int] = {}
    part: dict[str, str] = {}
    done: set[str] = set()
    loops = {a for a, b in edges if a == b}
    for start in ways:
        if start in met:
            continue
        walk = [(start, iter(ways[start]))]
        met[start] = low[start] = len(met)
        place[start] = len(open_)
        open_.append(start)
        while walk:
            a, rest = walk[-1]
            b = next((x for x in rest if x not in met or x not in done), None)
            if b is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[a])
                if low[a] == met[a]:
                    some = open_[place[a] :]
                    del open_[place[a] :]
                    done.update(some)
                    if len(some) > 1 or a in loops:
                        part |= dict.fromkeys(some, min(some))
            elif b in met:
                low[a] = min(low[a], met[b])
            else:
                met[b] = low[b] = len(met)
                place[b] = len(open_)
                open_.append(b)
                walk.append((b, iter(ways[b])))
    return part


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = strong_parts([p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.string())], names=["node", "part"])

    ship(edges.sparkSession)
    return edges.coalesce(1).mapInArrow(run, "node string, part string")


def components(edges: DataFrame, source: str = "caller", target: str = "callee", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Strongly connected parts of two nodes or more, or of one with an edge to itself: node, part (the smallest node) (O-128).

    Up to ``one_task`` edges are walked in one task. More are worked on round by round: nodes that can't lie on a cycle,
    having no way in or out, are trimmed; colours spread forward (the smallest node that reaches a node) and are met
    backward. Each round is a few joins over the edges that are left, and meets a part at least, until few are left.
    """
    e = written(edges.select(F.col(source).cast("string").alias("a"), F.col(target).cast("string").alias("b")).where("a is not null and b is not null").distinct(), "edges")
    if e.count() <= one_task:
        return _in_one_task(e)
    loops = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("part"))
    e = e.where("a <> b")
    found, since = None, 0
    while True:
        n = -1
        while True:  # trim
            e = written(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi"), "edges")
            m = e.count()
            if m == n or not m:
                break
            n = m
        if not m:
            break
        if m <= one_task:
            rest = _in_one_task(e)
            found = rest if found is None else found.unionByName(rest)
            break
        nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
        colour = nodes.withColumn("colour", F.col("node"))
        while True:
            got = e.join(colour.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "colour").unionByName(colour)
            new = written(got.groupBy("node").agg(F.min("colour").alias("colour")), "colours")
            moved = new.join(colour.withColumnRenamed("colour", "old"), "node").where("colour <> old").limit(1).count()
            colour = new
            if not moved:
                break
        part, size = colour.where("node = colour"), -1
        while True:
            back = e.join(part.select(F.col("node").alias("b"), "colour"), "b").select(F.col("a").alias("node"), "colour").join(colour, ["node", "colour"], "left_semi")
            new = written(part.unionByName(back).distinct(), "parts")
            part, before, size = new, size, new.count()
            if size == before:
                break
        ring = part.join(part.groupBy("colour").count().where("count > 1").select("colour"), "colour", "left_semi").select("node", F.col("colour").alias("part"))
        found = ring if found is None else found.unionByName(ring)
        if (since := since + 1) % 16 == 0:  # keeps the plan short
            found = written(found, "found")
        done = part.select("node")
        e = written(e.join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti"), "edges")
    if found is None:
        return loops
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def cycle_edges(edges: DataFrame, source: str = "caller", target: str = "callee") -> DataFrame:
    """Edges that lie on a cycle: both ends in one strongly connected part; self-loops included (O-128)."""
    p = components(edges, source, target)
    e = edges.select(source, target).distinct()
    j = e.join(p.select(F.col("node").alias(source), F.col("part").alias("p1")), source).join(p.select(F.col("node").alias(target), F.col("part").alias("p2")), target)
    return j.where((F.col("p1") == F.col("p2"))).select(source, target)


def class_table(classes: DataFrame) -> DataFrame:
    """One row per class name: the smallest file and all parents (O-105). ``classes``: name, file_path, parents."""
    one = classes.groupBy("name").agg(F.min("file_path").alias("file_path"))
    parents = classes.select("name", F.explode_outer("parents").alias("parent")).where("parent is not null").distinct()
    return one.join(parents.groupBy("name").agg(F.array_sort(F.collect_list("parent")).alias("parents")), "name", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def inheritance(classes: DataFrame) -> DataFrame:
    """(child, parent) where both are classes of the table, once (O-76)."""
    e = classes.select(F.col("name").alias("child"), F.explode("parents").alias("parent")).distinct()
    return e.join(classes.select(F.col("name").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent")


def roots(classes: DataFrame) -> DataFrame:
    """Classes with children but no parent in the table (O-131)."""
    e = inheritance(classes)
    return e.select(F.col("parent").alias("name")).distinct().join(e.select(F.col("child").alias("name")), "name", "left_anti")


def tree(classes: DataFrame) -> DataFrame:
    """Classes below the roots, in the order of a pre-order walk by ``path``, each once by its first place (O-132)."""
    e = inheritance(classes)
    level = roots(classes).select("name", F.array("name").alias("path"), F.lit(0).alias("depth"))
    out = level
    while True:
        level = written(level.join(e.withColumnRenamed("parent", "name"), "name").where(~F.array_contains("path", F.col("child"))).select(F.col("child").alias("name"), F.concat("path", F.array("child")).alias("path"), (F.col("depth") + 1).alias("depth")), "tree")
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    w = Window.partitionBy("name").orderBy("path")
    return out.withColumn("at", F.row_number().over(w)).where("at = 1").drop("at")


def connected_classes(classes: DataFrame, most: int = 50) -> DataFrame:
    """Classes by the parents and children they have in the table, most first (O-117, O-197): a top list."""
    e = inheritance(classes)
    n = e.select(F.col("child").alias("name")).unionByName(e.select(F.col("parent").alias("name"))).groupBy("name").agg(F.count("*").alias("links"))
    return n.orderBy(F.desc("links"), "name").limit(most)
