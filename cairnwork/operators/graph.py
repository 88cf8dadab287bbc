"""Closure, levels and budgeted plans over graphs of edges (source, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Written

#: Up to so many rows a round's table is sent to every executor; larger ones are joined where they lie.
FEW = 20_000
#: Budgets of up to so many steps are worked out on lists of so many nodes, larger ones on the whole of what each root reaches.
LISTED = 64
#: Lists that are merged at once, about.
MERGED = 1000


def joinable(df: DataFrame, rows: int) -> DataFrame:
    """A table of counted rows with the way that joins take it. A file's size says little about rows that compress well."""
    return df.hint("broadcast" if rows <= FEW else "merge")


def closure(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, reached, depth): everything that a node reaches, with the least number of steps.

    Reach is doubled, so the rounds grow with the logarithm of the longest path. A shortest path of more than ``step``
    steps passes a node at just that distance, so only pairs at that distance are led on, by all that was found so far.
    """
    written = Written(edges.sparkSession, keep=2)
    paths = written(edges.where("source is not null and target is not null and source <> target").groupBy(F.col("source").alias("node"), F.col("target").alias("reached")).agg(F.lit(1).alias("depth")))
    step = 1
    while (limit is None or step < limit) and not paths.where(F.col("depth") == step).isEmpty():
        on = paths.select(F.col("node").alias("reached"), F.col("reached").alias("further"), F.col("depth").alias("more"))
        longer = paths.where(F.col("depth") == step).join(on, "reached").select("node", F.col("further").alias("reached"), (F.col("depth") + F.col("more")).alias("depth")).where("node <> reached")
        if limit is not None:
            longer = longer.where(F.col("depth") <= limit)
        paths = written(paths.union(longer).groupBy("node", "reached").agg(F.min("depth").alias("depth")))
        step *= 2
    return paths


def reach_of(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, depth) of what each asked root reaches along edges, itself at depth 0; only asked roots are followed.

    Edges are written once. Each round's new nodes are a table of their own; a node met before is not followed again, so
    cycles end too. Where roots have a column ``floor`` and edges ``at``, targets below their root's floor are left out.
    """
    floored = "floor" in roots.columns
    keys = ["root", "floor"] if floored else ["root"]
    written = Written(roots.sparkSession)
    onward = Written(roots.sparkSession)(edges.where("source is not null and target is not null").select(F.col("source").alias("node"), F.col("target").alias("next"), *["at"] * floored).distinct())
    front = written(roots.where("root is not null").select(*keys, F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    depth, met = 0, 0
    while rows := front.count():
        depth, met = depth + 1, met + rows
        step = onward.hint("merge").join(joinable(front, rows), "node")
        if floored:
            step = step.where("floor is null or at is null or at >= floor")
        step = step.select(*keys, F.col("next").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = written(step.join(joinable(written.all(front).select("root", "node"), met), ["root", "node"], "left_anti"))
    return written.all(front).select("root", "node", "depth")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node) of all that reach themselves. Any cycle has an edge that leads to no smaller node, so without such edges there is none."""
    edges = edges.where("source is not null and target is not null").select("source", "target").distinct()
    if edges.where("target >= source").isEmpty():
        return edges.select(F.col("source").alias("node")).limit(0)
    written = Written(edges.sparkSession, keep=2)
    edges = written(edges)
    before, now = None, edges.count()
    while now != before:
        # What nothing leads to, or what leads nowhere, is on no cycle.
        on = edges.join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        edges = written(on.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi"))
        before, now = now, edges.count()
    back = closure(edges).select(F.col("node").alias("target"), F.col("reached").alias("source"))
    return edges.where("source = target").union(edges.join(back, ["source", "target"]).select("source", "target")).select(F.col("source").alias("node")).distinct()


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): 0 for what needs nothing, else one more than the highest level among targets. Needs a graph without cycles.

    Each round's table has what stands above the round before; a node's level is the last round that it is in.
    """
    edges = Written(edges.sparkSession)(edges.where("source is not null and target is not null").select("source", "target").distinct())
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    most, written = nodes.count(), Written(edges.sparkSession)
    at = written(nodes.join(edges.select(F.col("source").alias("node")).hint("merge"), "node", "left_anti").withColumn("level", F.lit(0)))
    depth = 0
    while rows := at.count():
        depth += 1
        if depth > most:
            raise ValueError("the graph has a cycle")
        at = written(edges.join(joinable(at.select(F.col("node").alias("target")), rows), "target", "left_semi").select(F.col("source").alias("node"), F.lit(depth).alias("level")).distinct())
    return written.all(at).groupBy("node").agg(F.max("level").alias("level"))


def reachable(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth) of all that roots (node) reach, roots included; each round follows new nodes only."""
    written = Written(edges.sparkSession)
    edges = Written(edges.sparkSession)(edges.where("source is not null and target is not null").select("source", "target").distinct())
    front, depth, met = written(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0))), 0, 0
    while (most is None or depth < most) and (rows := front.count()):
        depth, met = depth + 1, met + rows
        step = edges.join(joinable(front.select(F.col("node").alias("source")), rows), "source", "left_semi").select(F.col("target").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = written(step.join(joinable(written.all(front).select("node"), met), "node", "left_anti"))
    return written.all(front)


def within_bytes(plan: DataFrame, order: list, size: str, cap: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each key the prefix of a plan in order that ends before the first row whose running bytes pass the cap."""
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return plan.withColumn("running", F.sum(size).over(so_far)).where(F.col("running") <= cap)


def first_needed(edges: DataFrame, nodes: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(node, needed) of every node of edges and nodes: the first ``most`` (level, node, nth, size) of what it reaches, itself included, by level and node.

    What has no size is not listed. Levels are those of levels(): a node is done in the round after the last of its
    targets, and hands its list on to its sources once, so no pair of nodes that are further apart is ever made.
    """
    keep = Written(edges.sparkSession)
    edges = keep(edges.where("source is not null and target is not null").select("source", "target").distinct())
    own = sizes.where("node is not null").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("size"))).alias("own")).hint("merge")
    none = F.array().cast(own.schema["own"].dataType)
    degrees = edges.groupBy("source").agg(F.count("*").alias("degree"))
    every = edges.select(F.col("source").alias("node")).union(edges.select("target")).union(nodes.select("node").where("node is not null")).distinct()
    every = keep(every.join(degrees.withColumnRenamed("source", "node").hint("merge"), "node", "left").join(own, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("own", none).alias("own")))
    # Edges carry what their source waits for and its sizes, so that rounds need no other table.
    onward = keep(edges.join(every.withColumnRenamed("node", "source").hint("merge"), "source").select(F.col("target").alias("node"), F.col("source").alias("next"), "degree", "own"))
    rounds, left = Written(edges.sparkSession), every.count()

    def listed(level: int, handed):
        mine = F.transform("own", lambda x, i: F.struct(F.lit(level).alias("level"), F.col("node").alias("node"), i.alias("nth"), x["size"].alias("size")))
        return F.slice(mine, 1, most) if handed is None else F.when(F.col("ready"), F.slice(F.concat(handed, mine), 1, most)).otherwise(handed)

    columns = ["node", "degree", "own", "done", "needed", "ready"]
    state = rounds(every.where("degree = 0").withColumns({"done": F.lit(0).cast("long"), "ready": F.lit(True)}).withColumn("needed", listed(0, None)).select(columns))
    level = 0
    while rows := (front := state.where("ready").select("node", "needed")).count():
        level, left = level + 1, left - rows
        handed = onward.hint("merge").join(joinable(front, rows * most), "node").select(F.col("next").alias("node"), "degree", "own", F.lit(1).cast("long").alias("done"), "needed", F.pmod(F.xxhash64("node"), F.ceil(F.col("degree") / MERGED)).alias("part"))
        state = state.where("not ready").select("node", "degree", "own", "done", "needed", F.lit(0).cast("long").alias("part")).union(handed).repartition("node")
        # Lists of a node with many targets are merged in parts first.
        for by in (["node", "part"], ["node"]):
            state = state.groupBy(*by).agg(F.first("degree").alias("degree"), F.first("own").alias("own"), F.sum("done").alias("done"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("needed")))), 1, most).alias("needed"))
        state = state.withColumn("ready", F.col("done") == F.col("degree")).withColumn("needed", listed(level, F.col("needed")))
        state = rounds(state.select(columns))
    if left:
        raise ValueError("the graph has a cycle")
    return rounds.all(state).where("ready").select("node", "needed")


def executed(roots: DataFrame, edges: DataFrame, sizes: DataFrame, max_compute: int) -> DataFrame:
    """(root, executed, bytes_moved, budget_exceeded): each root's closure in the order of levels and nodes, up to max_compute steps. Nodes without a size are not run."""
    if max_compute > LISTED:
        order = reach_of(roots, edges).select("root", "node").join(sizes.hint("merge"), "node").join(levels(edges).hint("merge"), "node", "left")
        step = F.row_number().over(W.partitionBy("root").orderBy(F.coalesce("level", F.lit(0)), "node"))
        within = F.col("step") <= max_compute
        return order.withColumn("step", step).groupBy("root").agg(F.count_if(within).alias("executed"), F.sum(F.when(within, F.col("size")).otherwise(0)).alias("bytes_moved"), (F.count("*") > max_compute).alias("budget_exceeded"))
    asked = roots.select("root").where("root is not null").distinct()
    # One more than the budget says whether it is exceeded.
    order = first_needed(edges, asked.select(F.col("root").alias("node")), sizes, max_compute + 1).withColumnRenamed("node", "root").join(asked.hint("merge"), "root").where(F.size("needed") > 0)
    ran, more = F.slice("needed", 1, max_compute), F.size("needed") > max_compute
    moved = F.aggregate(ran, F.lit(0).cast(_total(sizes)), lambda total, x: total + F.coalesce(x["size"], F.lit(0)))
    return order.select("root", F.size(ran).cast("long").alias("executed"), F.when(more | F.exists(ran, lambda x: x["size"].isNotNull()), moved).alias("bytes_moved"), more.alias("budget_exceeded"))


def _total(sizes: DataFrame) -> str:
    """The type that sums of sizes have."""
    return sizes.agg(F.sum("size").alias("total")).schema["total"].dataType.simpleString()


def prefetch_plan(targets: DataFrame, edges: DataFrame, sizes: DataFrame, cached: DataFrame, cap: int | None = None) -> DataFrame:
    """(target, node, depth, priority, size): one plan for each target; the priority is that of the edge on which a node is first met.

    kinds 0..3 are priorities; edges of kind 4 are not followed. Cached nodes are skipped, and so is what only they need.
    With a cap a plan ends before the first node, by depth, priority and node, whose running bytes (column running) pass
    it, and targets whose plan has ended are followed no further.
    """
    keep = Written(targets.sparkSession)
    cached = keep(cached.select("node").where("node is not null").distinct())
    uncached = joinable(cached.withColumnRenamed("node", "target"), cached.count())
    usable = edges.where("kind < 4").join(uncached, "target", "left_anti").groupBy("source", "target").agg(F.min("kind").alias("kind"))
    sized = sizes.groupBy("node").agg(F.max("size").cast("long").alias("size"))
    # Edges carry the size of what they lead to, so that rounds need no other table.
    onward = keep(usable.join(sized.select(F.col("node").alias("target"), "size").hint("merge"), "target", "left").select(F.col("source").alias("node"), F.col("target").alias("next"), "kind", F.coalesce("size", F.lit(0)).alias("size")))
    written = Written(targets.sparkSession)
    so_far = W.partitionBy("target").orderBy("priority", "node").rowsBetween(W.unboundedPreceding, W.currentRow)

    def round_of(new: DataFrame) -> DataFrame:
        if cap is None:
            return written(new.select("target", "node", "depth", "priority", "size", F.lit(None).cast("long").alias("running"), F.lit(False).alias("ended")))
        new = new.withColumn("running", (F.sum("size").over(so_far) + F.col("spent")).cast("long"))
        last = F.max("running").over(W.partitionBy("target")) > cap
        return written(new.withColumn("ended", last).select("target", "node", "depth", "priority", "size", "running", "ended"))

    start = targets.select("target").join(uncached, "target", "left_anti").withColumn("node", F.col("target")).join(sized.hint("merge"), "node", "left")
    front = round_of(start.select("target", "node", F.lit(0).alias("depth"), F.lit(0).alias("priority"), F.coalesce("size", F.lit(0)).alias("size"), F.lit(0).cast("long").alias("spent")))
    depth, met = 0, 0
    while rows := front.count():
        depth, met = depth + 1, met + rows
        ahead = front.where("not ended")
        if cap is not None:
            # What a target spent up to a round is the most that the round's rows say.
            ahead = ahead.withColumn("spent", F.max("running").over(W.partitionBy("target")))
        else:
            ahead = ahead.withColumn("spent", F.lit(0).cast("long"))
        step = onward.withColumnRenamed("size", "its").hint("merge").join(joinable(ahead.select("target", "node", "spent"), rows), "node")
        step = step.groupBy("target", F.col("next").alias("node")).agg(F.lit(depth).alias("depth"), F.min("kind").alias("priority"), F.first("its").alias("size"), F.first("spent").alias("spent"))
        front = round_of(step.join(joinable(written.all(front).select("target", "node"), met), ["target", "node"], "left_anti"))
    out = written.all(front)
    return out.drop("running", "ended") if cap is None else out.where(F.col("running") <= cap).drop("ended")
