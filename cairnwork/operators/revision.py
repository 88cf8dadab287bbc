"""Revisions that form a graph of parents: ancestry, effective state, merges, collection of what no revision reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Written
from . import families
from .graph import closure, joinable, reach_of


def ancestors(revisions: DataFrame) -> DataFrame:
    """(rev, ancestor, depth), a revision not among its own ancestors."""
    edges = revisions.where("parent is not null").select(F.col("rev").alias("source"), F.col("parent").alias("target"))
    return closure(edges).select(F.col("node").alias("rev"), F.col("reached").alias("ancestor"), "depth")


def parent_edges(revisions: DataFrame) -> DataFrame:
    return revisions.where("parent is not null").select(F.col("rev").alias("source"), F.col("parent").alias("target"))


def behind(asked: DataFrame, parents: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """(rev, ancestor, depth) of the asked revisions (rev) only, each its own ancestor at depth 0. A revision may have several parents.

    With times (rev, ts, family), if no parent is of another family than its child, families are searched whole, many to
    a task; what is of a large family or of none goes by rounds.
    """
    line = lambda roots, edges: reach_of(roots.select(F.col("rev").alias("root")), edges).select(F.col("root").alias("rev"), F.col("node").alias("ancestor"), "depth")
    if times is None:
        return line(asked, parent_edges(parents))
    edges = timed_edges(parents, times)
    if not families.closed(edges):
        return line(asked, edges)
    found, rest = _by_family(asked.select("rev").distinct(), edges, times, families.lines_searched, "root {0}, node {0}, depth int")
    found = found.toDF("rev", "ancestor", "depth")
    return found if rest is None else found.union(line(rest, edges))


def _at(times: DataFrame) -> DataFrame:
    return times.groupBy("rev").agg(F.max("ts").alias("ts"), *[F.max("family").alias("family")] * ("family" in times.columns)).hint("merge")


def timed_edges(parents: DataFrame, times: DataFrame) -> DataFrame:
    """Parent edges (source, target, at, since), written; where times have families, that of each end too (family, other)."""
    at, of_family = _at(times), "family" in times.columns
    of = lambda end, ts, family: at.select(F.col("rev").alias(end), F.col("ts").alias(ts), *[F.col("family").alias(family)] * of_family)
    edges = parent_edges(parents).distinct().join(of("target", "at", "other"), "target", "left").join(of("source", "since", "family"), "source", "left")
    return Written(parents.sparkSession)(edges.select("source", "target", "at", "since", *["family", "other"] * of_family))


def falls(edges: DataFrame) -> bool:
    """Whether every edge has both times and none leads to a later one."""
    return edges.where("at is null or since is null or at > since").isEmpty()


def timed(parents: DataFrame, times: DataFrame) -> tuple[DataFrame, bool]:
    """Parent edges (source, target, at) with the target's time, written; and whether every edge has both times and none leads to a later one."""
    edges = timed_edges(parents, times)
    return edges.select("source", "target", "at"), falls(edges)


def _by_family(asked: DataFrame, edges: DataFrame, times: DataFrame, run, schema: str) -> tuple[DataFrame, DataFrame | None]:
    """What run finds for asked rows, whose first column is a revision, in families that a task takes whole; and the other asked rows, None without any."""
    write, names = Written(asked.sparkSession), asked.columns
    kind = edges.schema["source"].dataType
    rows = asked.select(*[F.col(c).cast(kind) for c in names]).join(_at(times).withColumnRenamed("rev", names[0]), names[0], "left")
    rows = write(rows.select(F.col(names[0]).alias("a"), *[F.col(c).alias("b") for c in names[1:]], "family", "ts"))
    large = write(families.large(edges, rows))
    some = not large.isEmpty()
    inside = lambda df: df.where("family is not null").join(large.hint("merge"), "family", "left_anti") if some else df.where("family is not null")
    found = families.search(inside(edges.select("family", "source", F.col("target").cast(kind), "since", "at")), inside(rows), run, schema.format(kind.simpleString()))
    rest = rows.where("family is null and a is not null")
    if some:
        rest = rest.union(rows.join(large.hint("merge"), "family", "left_semi").select(rows.columns))
    rest = write(rest.drop("family", "ts").toDF(*names))
    return found, None if rest.isEmpty() else rest


def _followed(pairs: DataFrame, edges: DataFrame, times: DataFrame) -> DataFrame:
    """(rev, asked) among which are those of pairs whose asked is rev or behind it. If no parent is later than its child, nothing older than what is asked is followed."""
    roots = pairs.select(F.col("rev").alias("root")).distinct()
    if falls(edges):
        oldest = times.groupBy(F.col("rev").alias("asked")).agg(F.max("ts").alias("ts")).hint("merge")
        # An asked revision without a time keeps all that is behind rev.
        floors = pairs.select("rev", "asked").join(oldest, "asked", "left").groupBy("rev").agg(F.min("ts").alias("floor"), F.count_if(F.col("ts").isNull()).alias("open"))
        roots = floors.select(F.col("rev").alias("root"), F.when(F.col("open") == 0, F.col("floor")).alias("floor"))
    return reach_of(roots, edges).select(F.col("root").alias("rev"), F.col("node").alias("asked"))


def is_ancestor(pairs: DataFrame, parents: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """pairs (rev, asked) with ``found``: whether asked is rev or behind it.

    With times (rev, ts), and if no parent is later than its child, nothing older than what is asked is followed. Where
    times also have a family for each rev, families are searched as behind() does.
    """
    if times is None:
        lineage = reach_of(pairs.select(F.col("rev").alias("root")).distinct(), parent_edges(parents)).select(F.col("root").alias("rev"), F.col("node").alias("asked"))
    else:
        edges = timed_edges(parents, times)
        if "family" in times.columns and families.closed(edges):
            lineage, rest = _by_family(pairs.select("rev", "asked").distinct(), edges, times, families.pairs_searched, "a {0}, b {0}, found boolean, common {0}")
            lineage = lineage.where("found").select(F.col("a").alias("rev"), F.col("b").alias("asked"))
            if rest is not None:
                lineage = lineage.union(_followed(rest, edges, times))
        else:
            lineage = _followed(pairs, edges, times)
    return pairs.join(lineage.withColumn("found", F.lit(True)).hint("merge"), ["rev", "asked"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def latest_common(pairs: DataFrame, parents: DataFrame, times: DataFrame) -> DataFrame:
    """(a, b, ancestor): the latest revision (rev, ts in times) that is behind both or is one of them, the least id of equal times; no row without one.

    Where times also have a family for each rev, families are searched as behind() does.
    """
    edges, asked = timed_edges(parents, times), pairs.select("a", "b").where("a is not null and b is not null").distinct()
    if "family" not in times.columns or not families.closed(edges):
        return _common_by_rounds(asked, edges, times)
    found, rest = _by_family(asked, edges, times, families.pairs_searched, "a {0}, b {0}, found boolean, common {0}")
    found = found.where("common is not null").select("a", "b", F.col("common").alias("ancestor"))
    return found if rest is None else found.union(_common_by_rounds(rest, edges, times))


def _common_by_rounds(both: DataFrame, edges: DataFrame, times: DataFrame) -> DataFrame:
    """latest_common() of different pairs along timed edges.

    Both sides of a pair are followed a step a round. If no parent is later than its child, nothing older than a common
    revision that is known is followed, and a pair without anything to follow is written and left.
    """
    falling = falls(edges)
    edges = edges.select(F.col("source").alias("node"), F.col("target").alias("next"), "at")
    at = times.groupBy(F.col("rev").alias("node")).agg(F.max("ts").alias("ts")).hint("merge")
    rounds, done = Written(both.sparkSession, keep=2), Written(both.sparkSession)
    sides = both.select("a", "b", F.col("a").alias("node"), F.lit(1).alias("sides")).union(both.select("a", "b", F.col("b"), F.lit(2)))
    # sides: 1 behind a, 2 behind b, 3 both; old: what was known a round before.
    state = sides.join(at, "node", "left").select("a", "b", "node", "ts", "sides", F.lit(0).alias("old"))
    of_pair = W.partitionBy("a", "b")
    while True:
        state = state.repartition("a", "b").groupBy("a", "b", "node").agg(F.max("ts").alias("ts"), F.bit_or("sides").alias("sides"), F.bit_or("old").alias("old"))
        state = state.withColumn("best", F.max(F.when(F.col("sides") == 3, F.col("ts"))).over(of_pair))
        follows = F.col("sides") != F.col("old")
        if falling:
            follows = follows & (F.col("best").isNull() | F.coalesce(F.col("ts") >= F.col("best"), F.lit(False)))
        state = state.withColumn("follows", follows)
        state = rounds(state.withColumn("open", F.max("follows").over(of_pair)))
        best = state.where("not open and sides = 3 and ts = best").groupBy("a", "b").agg(F.min("node").alias("ancestor"))
        found = done(best)
        front = state.where("follows").select("a", "b", "node", (F.col("sides") - F.col("old")).alias("fresh"), "best")
        rows = front.count()
        if rows == 0:
            return done.all(found)
        step = edges.hint("merge").join(joinable(front, rows), "node")
        if falling:
            step = step.where("best is null or at >= best")
        known = state.where("open").select("a", "b", "node", "ts", "sides", F.col("sides").alias("old"))
        state = known.union(step.select("a", "b", F.col("next").alias("node"), F.col("at").alias("ts"), F.col("fresh").alias("sides"), F.lit(0).alias("old")))


def rejected(added: DataFrame, parents: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Of edges to add (rev, parent) those that would close a cycle: the parent is the revision itself or has it behind it."""
    asked = added.select(F.col("parent").alias("rev"), F.col("rev").alias("asked")).where("rev is not null").distinct()
    return is_ancestor(asked, parents, times).where("found").select(F.col("asked").alias("rev"), F.col("rev").alias("parent"))


def merged_lists(a: DataFrame, b: DataFrame, ancestor: DataFrame, keys: list[str], with_ancestor: bool) -> DataFrame:
    """What a merge lists: what each side has beyond the ancestor, one after the other, after the ancestor's own where asked."""
    fresh = [side.join(ancestor, keys, "left_anti").select(*keys, F.lit(name).alias("origin")) for name, side in (("a", a), ("b", b))]
    out = fresh[0].union(fresh[1])
    return ancestor.select(*keys, F.lit("ancestor").alias("origin")).union(out) if with_ancestor else out


def merged_counts(a: DataFrame, b: DataFrame, ancestor: DataFrame, items: DataFrame, keys: list[str], column: str, with_ancestor: bool) -> DataFrame:
    """(keys, origin, column, n): merged_lists() of each pair with repeats as a number.

    a, b and ancestor are (keys, rev), items (rev, column); items are joined once, and one grouping tells what is fresh.
    """
    of = lambda df, name: df.select(*keys, "rev", F.lit(name).alias("side"))
    asked = of(a, "a").union(of(b, "b")).union(of(ancestor, "ancestor")).where("rev is not null")
    n = lambda name: F.count_if(F.col("side") == name).alias(f"of_{name}")
    # An item without a value equals none, so it is fresh on each side.
    counted = items.hint("merge").join(asked, "rev").groupBy(*keys, column).agg(n("a"), n("b"), n("ancestor"))
    fresh = (F.col("of_ancestor") == 0) | F.col(column).isNull()
    rows = [F.when(fresh, F.col(f"of_{name}")).otherwise(0) for name in ("a", "b")] + [F.col("of_ancestor") if with_ancestor else F.lit(0).cast("long")]
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("origin"), c.alias("n")) for name, c in zip(("a", "b", "ancestor"), rows)])).alias("x")
    return counted.select(*keys, column, listed).where("x.n > 0").select(*keys, "x.origin", column, "x.n")


def effective(heads: DataFrame, lineage: DataFrame, changes: DataFrame) -> DataFrame:
    """(head, cell, rev, amount): the state of each cell at a head is its change nearest to it."""
    reach = lineage.join(heads, F.col("rev") == F.col("head")).select("head", F.col("ancestor").alias("rev"), "depth").union(heads.select("head", F.col("head").alias("rev"), F.lit(0)))
    seen = changes.join(reach, "rev")
    nearest = F.min_by(F.struct("rev", "amount"), F.struct("depth", "line", "amount"))
    return seen.groupBy("head", "cell").agg(nearest.alias("last")).select("head", "cell", "last.rev", "last.amount")


def merge3(base: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Three-way merge by key: (keys, outcome, merged), null-safe; outcome is Base, A, B, Same, Deleted or Conflict."""
    side = lambda df, name: df.select(*keys, F.col(value).alias(name))
    joined = side(base, "base").join(side(a, "a"), keys, "full_outer").join(side(b, "b"), keys, "full_outer")
    x, p, q = F.col("base"), F.col("a"), F.col("b")
    outcome = (
        F.when(p.eqNullSafe(x) & q.eqNullSafe(x), "Base")
        .when(q.eqNullSafe(x), F.when(p.isNull(), "Deleted").otherwise("A"))
        .when(p.eqNullSafe(x), F.when(q.isNull(), "Deleted").otherwise("B"))
        .when(p.eqNullSafe(q), F.when(p.isNull(), "Deleted").otherwise("Same"))
        .otherwise("Conflict")
    )
    merged = F.when(outcome.isin("Base"), x).when(outcome.isin("A", "Same"), p).when(outcome == "B", q)
    return joined.select(*keys, outcome.alias("outcome"), merged.alias("merged"))
