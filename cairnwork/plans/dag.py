"""Queries on revisions with several parents: ancestry of asked pairs, merges, cycles, and what nothing live reaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, revision
from .registry import query

_LINE = "WITH RECURSIVE e AS (SELECT DISTINCT rev, parent FROM {dag} WHERE parent IS NOT NULL), p AS (SELECT DISTINCT a, b FROM {dag_pairs}), asked AS (SELECT a AS rev FROM p UNION SELECT b FROM p), line AS (SELECT rev AS root, rev AS node FROM asked UNION SELECT l.root, e.parent FROM line l JOIN e ON e.rev = l.node)"
_COMMON = "common AS (SELECT a, b, node AS ancestor FROM (SELECT p.a, p.b, x.node, ROW_NUMBER() OVER (PARTITION BY p.a, p.b ORDER BY o.o_orderdate DESC, x.node) AS n FROM p JOIN line x ON x.root = p.a JOIN line y ON y.root = p.b AND y.node = x.node JOIN {orders} o ON o.o_orderkey = x.node) r WHERE n = 1)"


def _pairs(t):
    return t.dag_pairs.select("a", "b").distinct()


def _times(t):
    """Of each revision its time and its family: the group of branches that its parents come from."""
    return t.orders.select(F.col("o_orderkey").alias("rev"), F.col("o_orderdate").alias("ts"), F.floor(F.col("o_custkey") / 8).alias("family"))


@query(f"{_LINE} SELECT p.a, p.b, EXISTS (SELECT 1 FROM line l WHERE l.root = p.a AND l.node = p.b) AS behind FROM p")
def dag_is_ancestor(t):
    """Of asked pairs whether b is behind a."""
    return revision.is_ancestor(_pairs(t).toDF("rev", "asked"), t.dag, _times(t)).select(F.col("rev").alias("a"), F.col("asked").alias("b"), F.col("found").alias("behind"))


@query(f"{_LINE}, {_COMMON} SELECT a, b, ancestor FROM common")
def dag_common_ancestor(t):
    return revision.latest_common(_pairs(t), t.dag, _times(t))


@query(f"{_LINE} SELECT p.a AS rev, p.b AS parent FROM p WHERE EXISTS (SELECT 1 FROM line l WHERE l.root = p.b AND l.node = p.a)")
def dag_cycle_rejection(t):
    """Of the edges that make b a parent of a those that must be refused."""
    return revision.rejected(_pairs(t).toDF("rev", "parent"), t.dag, _times(t))


def _merged(t, column, with_ancestor):
    pairs = t.dag_merges.select("a", "b").distinct()
    common = revision.latest_common(pairs, t.dag, _times(t)).withColumnRenamed("ancestor", "rev")
    side = lambda c: pairs.select("a", "b", F.col(c).alias("rev"))
    return revision.merged_counts(side("a"), side("b"), common, t.rev_cells.select("rev", column), ["a", "b"], column, with_ancestor)


_MERGES = _LINE.replace("{dag_pairs}", "{dag_merges}")


def _merged_sql(column, own):
    side = lambda table, key: f"SELECT s.a, s.b, c.{column} FROM {table} s JOIN {{rev_cells}} c ON c.rev = s.{key}"
    fresh = lambda key: f"SELECT x.a, x.b, x.{column}, '{key}' AS origin FROM ({side('p', key)}) x WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.a = x.a AND z.b = x.b AND z.{column} = x.{column})"
    parts = [fresh("a"), fresh("b")] + ([f"SELECT a, b, {column}, 'ancestor' FROM z"] if own else [])
    return f"{_MERGES}, {_COMMON}, z AS ({side('common', 'ancestor')}) SELECT a, b, origin, {column}, COUNT(*) AS n FROM ({' UNION ALL '.join(parts)}) m GROUP BY a, b, origin, {column}"


@query(_merged_sql("cell", True))
def dag_merged_cells(t):
    """Cells that a merge of a and b lists: the common ancestor's, then what each side has beyond it; repeats are kept as a number."""
    return _merged(t, "cell", True)


@query(_merged_sql("tile", False))
def dag_merged_tiles(t):
    """Tiles that a merge of a and b lists: what each side has beyond the common ancestor, whose own tiles are not listed again."""
    return _merged(t, "tile", False)


_MARK = """WITH RECURSIVE edges AS (SELECT 'r' || CAST(rev AS STRING) AS source, 'r' || CAST(parent AS STRING) AS target FROM {dag} WHERE parent IS NOT NULL
    UNION SELECT 'r' || CAST(rev AS STRING), 'c' || CAST(cell AS STRING) FROM {rev_cells} UNION SELECT 'r' || CAST(rev AS STRING), 't' || CAST(tile AS STRING) FROM {rev_cells}
    UNION SELECT 'c' || CAST(source AS STRING), 'c' || CAST(target AS STRING) FROM {deps} WHERE kind < 3),
    mark AS (SELECT 'r' || CAST(o_orderkey AS STRING) AS node FROM {orders} WHERE o_orderstatus = 'P' AND o_orderkey % 3 = 0 UNION SELECT e.target FROM mark m JOIN edges e ON e.source = m.node),
    nodes AS (SELECT source AS node FROM edges UNION SELECT target FROM edges UNION SELECT node FROM mark)"""


@query(f"{_MARK} SELECT substring(n.node, 1, 1) AS kind, COUNT(m.node) AS reached, CAST(COUNT(*) - COUNT(m.node) AS BIGINT) AS lost FROM nodes n LEFT JOIN mark m ON m.node = n.node GROUP BY 1")
def gc_mark(t):
    """What live revisions (status P, key in threes) reach over parents, changed cells and tiles, and the hard dependencies of cells."""
    parents, hard = revision.parent_edges(t.dag), t.deps.where("kind < 3").select("source", "target")
    roots = t.orders.where("o_orderstatus = 'P' and o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("node"))
    # Nothing leads back from cells to revisions or from tiles to anything, so each kind is marked from the one before it.
    live = graph.reachable(parents, roots).select("node")
    changed = t.rev_cells.join(live.withColumnRenamed("node", "rev").hint("merge"), "rev", "left_semi").select("cell", "tile")
    marked = {"r": live, "c": graph.reachable(hard, changed.select(F.col("cell").alias("node"))).select("node"), "t": changed.select(F.col("tile").alias("node")).where("node is not null").distinct()}
    ends = lambda df, *columns: [df.select(F.col(c).alias("node")) for c in columns]
    known = {"r": [*ends(parents, "source", "target"), *ends(t.rev_cells, "rev"), roots], "c": [*ends(t.rev_cells, "cell"), *ends(hard, "source", "target")], "t": ends(t.rev_cells, "tile")}
    of_kind = lambda kind, df, is_live: df.select(F.when(F.col("node").isNotNull(), kind).alias("kind"), "node", F.lit(is_live).alias("live"))
    all_of = [of_kind(kind, df, 0) for kind, parts in known.items() for df in parts] + [of_kind(kind, df, 1) for kind, df in marked.items()]
    nodes = reduce(DataFrame.union, all_of).groupBy("kind", "node").agg(F.max("live").alias("live"))
    return nodes.groupBy("kind").agg(F.sum("live").alias("reached"), (F.count("*") - F.sum("live")).alias("lost"))


_BUDGET = """WITH RECURSIVE walk AS (SELECT source AS node, target AS reached, 1 AS depth FROM {deps} UNION SELECT w.node, d.target, w.depth + 1 FROM walk w JOIN {deps} d ON d.source = w.reached),
    lv AS (SELECT node, MAX(depth) AS level FROM walk GROUP BY node), ask AS (SELECT cell_id AS root FROM {cells} WHERE cell_id % 40 = 0),
    need AS (SELECT root, root AS node FROM ask UNION SELECT a.root, w.reached FROM ask a JOIN walk w ON w.node = a.root),
    ran AS (SELECT n.root, n.node, c.size, ROW_NUMBER() OVER (PARTITION BY n.root ORDER BY COALESCE(lv.level, 0), n.node) AS step FROM need n JOIN {cells} c ON c.cell_id = n.node LEFT JOIN lv ON lv.node = n.node)"""


@query(f"{_BUDGET} SELECT root, CAST(COUNT_IF(step <= 12) AS BIGINT) AS executed, CAST(SUM(CASE WHEN step <= 12 THEN size ELSE 0 END) AS BIGINT) AS bytes_moved, COUNT(*) > 12 AS budget_exceeded FROM ran GROUP BY root")
def exec_budget(t):
    """Each asked cell with all that it needs, what is needed first, up to a budget of 12 steps."""
    cells = t.cells.select(F.col("cell_id").alias("node"), "size")
    return graph.executed(t.cells.where("cell_id % 40 = 0").select(F.col("cell_id").alias("root")), t.deps, cells, 12)
