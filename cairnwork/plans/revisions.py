"""Queries on revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import content_hash
from ..operators import revision
from .registry import query

_LINE = "WITH RECURSIVE revs AS (SELECT * FROM {revisions}), line AS (SELECT rev, parent AS ancestor, 1 AS depth FROM revs WHERE parent IS NOT NULL UNION ALL SELECT l.rev, r.parent, l.depth + 1 FROM line l JOIN revs r ON r.rev = l.ancestor WHERE r.parent IS NOT NULL)"
_HEADS = "SELECT branch, rev AS head FROM (SELECT branch, rev, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY ts DESC, rev DESC) AS n FROM revs) h WHERE n = 1"


def _heads(t):
    return t.revisions.groupBy("branch").agg(F.max(F.struct("ts", "rev"))["rev"].alias("head"))


def _times(t):
    """Of each revision its time and its family: a parent is of the same branch."""
    return t.revisions.select("rev", "ts", F.col("branch").alias("family"))


@query(f"{_LINE} SELECT rev, ancestor, CAST(depth AS INT) AS depth FROM line")
def rev_ancestors(t):
    return revision.ancestors(t.revisions).select("rev", "ancestor", F.col("depth").cast("int").alias("depth"))


@query(f"{_LINE} SELECT h.head, CAST(COUNT(l.ancestor) AS BIGINT) AS ancestors, CAST(COALESCE(MAX(l.depth), 0) AS BIGINT) AS dag_depth FROM ({_HEADS}) h LEFT JOIN line l ON l.rev = h.head GROUP BY h.head")
def rev_dag_depth(t):
    line = revision.behind(_heads(t).select(F.col("head").alias("rev")), t.revisions, _times(t)).withColumn("ancestor", F.when(F.col("depth") > 0, F.col("ancestor")))
    return line.groupBy(F.col("rev").alias("head")).agg(F.count("ancestor").alias("ancestors"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("dag_depth"))


@query(f"{_LINE} SELECT a.rev AS descendant, a.parent AS asked, EXISTS (SELECT 1 FROM line l WHERE l.rev = a.rev AND l.ancestor = a.parent) AS is_ancestor FROM revs a")
def rev_is_ancestor(t):
    line = revision.ancestors(t.revisions).select(F.col("rev").alias("descendant"), F.col("ancestor").alias("asked"), F.lit(True).alias("found"))
    asked = t.revisions.select(F.col("rev").alias("descendant"), F.col("parent").alias("asked"))
    return asked.join(line, ["descendant", "asked"], "left").select("descendant", "asked", F.coalesce("found", F.lit(False)).alias("is_ancestor"))


@query(f"{_LINE}, pairs AS (SELECT h.head AS a, r.parent AS b FROM ({_HEADS}) h JOIN revs r ON r.rev = h.head WHERE r.parent IS NOT NULL) SELECT a, b, ancestor FROM (SELECT p.a, p.b, x.ancestor, ROW_NUMBER() OVER (PARTITION BY p.a, p.b ORDER BY r.ts DESC, x.ancestor) AS n FROM pairs p JOIN (SELECT rev, ancestor FROM line UNION ALL SELECT rev, rev FROM revs) x ON x.rev = p.b JOIN revs r ON r.rev = x.ancestor) y WHERE n = 1")
def rev_common_ancestor(t):
    """Of each branch's head and its parent: the latest revision that both have behind them or are."""
    revisions = t.revisions
    pairs = _heads(t).join(revisions, F.col("head") == F.col("rev")).where("parent is not null").select(F.col("head").alias("a"), F.col("parent").alias("b"))
    return revision.latest_common(pairs, revisions, _times(t))


@query("SELECT parent AS rev, COUNT(*) AS children FROM {revisions} WHERE parent IS NOT NULL GROUP BY parent")
def rev_children(t):
    return t.revisions.where("parent is not null").groupBy(F.col("parent").alias("rev")).agg(F.count("*").alias("children"))


@query(f"WITH revs AS (SELECT * FROM {{revisions}}) {_HEADS}")
def rev_head(t):
    return _heads(t)


@query("SELECT r.rev, CASE WHEN r.parent IS NULL THEN 0 ELSE 1 END AS parents, COUNT(DISTINCT c.cell) AS cells, COUNT(DISTINCT c.tile) AS tiles FROM {revisions} r LEFT JOIN {rev_cells} c ON c.rev = r.rev GROUP BY r.rev, r.parent")
def rev_log(t):
    counted = t.rev_cells.groupBy("rev").agg(F.count_distinct("cell").alias("cells"), F.count_distinct("tile").alias("tiles"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.revisions.join(counted, "rev", "left").select("rev", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("parents"), zero("cells"), zero("tiles"))


@query("SELECT r.rev, sha256(COALESCE(CAST(r.parent AS STRING), '') || '|' || COALESCE(c.cells, '') || '|' || COALESCE(c.tiles, '')) AS id FROM {revisions} r LEFT JOIN (SELECT rev, string_agg(CAST(cell AS STRING), ',' ORDER BY line, cell) AS cells, string_agg(CAST(tile AS STRING), ',' ORDER BY line, tile) AS tiles FROM {rev_cells} GROUP BY rev) c ON c.rev = r.rev")
def rev_commit_ids(t):
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", c))), lambda s: s[c].cast("string")), ",").alias(f"{c}s")
    lists = t.rev_cells.groupBy("rev").agg(listed("cell"), listed("tile"))
    text = F.concat_ws("|", F.coalesce(F.col("parent").cast("string"), F.lit("")), F.coalesce("cells", F.lit("")), F.coalesce("tiles", F.lit("")))
    return t.revisions.join(lists, "rev", "left").select("rev", content_hash(text).alias("id"))


_EFFECTIVE = f"{_LINE}, heads AS ({_HEADS}), reach AS (SELECT l.rev AS head, l.ancestor AS rev, l.depth FROM line l JOIN heads h ON h.head = l.rev UNION ALL SELECT head, head, 0 FROM heads), state AS (SELECT head, cell, rev, amount FROM (SELECT x.head, c.cell, x.rev, c.amount, ROW_NUMBER() OVER (PARTITION BY x.head, c.cell ORDER BY x.depth, c.line, c.amount) AS n FROM reach x JOIN {{rev_cells}} c ON c.rev = x.rev) s WHERE n = 1)"


@query(f"{_EFFECTIVE} SELECT head, cell, rev, amount FROM state")
def rev_effective_graph(t):
    heads = _heads(t).select("head")
    line = revision.behind(heads.select(F.col("head").alias("rev")), t.revisions, _times(t))
    return revision.effective(heads, line.where("depth > 0"), t.rev_cells)


def _tips(t):
    """Of each branch the changes of its first revision (base) and of urgent and other later ones (a, b): last change of each cell."""
    revs = t.revisions
    base = revs.where("parent is null").select("branch", "rev")
    later = revs.where("parent is not null")
    last = lambda df: df.join(t.rev_cells, "rev").groupBy("branch", "cell").agg(F.max_by("amount", F.struct("rev", "line", "amount")).alias("amount"))
    return last(base), last(later.where("priority like '1%'")), last(later.where("priority not like '1%'"))


_SIDE = "SELECT branch, cell, amount FROM (SELECT r.branch, c.cell, c.amount, ROW_NUMBER() OVER (PARTITION BY r.branch, c.cell ORDER BY r.rev DESC, c.line DESC, c.amount DESC) AS n FROM revs r JOIN {rev_cells} c ON c.rev = r.rev WHERE <w>) s WHERE n = 1"
_SIDES = "WITH revs AS (SELECT * FROM {revisions}), base AS (" + _SIDE.replace("<w>", "r.parent IS NULL") + "), a AS (" + _SIDE.replace("<w>", "r.parent IS NOT NULL AND r.priority LIKE '1%'") + "), b AS (" + _SIDE.replace("<w>", "r.parent IS NOT NULL AND r.priority NOT LIKE '1%'") + ")"


@query(
    f"""{_SIDES}, j AS (SELECT COALESCE(base.branch, a.branch, b.branch) AS branch, COALESCE(base.cell, a.cell, b.cell) AS cell, base.amount AS x, a.amount AS p, b.amount AS q FROM base FULL JOIN a ON a.branch = base.branch AND a.cell = base.cell FULL JOIN b ON b.branch = COALESCE(base.branch, a.branch) AND b.cell = COALESCE(base.cell, a.cell)),
    o AS (SELECT *, CASE WHEN p IS NOT DISTINCT FROM x AND q IS NOT DISTINCT FROM x THEN 'Base' WHEN q IS NOT DISTINCT FROM x THEN CASE WHEN p IS NULL THEN 'Deleted' ELSE 'A' END WHEN p IS NOT DISTINCT FROM x THEN CASE WHEN q IS NULL THEN 'Deleted' ELSE 'B' END WHEN p IS NOT DISTINCT FROM q THEN CASE WHEN p IS NULL THEN 'Deleted' ELSE 'Same' END ELSE 'Conflict' END AS outcome FROM j)
    SELECT branch, cell, outcome, CASE WHEN outcome = 'Base' THEN x WHEN outcome IN ('A', 'Same') THEN p WHEN outcome = 'B' THEN q END AS merged FROM o"""
)
def rev_merge3(t):
    return revision.merge3(*_tips(t), ["branch", "cell"], "amount")


@query(f"{_SIDES} SELECT a.branch, a.cell FROM a JOIN b ON b.branch = a.branch AND b.cell = a.cell")
def rev_merge_conflicts(t):
    _, a, b = _tips(t)
    return a.join(b, ["branch", "cell"], "left_semi").select("branch", "cell")


@query(f"{_SIDES} SELECT side, COUNT(*) AS cells FROM (SELECT 'base' AS side FROM base UNION ALL SELECT 'a' FROM a WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.branch = a.branch AND x.cell = a.cell) UNION ALL SELECT 'b' FROM b WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.branch = b.branch AND x.cell = b.cell)) s GROUP BY side")
def rev_merge_tip(t):
    """Cells that a merge of the tips lists: the base's, then what each side has beyond it."""
    base, a, b = _tips(t)
    fresh = lambda df, side: df.join(base, ["branch", "cell"], "left_anti").select(F.lit(side).alias("side"))
    return base.select(F.lit("base").alias("side")).union(fresh(a, "a")).union(fresh(b, "b")).groupBy("side").agg(F.count("*").alias("cells"))


_LOST = "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT cell FROM {rev_cells} WHERE rev IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F'))"


@query(f"{_LOST}")
def gc_unreachable(t):
    """Cells that no active revision (status F) changes."""
    live = t.rev_cells.join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("rev")), "rev", "left_semi").select(F.col("cell").alias("p_partkey"))
    return t.part.join(live, "p_partkey", "left_anti").select("p_partkey")


@query("SELECT COUNT(*) AS tiles, COALESCE(CAST(SUM(p_size) AS BIGINT), 0) AS bytes FROM {part} WHERE p_partkey % 30 > 7 AND p_partkey IN (" + _LOST + ")")
def gc_grace(t):
    """Of the cells that nothing reaches those unreferenced for longer than the grace period of 7 days (days = key modulo 30)."""
    lost = gc_unreachable(t)
    return t.part.where("p_partkey % 30 > 7").join(lost, "p_partkey", "left_semi").agg(F.count("*").alias("tiles"), F.coalesce(F.sum("p_size"), F.lit(0)).alias("bytes"))
