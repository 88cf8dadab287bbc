"""What keeps loops and tasks from growing faster than their input, and their results on odd graphs."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnwork import shared
from cairnwork.functions import codecs
from cairnwork.operators import families, graph, revision, telemetry


@pytest.fixture
def plans(monkeypatch):
    """The plan of each table that a loop writes, as it was before it ran."""
    seen, write = [], shared.Written.__call__

    def call(self, df, name=None):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(shared.Written, "__call__", call)
    return seen


def reach(edges):
    """(node, reached): least steps, by plain breadth-first search."""
    out = {}
    for root in {a for a, _ in edges}:
        front, depth, met = {root}, 0, {root}
        while front:
            depth += 1
            front = {b for a, b in edges if a in front} - met
            met |= front
            out |= {(root, b): depth for b in front}
    return out


def test_closure_leads_on_only_the_farthest_pairs(spark, plans):
    chain = [(i, i + 1) for i in range(5)]
    assert {(r.node, r.reached): r.depth for r in graph.closure(spark.createDataFrame(chain, "source long, target long")).collect()} == reach(chain)
    # One step, then 2, 4 and 8; no round more to see that nothing changed.
    assert len(plans) == 4


def test_closure_on_a_graph_with_cycles(spark):
    draw = random.Random(3)
    edges = {(draw.randrange(40), draw.randrange(40)) for _ in range(70)}
    edges = {(a, b) for a, b in edges if a != b}
    frame = spark.createDataFrame(sorted(edges), "source long, target long")
    assert {(r.node, r.reached): r.depth for r in graph.closure(frame).collect()} == reach(edges)
    assert {(r.node, r.reached): r.depth for r in graph.closure(frame, 3).collect()} == {k: d for k, d in reach(edges).items() if d <= 3}
    roots = spark.createDataFrame([(1,), (7,)], "root long")
    assert {(r.root, r.node): r.depth for r in graph.reach_of(roots, frame).collect() if r.depth} == {k: d for k, d in reach(edges).items() if k[0] in (1, 7)}


def test_rounds_send_only_few_rows_to_every_executor(spark, plans, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0, raising=False)
    deps = spark.createDataFrame([(i, i // 2, i % 4) for i in range(2, 40)], "source long, target long, kind int")
    sizes, cached = spark.createDataFrame([(i, i) for i in range(40)], "node long, size long"), spark.createDataFrame([(9,)], "node long")
    graph.prefetch_plan(sizes.select(sizes.node.alias("target")), deps, sizes, cached, 60).collect()
    ran = graph.executed(sizes.where("node > 30").select(sizes.node.alias("root")), deps, sizes, 3)
    assert not [p for p in plans if "BroadcastHashJoin" in p] and "BroadcastHashJoin" not in ran._jdf.queryExecution().executedPlan().toString()


def test_edges_are_worked_out_once(spark, plans):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 6)], "source long, target long").selectExpr("source", "target + 0 as target")
    assert graph.reachable(edges, spark.createDataFrame([(5,)], "node long")).count() == 6
    assert graph.reach_of(spark.createDataFrame([(5,)], "root long"), edges).count() == 6
    assert sum("Scan ExistingRDD" in p and "target" in p for p in plans) == 2


def revisions(falling):
    """A random graph of 60 revisions whose parents are earlier, or any."""
    draw = random.Random(5)
    edges = {(i, draw.randrange(i) if falling else draw.randrange(60)) for i in range(1, 60) for _ in range(1 + i % 3 // 2)}
    return {(a, b) for a, b in edges if a != b}, {i: i // 3 for i in range(60)}, [(draw.randrange(60), draw.randrange(60)) for _ in range(40)]


@pytest.mark.parametrize("falling", [True, False])
def test_ancestry_with_times_equals_plain_search(spark, falling):
    edges, times, pairs = revisions(falling)
    behind = set(reach(edges)) | {(i, i) for i in range(60)}
    parents = spark.createDataFrame(sorted(edges) + [(0, None)], "rev long, parent long")
    at, asked = spark.createDataFrame(list(times.items()), "rev long, ts long"), spark.createDataFrame(pairs, "a long, b long").distinct()
    assert revision.timed(parents, at)[1] == falling
    found = revision.is_ancestor(asked.toDF("rev", "asked"), parents, at).collect()
    assert {(r.rev, r.asked): r.found for r in found} == {p: p in behind for p in set(pairs)}
    common = {(a, b): [x for x in range(60) if (a, x) in behind and (b, x) in behind] for a, b in pairs}
    best = {p: min((-times[x], x) for x in shared)[1] for p, shared in common.items() if shared}
    assert {(r.a, r.b): r.ancestor for r in revision.latest_common(asked, parents, at).collect()} == best


def test_old_revisions_are_not_followed(spark, plans):
    # Revision 50 is asked whether 48 is behind it: two steps, not fifty.
    parents, times = spark.createDataFrame([(i, i - 1) for i in range(1, 51)], "rev long, parent long"), spark.createDataFrame([(i, i) for i in range(51)], "rev long, ts long")
    assert revision.is_ancestor(spark.createDataFrame([(50, 48)], "rev long, asked long"), parents, times).first().found
    assert [r.ancestor for r in revision.latest_common(spark.createDataFrame([(50, 48)], "a long, b long"), parents, times).collect()] == [48]
    assert len(plans) < 20


def test_merged_counts_are_merged_lists_counted(spark):
    items = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 6), (2, 7), (3, 6), (3, None), (1, None)], "rev long, cell long")
    side = lambda r: spark.createDataFrame([(1, 2, r)], "a long, b long, rev long")
    of = lambda r: side(r).join(items, "rev").select("a", "b", "cell")
    for own in (True, False):
        lists = revision.merged_lists(of(1), of(2), of(3), ["a", "b", "cell"], own).groupBy("a", "b", "origin", "cell").count()
        counts = revision.merged_counts(side(1), side(2), side(3), items, ["a", "b"], "cell", own)
        assert {tuple(r) for r in counts.select("a", "b", "origin", "cell", "n").collect()} == {tuple(r) for r in lists.collect()}


def test_percentiles_group_only_values_of_wanted_ranges(spark):
    values = [(g, float(draw % 997) + g) for g in (1, 2) for draw in range(0, 40_000, 7)] + [(3, 4.0), (3, None), (4, None)]
    found = telemetry.percentiles(spark.createDataFrame(values, "g int, x double"), "g", "x", (0.25, 0.99))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for line in (x for x in plan.splitlines() if "Aggregate [g#" in x and "x#" in x.split("]")[0]):
        assert "range#" in line.split("]")[0]
    for g in (1, 2, 3):
        xs = sorted(x for h, x in values if h == g and x is not None)
        for share in (0.25, 0.99):
            at = share * (len(xs) - 1)
            low = int(at)
            want = xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (at - low)
            assert abs(found.where(f"g = {g} and share = {share}").first().value - want) < 1e-9
    assert found.where("g = 4").count() == 0


def test_recoded_payloads_are_handed_on_in_parts():
    caught = SimpleNamespace(schema=None, mapInArrow=lambda run, schema: run)
    run = codecs.decompressed(caught, "payload")
    import zstandard

    payloads = [zstandard.compress(bytes([i % 7]) * 100_000) if i % 9 else None for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"own": pa.array(range(200)), "payload": pa.array(payloads, pa.binary())})
    parts = list(run(iter([batch])))
    assert max(p.column("payload").nbytes for p in parts) < 1 << 22 and len(parts) > 5
    assert [x for p in parts for x in p.column("own").to_pylist()] == list(range(200))
    assert [x for p in parts for x in p.column("payload").to_pylist()] == [bytes([i % 7]) * 100_000 if i % 9 else None for i in range(200)]


def test_families_searched_whole_equal_rounds(spark, plans, monkeypatch):
    draw = random.Random(11)
    # Families of 12 revisions, in some of them cycles; the third is large. Revision 1000 is of no family, 1001 has no time at all.
    edges = sorted({(i, draw.randrange(i // 12 * 12, i if i < 36 else i // 12 * 12 + 12)) for i in range(84) if i % 12 for _ in range(1 + i % 2)})
    parents = spark.createDataFrame(edges + [(0, None), (1, 0)], "rev long, parent long")
    times = spark.createDataFrame([(i, i // 4 if i % 20 else None, i // 12) for i in range(84)] + [(1000, 7, None)], "rev long, ts long, family long")
    pairs = [(i, draw.randrange(i // 12 * 12, i // 12 * 12 + 12)) for i in range(84)] + [(7, 50), (1000, 1000), (1001, 1001), (1000, 5), (5, None)]
    pairs = spark.createDataFrame(pairs + [(i, j) for i in range(24, 36) for j in range(24, 36)], "a long, b long").distinct()
    monkeypatch.setattr(families, "LARGE", 100)
    monkeypatch.setattr(families, "EACH", 40)
    asked, plain, rows = pairs.toDF("rev", "asked"), times.drop("family"), lambda df: sorted(map(tuple, df.collect()), key=str)
    for f in (lambda at: revision.is_ancestor(asked, parents, at), lambda at: revision.latest_common(pairs, parents, at)):
        assert rows(f(times)) == rows(f(plain))
    heads = spark.createDataFrame([(11,), (83,), (30,), (1001,), (None,)], "rev long")
    assert rows(revision.behind(heads, parents, times)) == rows(revision.behind(heads, parents))
    # A parent of another family: rounds.
    mixed = times.withColumn("family", F.when(F.col("rev") == 44, 8).otherwise(F.col("family")))
    assert rows(revision.behind(heads, parents, mixed)) == rows(revision.behind(heads, parents))


def test_small_families_need_no_rounds(spark, plans):
    parents, times = spark.createDataFrame([(i, i - 1) for i in range(50) if i % 25], "rev long, parent long"), spark.createDataFrame([(i, i, i // 25) for i in range(50)], "rev long, ts long, family int")
    pairs = spark.createDataFrame([(24, 1), (49, 26), (49, 3)], "a long, b long")
    assert sorted((r.rev, r.found) for r in revision.is_ancestor(pairs.toDF("rev", "asked"), parents, times).collect()) == [(24, True), (49, False), (49, True)]
    assert sorted(r.ancestor for r in revision.latest_common(pairs, parents, times).collect()) == [1, 26]
    assert revision.behind(pairs.select(pairs.a.alias("rev")), parents, times).count() == 50
    assert len(plans) <= 12


def test_budgets_on_lists_equal_whole_closures(spark, plans, monkeypatch):
    draw = random.Random(17)
    # Node 59 has 40 targets, 7 and 13 have no size, 8 has a null one, 9 has two; 100 is in no edge, 101 is nowhere else.
    edges = sorted({(i, draw.randrange(i)) for i in range(1, 60) for _ in range(1 + i % 3)} | {(59, j) for j in range(40)})
    deps = spark.createDataFrame(edges + [(None, 1), (2, None)], "source long, target long")
    sizes = spark.createDataFrame([(i, 10 * i if i != 8 else None) for i in range(60) if i not in (7, 13)] + [(9, 5), (100, 3)], "node long, size long")
    roots, rows = spark.createDataFrame([(i,) for i in range(60)] + [(100,), (101,), (59,), (None,)], "root long"), lambda df: sorted(map(tuple, df.collect()), key=str)
    monkeypatch.setattr(graph, "MERGED", 7)
    rounds = graph.levels(deps).agg({"level": "max"}).first()[0] + 1
    plans.clear()
    found = rows(graph.executed(roots, deps, sizes, 4))
    # One loop for levels and lists: three tables ahead of it, and one round for each level and one to see the end.
    assert len(plans) <= rounds + 4
    monkeypatch.setattr(graph, "LISTED", 0)
    assert found == rows(graph.executed(roots, deps, sizes, 4))
    monkeypatch.undo()
    with pytest.raises(ValueError, match="cycle"):
        graph.executed(roots, deps.union(spark.createDataFrame([(3, 50), (50, 3)], "source long, target long")), sizes, 4)
