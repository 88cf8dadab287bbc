"""Small worked cases of scalars, graphs and merges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairnwork.functions import scalars
from cairnwork.operators import graph, memory, revision


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_cosine_needs_two_vectors_of_one_length(spark):
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    row = one(spark, same=scalars.cosine(vec(1, 0, 0), vec(1, 0, 0)), other=scalars.cosine(vec(1, 0), vec(0, 1)), short=scalars.cosine(vec(1), vec(1, 0)), zero=scalars.cosine(vec(0, 0), vec(1, 0)))
    assert (row.same, row.other, row.short, row.zero) == (1.0, 0.0, 0.0, 0.0)


def test_parse_vector(spark):
    row = one(spark, good=scalars.parse_vector(F.lit("1, 2.5,3")), bad=scalars.parse_vector(F.lit("1,x")))
    assert row.good == [1.0, 2.5, 3.0] and row.bad is None


def test_decay_can_fall_two_steps(spark):
    frame = spark.createDataFrame([(1, 0.5, 0.0, "Active"), (2, 0.5, 5000.0, "Active"), (3, 0.09, 0.0, "Active")], "id int, importance double, age_hours double, lifecycle string")
    assert [r.lifecycle for r in memory.decay(frame, 0.01).orderBy("id").collect()] == ["Active", "Forgotten", "Archived"]


def test_working_set_evicts_the_oldest(spark):
    log = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3"), (4, "h4"), (5, "h2")], "seq int, item string").withColumn("k", F.lit(1))
    assert {r.item for r in memory.working_set(log, 3, ["k"], "item", "seq").collect()} == {"h2", "h3", "h4"}


def test_closure_and_levels_of_a_diamond(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "source string, target string")
    paths = {(r.node, r.reached): r.depth for r in graph.closure(edges).collect()}
    assert paths[("a", "d")] == 2 and paths[("a", "e")] == 3 and len(paths) == 9
    assert {r.node: r.level for r in graph.levels(edges).collect()} == {"a": 3, "b": 2, "c": 2, "d": 1, "e": 0}


def test_closure_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source int, target int")
    assert graph.closure(edges).count() == 6


def test_reachable_marks_roots(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "source int, target int")
    assert {(r.node, r.depth) for r in graph.reachable(edges, spark.createDataFrame([(1,)], "node int")).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_prefetch_skips_cached_and_semantic_edges(spark):
    edges = spark.createDataFrame([(1, 2, 0), (2, 3, 1), (1, 4, 4), (3, 5, 2)], "source int, target int, kind int")
    sizes = spark.createDataFrame([(n, 10) for n in range(1, 6)], "node int, size int")
    plan = graph.prefetch_plan(spark.createDataFrame([(1,)], "target int"), edges, sizes, spark.createDataFrame([(3,)], "node int"))
    assert {(r.node, r.priority) for r in plan.collect()} == {(1, 0), (2, 0)}


@pytest.mark.parametrize(("x", "a", "b", "outcome", "merged"), [(1, 1, 1, "Base", 1), (1, 2, 1, "A", 2), (1, 1, 2, "B", 2), (1, 2, 2, "Same", 2), (1, 2, 3, "Conflict", None), (None, 2, None, "A", 2), (None, None, 2, "B", 2), (None, 2, 2, "Same", 2), (None, 2, 3, "Conflict", None), (1, None, 1, "Deleted", None), (1, 1, None, "Deleted", None), (1, None, 2, "Conflict", None), (1, None, None, "Deleted", None)])
def test_three_way_merge(spark, x, a, b, outcome, merged):
    side = lambda v: spark.createDataFrame([("k", v)] if v is not None else [], "k string, v int")
    row = revision.merge3(side(x), side(a), side(b), ["k"], "v").first()
    assert (row.outcome, row.merged) == (outcome, merged)


def test_names(spark):
    row = one(spark, embed=scalars.inferred_type(F.lit("model.embed_tokens.weight")), router=scalars.canonical_name(F.lit("blk.3.ffn_gate_inp.weight")), expert=scalars.canonical_name(F.lit("model.layers.2.block_sparse_moe.experts.7.w2.weight")), unknown=scalars.canonical_name(F.lit("nobody")), bad=scalars.unsafe_name(F.lit("../x")))
    assert (row.embed, row.router, row.expert, row.unknown, row.bad) == ("EMBEDDING", "model.layer.3.moe.router", "model.layer.2.moe.expert.7.down", None, True)
