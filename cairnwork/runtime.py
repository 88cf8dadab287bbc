"""Queries on cells with what they need: who is asked, in which order, within which budget.

A resolver gives three tables, whatever they come from; a Builder puts a runtime together.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph
from .operators.store import FULL_CELL, Policy


class Resolver(Protocol):
    """What a runtime asks of the place where cells are."""

    def cells(self) -> DataFrame:
        """(node, size)"""

    def dependencies(self) -> DataFrame:
        """(source, target, kind)"""

    def tiles(self) -> DataFrame:
        """(node, ...): tiles of cells"""


@dataclass(frozen=True)
class Budget:
    max_compute: int = 1 << 30
    max_bytes: int = 1 << 62


@dataclass
class Runtime:
    resolver: Resolver
    budget: Budget = field(default_factory=Budget)
    policy: Policy = FULL_CELL

    def execute(self, targets: DataFrame) -> DataFrame:
        """(root, executed, bytes_moved, budget_exceeded) of each target (root), what it needs first."""
        edges = self.resolver.dependencies().where("kind < 3").select("source", "target")
        return graph.executed(targets, edges, self.resolver.cells(), self.budget.max_compute)

    def prefetch(self, targets: DataFrame, cached: DataFrame) -> DataFrame:
        """(target, node, depth, priority, size, running) of each target (target), within the bytes of the budget."""
        return graph.prefetch_plan(targets, self.resolver.dependencies(), self.resolver.cells(), cached, self.budget.max_bytes)

    def tiles_of(self, nodes: DataFrame) -> DataFrame:
        """Tiles of the nodes that the policy lets through."""
        return self.policy(self.resolver.tiles().join(nodes.select("node"), "node", "left_semi"))

    def health(self) -> dict[str, int]:
        """Cells, edges whose ends are not both there, and nodes on cycles."""
        cells, edges = self.resolver.cells(), self.resolver.dependencies().select("source", "target")
        known = cells.select("node")
        dangling = edges.join(known.withColumnRenamed("node", "source"), "source", "left_anti").union(edges.join(known.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"))
        return {"cells": cells.count(), "dangling": dangling.distinct().count(), "on_cycles": graph.on_cycles(edges).count()}


class Builder:
    """Runtime parts by name; what is not given has its default."""

    def __init__(self, resolver: Resolver):
        self.parts: dict = {"resolver": resolver}

    def budget(self, **limits: int) -> Builder:
        self.parts["budget"] = Budget(**limits)
        return self

    def policy(self, policy: Policy) -> Builder:
        self.parts["policy"] = policy
        return self

    def build(self) -> Runtime:
        return Runtime(**self.parts)


@dataclass(frozen=True)
class TableResolver:
    """A resolver on three tables."""

    cell_table: DataFrame
    dependency_table: DataFrame
    tile_table: DataFrame

    def cells(self) -> DataFrame:
        return self.cell_table.select("node", F.col("size").cast("long").alias("size"))

    def dependencies(self) -> DataFrame:
        return self.dependency_table.select("source", "target", "kind")

    def tiles(self) -> DataFrame:
        return self.tile_table
