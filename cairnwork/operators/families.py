"""Searches in graphs that fall apart into small families: no edge leads from one to another, so a task takes many of them whole."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Families of more edges and asked rows are followed by rounds.
LARGE = 2048
#: Edges of a task, about.
EACH = 200_000


def closed(edges: DataFrame) -> bool:
    """Whether every edge (family, other) has both its ends in one known family."""
    return edges.where("family is null or other is null or family <> other").isEmpty()


def large(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(family) of those that no task takes whole."""
    return edges.select("family").union(asked.select("family")).groupBy("family").count().where(F.col("count") > LARGE).select("family")


def search(edges: DataFrame, asked: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What run makes of the edges and asked rows of many families."""
    parts = max(math.ceil(edges.count() / EACH), 3 * edges.sparkSession.sparkContext.defaultParallelism)
    part = F.pmod(F.xxhash64("family"), F.lit(parts)).alias("part")
    return edges.select("*", part).groupBy("part").cogroup(asked.select("*", part).groupBy("part")).applyInArrow(run, schema)


def _ranked(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The values of all columns in order, null first, and of each column its values' numbers."""
    whole = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
    ranks = pc.rank(whole, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1
    first = np.unique(ranks, return_index=True)[1]
    return whole.take(pa.array(first)), np.split(ranks, np.cumsum([len(c) for c in columns])[:-1])


class Numbered:
    """The revisions of a task, numbered by family, time (null first) and falling id: the latest of several, the least id of equal times, has the highest number."""

    def __init__(self, edges: pa.Table, asked: pa.Table, *others: str):
        """asked: (family, a, ts of a, others), others being revisions that may be of any family or unknown."""
        self.ids, (source, target, a, *rest) = _ranked(edges["source"], edges["target"], asked["a"], *[asked[c] for c in others])
        times, (since, at, of_a) = _ranked(edges["since"], edges["at"], asked["ts"])
        _, (family, of_asked) = _ranked(edges["family"], asked["family"])
        of, when, ids = np.concatenate([family, family, of_asked]), np.concatenate([since, at, of_a]), np.concatenate([source, target, a])
        order = np.lexsort((-ids, when, of))
        order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(order) else order
        self.id, self.family = ids[order], of[order]
        self.timed = when[order] > 0 if len(times) and not times[0].is_valid else np.ones(len(order), bool)
        number = np.full(len(self.ids), -1)
        number[self.id] = np.arange(len(order))
        self.child, self.parent, self.a, self.others = number[source], number[target], number[a], [number[x] for x in rest]
        by_child = np.argsort(self.child, kind="stable")
        self.child, self.parent = self.child[by_child], self.parent[by_child]

    def families(self) -> Iterator[tuple[int, int, slice, np.ndarray]]:
        """The first number, the count, the edges and the asked rows of each family that something is asked of."""
        if not len(self.a):
            return
        order = np.argsort(self.a, kind="stable")
        of = self.family[self.a[order]]
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        starts, ends = (np.searchsorted(self.family, of[heads], side) for side in ("left", "right"))
        edges = zip(np.searchsorted(self.child, starts), np.searchsorted(self.child, ends))
        for first, end, (lo, hi), rows in zip(starts.tolist(), ends.tolist(), edges, np.split(order, heads[1:]), strict=True):
            yield first, end - first, slice(lo, hi), rows


def behind_bits(count: int, child: np.ndarray, parent: np.ndarray) -> list[int]:
    """Of each revision of a family the set of itself and all behind it, as the bits of an integer. Edges come by child."""
    bits, edges = [1 << i for i in range(count)], list(zip(child.tolist(), parent.tolist()))
    # Where each parent has a lower number than its child, it is complete before it is used.
    again = True
    while again:
        again = False
        for c, p in edges:
            more = bits[c] | bits[p]
            if more != bits[c]:
                bits[c], again = more, True
        again = again and bool((parent >= child).any())
    return bits


def pairs_searched(edges: pa.Table, asked: pa.Table) -> pa.Table:
    """(a, b, found, common) of asked (family, a, ts, b): whether b is a or behind it, and the latest revision with a time that is both or behind both."""
    of = Numbered(edges, asked, "b")
    found, common = np.zeros(len(asked), bool), np.full(len(asked), -1)
    for first, count, mine, rows in of.families():
        bits = behind_bits(count, of.child[mine] - first, of.parent[mine] - first)
        for i, a, b in zip(rows.tolist(), (of.a[rows] - first).tolist(), (of.others[0][rows] - first).tolist()):
            if 0 <= b < count:
                found[i] = bits[a] >> b & 1
                common[i] = first + (bits[a] & bits[b]).bit_length() - 1 if bits[a] & bits[b] else -1
    some = (common >= 0) & of.timed[common]
    at = pa.array(np.where(some, of.id[common], 0), mask=~some)
    return asked.select(["a", "b"]).append_column("found", pa.array(found)).append_column("common", of.ids.take(at))


def lines_searched(edges: pa.Table, asked: pa.Table) -> pa.Table:
    """(root, node, depth) of asked (family, a, ts): all that a reaches along edges, itself at depth 0, with the least number of steps."""
    of = Numbered(edges, asked)
    root, node, depth = [], [], []
    for first, count, mine, rows in of.families():
        onward = [[] for _ in range(count)]
        for c, p in zip((of.child[mine] - first).tolist(), of.parent[mine].tolist()):
            onward[c].append(p)
        for a in of.a[rows].tolist():
            met, front, steps = {a: 0}, [a], 0
            while front:
                steps += 1
                ahead = []
                for x in front:
                    for y in onward[x - first]:
                        if y not in met:
                            met[y] = steps
                            ahead.append(y)
                front = ahead
            root.append(np.full(len(met), a))
            node.append(np.fromiter(met.keys(), np.int64, len(met)))
            depth.append(np.fromiter(met.values(), np.int32, len(met)))
    none = [np.zeros(0, np.int64)]
    of_ids = lambda parts: of.ids.take(pa.array(of.id[np.concatenate(none + parts)]))
    return pa.table({"root": of_ids(root), "node": of_ids(node), "depth": pa.array(np.concatenate(none + depth).astype(np.int32))})
