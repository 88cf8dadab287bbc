"""Near-copy detection in a media column by local image descriptors.

Corners of an image at three levels (as it is, softened by squares of two, half as large) get a 128-bit descriptor:
brightness tests of point pairs in a patch, turned to the patch's own orientation. Descriptors with a near one
at another place of their image are left out, for in a repeating pattern none says where it is. A corner and each of its NEIGHBOURS
nearest corners of the same level are one key in each of SUBSTRINGS Hamming tables: the substrings of both descriptors. Images with an equal
key are tied to the least of them, never pair by pair, and all that are tied to one image are a candidate piece with it:
two images with an equal key are both of the piece of its least image. Pieces overlap but are not joined, so chains of
chance ties make no large ones; two images that meet in several pieces are compared in the least. There every
two images with an equal key are compared on all descriptors, a large piece in tiles that meet in separate tasks: pairs
of near descriptors vote for a turn, a scale and a shift, and enough votes for one of them (the geometric consensus) make
the images copies of one another, cropped or edited as they may be. Nothing else decides a link. Images without an equal
key do not meet, near as their descriptors may be; the README has the recall for each kind of edit.

Images are binary grey or colour maps (P5, P6; colours become grey). Rows: one for each input row. n_links counts the
other rows that are copies by bytes or consensus. Null, empty and broken images, and images without corners, are linked
to nothing and are classes of their own; equal bytes are copies in any case. Repeated rows count as copies. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, Written, chunks, mix, word_spans
from .components import components
from .exchange import groups, placed, row_ids, unpacked
from .tiles import incidence, least_in_component, meetings, shared_counts

BITS, SUBSTRINGS = 128, 5
#: Bits of one substring; the last 3 bits of a descriptor are in no table.
SUBSTRING_BITS = BITS // SUBSTRINGS
#: Nearest corners of a corner that make a key with it.
NEIGHBOURS = 3
#: Most bits in which two descriptors of one corner differ.
NEAR = 24
#: Corners that must agree on one turn, scale and shift.
CONSENSUS = 5
#: Descriptor pairs that are measured at once.
DISTANCES = 1 << 16
#: Pixels of a spot: corners of one level are further apart.
SPOT = 6
TILE = 256
#: Images whose keys one task compares, about.
ROWS_EACH = 2048
#: Tables whose keys are shuffled at once, and in how many parts images go to their pieces, so that less lies on disk at a time.
WAVES, SHIPMENTS = ((0, 1, 2), (3, 4)), 2
#: Levels: how many pixels of the image a pixel stands for, and whether it is softened first.
LEVELS = ((1, False), (1, True), (2, False))
SCALE = np.array([scale for scale, _ in LEVELS], np.float32)
_MARGIN = 8
_HEADER = re.compile(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s")
#: Pixels that are stacked and searched at a time.
PIXELS = 1 << 18
#: Pairs of points, none further than 6 from the corner, so that any turn of them stays inside the margin.
_TESTS = np.random.default_rng(3).normal(0, 3.0, (BITS, 2, 2))
_TESTS *= np.minimum(1, 6 / np.maximum(np.hypot(_TESTS[..., 0], _TESTS[..., 1]), 1e-9))[..., None]


#: What turns a column into images, each with a digest of its bytes.
Decoder = Callable[[pa.Array], list[tuple[np.ndarray | None, bytes | None]]]


def read_grey(raw: bytes | None) -> np.ndarray | None:
    head = _HEADER.match(raw or b"")
    if not head:
        return None
    colours, width, height = (3 if head[1] == b"6" else 1), int(head[2]), int(head[3])
    data = np.frombuffer(raw, np.uint8, offset=head.end())[: width * height * colours]
    if len(data) < width * height * colours:
        return None
    return data.reshape(height, width) if colours == 1 else np.rint(data.reshape(height, width, 3) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def write_grey(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def grey_maps(column: pa.Array) -> list[tuple[np.ndarray | None, bytes | None]]:
    """Image and digest of each of a column's values; no digest where there are no bytes."""
    return [(read_grey(raw), hashlib.md5(raw).digest() if raw else None) for raw in column.to_pylist()]


def soften(image: np.ndarray) -> np.ndarray:
    """The mean of every square of two by two."""
    x = image.astype(np.float32)
    return (x[:-1, :-1] + x[1:, :-1] + x[:-1, 1:] + x[1:, 1:]) / 4


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1; what lies outside counts as 0. The order of additions is the same everywhere."""
    for axis in (0, 1):
        out = x.copy()
        for shift in range(1, r + 1):
            if axis == 0:
                out[shift:] += x[:-shift]
                out[:-shift] += x[shift:]
            else:
                out[:, shift:] += x[:, :-shift]
                out[:, :-shift] += x[:, shift:]
        x = out
    return x


def _peak(x: np.ndarray, r: int) -> np.ndarray:
    """The greatest within r along both axes, by doubled steps."""
    for axis in (0, 1):
        pad = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], constant_values=-1)
        width, n = 1, 2 * r + 1
        cut = lambda a, lo, hi, axis=axis: a[lo:hi] if axis == 0 else a[:, lo:hi]
        while width < n:
            step = min(width, n - width)
            size = pad.shape[axis]
            pad = np.maximum(cut(pad, 0, size - step), cut(pad, step, size))
            width += step
        x = pad
    return x


def corners(image: np.ndarray, inner: np.ndarray, apart: int = 5) -> np.ndarray:
    """(y, x) of the strongest corners of their neighbourhoods among inner places: both eigenvalues of the gradient's spread are large."""
    gy, gx = np.gradient(image)
    a, b, c = _box(gx * gx, 2), _box(gx * gy, 2), _box(gy * gy, 2)
    strength = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    return np.argwhere(inner & (strength == _peak(strength, apart)) & (strength > 50))


def _describe_stack(images: list[np.ndarray], number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image number, places and descriptors of images of one width, stacked. All that a corner uses lies inside its image."""
    heights = np.array([len(x) for x in images])
    starts = np.cumsum(heights) - heights
    owner = np.repeat(np.arange(len(images)), heights)
    level = np.concatenate(images).astype(np.float32)
    row = np.arange(len(level)) - starts[owner]
    inner = np.zeros(level.shape, bool)
    inner[(row >= _MARGIN) & (row < heights[owner] - _MARGIN), _MARGIN:-_MARGIN] = True
    at = corners(level, inner)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, 4), np.float32), np.zeros((0, BITS // 8), np.uint8)
    smooth = _box(level, 1)
    span = np.arange(-6, 7)
    disc = (span[:, None] ** 2 + span[None, :] ** 2) <= 36
    patch = smooth[at[:, 0, None, None] + span[None, :, None], at[:, 1, None, None] + span[None, None, :]] * disc
    angle = np.arctan2((patch * span[None, :, None]).sum(axis=(1, 2)), (patch * span[None, None, :]).sum(axis=(1, 2)))
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    wide = smooth.shape[1]
    flat, here = smooth.ravel(), at[:, :1] * wide + at[:, 1:]

    def sample(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        return flat.take(here + (np.rint(sin * dx + cos * dy) * wide + np.rint(cos * dx - sin * dy)).astype(np.int64))

    bits = np.packbits(sample(*_TESTS[:, 0].T) < sample(*_TESTS[:, 1].T), axis=1)
    image = owner[at[:, 0]]
    return image, np.c_[at[:, 1] * SCALE[number], (at[:, 0] - starts[image]) * SCALE[number], np.full(len(at), number), angle].astype(np.float32), bits


def _alone(owner: np.ndarray, level: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which descriptors have no near one at another place of their image and level: in a pattern that repeats none says where it is."""
    words, group = bits.view(np.uint64), owner * len(LEVELS) + level.astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(order)])
    out, widths = np.ones(len(order), bool), -(-sizes // 8) * 8
    # Groups of about one size are measured together, a large one a few rows at a time.
    for width in np.unique(widths):
        mine = np.flatnonzero(widths == width)
        step = max(1, DISTANCES // width**2)
        for lo in range(0, len(mine), step):
            inside = np.arange(width) < sizes[mine[lo : lo + step], None]
            at = order[np.where(inside, starts[mine[lo : lo + step], None] + np.arange(width), 0)]
            one, two = words[at, 0], words[at, 1]
            rows = max(1, DISTANCES // (len(at) * width))
            for r in range(0, width, rows):
                this = slice(r, r + rows)
                near = np.bitwise_count(one[:, this, None] ^ one[:, None, :]) + np.bitwise_count(two[:, this, None] ^ two[:, None, :]) <= NEAR
                near &= inside[:, None, :]
                out[at[:, this][inside[:, this]]] = near.sum(axis=2)[inside[:, this]] == 1
    return out


def describe_all(images: list[np.ndarray | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each image the places (x, y, level, angle) in its own pixels and the descriptors (uint8 rows) of all corners, level by level."""
    owner, places, bits = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.float32)], [np.zeros((0, BITS // 8), np.uint8)]
    for number, (scale, soft) in enumerate(LEVELS):
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, image in enumerate(images):
            if image is not None and min(image.shape) // scale - soft > 2 * _MARGIN:
                h, w = (n // scale * scale for n in image.shape)
                level = soften(image) if soft else image if scale == 1 else image[:h, :w].astype(np.float32).reshape(h // scale, scale, w // scale, scale).mean(axis=(1, 3))
                by_width.setdefault(level.shape[1], []).append((i, level))
        for stack in by_width.values():
            lo = 0
            sizes = np.cumsum([x.size for _, x in stack])
            while lo < len(stack):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PIXELS, "right")))
                image, p, b = _describe_stack([x for _, x in stack[lo:hi]], number)
                owner.append(np.array([i for i, _ in stack[lo:hi]])[image])
                places.append(p)
                bits.append(b)
                lo = hi
    of, places_, bits_ = np.concatenate(owner), np.concatenate(places), np.concatenate(bits)
    alone = _alone(of, places_[:, 2], bits_)
    of, places_, bits_ = of[alone], places_[alone], bits_[alone]
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(images) + 1))
    return [(places_[order[a:b]], bits_[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few images at a time, as all their levels are held together."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    return describe_all([image])[0]


def vote_cells(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """The cell of turn (30 degrees), scale and shift (8 pixels) that each pair of places votes for, in two grids half a cell apart."""
    turn, scale = b[:, 3] - a[:, 3], SCALE[b[:, 2].astype(int)] / SCALE[a[:, 2].astype(int)]
    cos, sin = np.cos(turn), np.sin(turn)
    dx, dy = b[:, 0] - scale * (cos * a[:, 0] - sin * a[:, 1]), b[:, 1] - scale * (sin * a[:, 0] + cos * a[:, 1])
    for shift in (0, 0.5):
        parts = (np.floor(turn / (np.pi / 6) + shift) % 12, np.log2(scale) + 1, np.floor(dx / 8 + shift) + (1 << 17), np.floor(dy / 8 + shift) + (1 << 17))
        cell = np.zeros(len(a), np.int64)
        for part, width in zip(parts, (4, 2, 18, 18), strict=True):
            cell = cell << width | np.rint(part).astype(np.int64)
        yield cell


def spots(places: np.ndarray) -> np.ndarray:
    """The number of each place's spot: corners of several levels there are one."""
    return np.unique(places[:, :2] // SPOT @ np.array([1 << 14, 1], np.float64), return_inverse=True)[1]


def consensus(places_a: np.ndarray, bits_a: np.ndarray, places_b: np.ndarray, bits_b: np.ndarray, enough: int | None = None, spot: np.ndarray | None = None) -> int:
    """Most spots of a with near descriptors that agree on a cell of vote_cells(); a spot votes once for a cell, however many corners of b look like it.

    With enough, counting ends once so many agree: where much looks alike, few corners say it.
    """
    words_a, words_b, spot = bits_a.view(np.uint64), bits_b.view(np.uint64), spots(places_a) if spot is None else spot
    votes, best, step = [np.zeros(0, np.int64)] * 2, 0, max(1, DISTANCES // max(1, len(words_b)))
    for lo in range(0, len(words_a), step):
        distance = np.bitwise_count(words_a[lo : lo + step, 0, None] ^ words_b[None, :, 0])
        for k in range(1, words_a.shape[1]):
            distance += np.bitwise_count(words_a[lo : lo + step, k, None] ^ words_b[None, :, k])
        i, j = np.nonzero(distance <= NEAR)
        if not len(i):
            continue
        for grid, cell in enumerate(vote_cells(places_a[lo + i], places_b[j])):
            votes[grid] = np.unique(np.r_[votes[grid], cell << 21 | spot[lo + i]])
            cells = votes[grid] >> 21
            best = max(best, int(np.diff(np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])).max()))
        if enough is not None and best >= enough:
            return best
    return best


def surely_linked(places: list[np.ndarray], bits: list[np.ndarray], meet: np.ndarray) -> np.ndarray:
    """Of the pairs that meet those whose equal descriptors alone reach the consensus, counting each descriptor of an image at its first place only."""
    out = np.zeros(meet.shape, bool)
    owner = np.repeat(np.arange(len(bits)), [len(b) for b in bits])
    words = np.concatenate([np.zeros((0, 2), np.uint64), *[b.view(np.uint64) for b in bits]])
    place = np.concatenate([np.zeros((0, 4), np.float32), *places])
    spot = np.concatenate([np.zeros(0, np.int64), *map(spots, places)])
    value = mix(words[:, 0] ^ mix(words[:, 1].copy()))
    order = np.lexsort((owner, value))
    same = (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    order = order[~np.r_[False, same]] if len(order) else order
    owner, place, spot, value = owner[order], place[order], spot[order], value[order]
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
    ends = np.repeat(np.r_[starts[1:], len(value)], np.diff(np.r_[starts, len(value)])) if len(value) else starts
    by_owner = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by_owner], np.arange(len(bits) + 1))
    for i in range(len(bits)):
        mine = by_owner[cuts[i] : cuts[i + 1]]
        size = ends[mine] - mine - 1
        total = np.cumsum(size)
        other = np.repeat(mine + 1 - total + size, size) + np.arange(int(total[-1]) if len(total) else 0)
        here = np.repeat(mine, size)[meet[i, owner[other]]]
        other = other[meet[i, owner[other]]]
        if len(other) < CONSENSUS:
            continue
        for cell in vote_cells(place[here], place[other]):
            order = np.lexsort((spot[here], cell, owner[other]))
            o, c, s = owner[other][order], cell[order], spot[here][order]
            cell_new = np.r_[True, (o[1:] != o[:-1]) | (c[1:] != c[:-1])]
            vote = cell_new | np.r_[True, s[1:] != s[:-1]]
            heads = np.flatnonzero(cell_new)
            enough = np.add.reduceat(vote.astype(np.int64), heads) >= CONSENSUS
            out[i, o[heads[enough]]] = True
    return out | out.T


def packed_places(places: np.ndarray) -> bytes:
    """x and y as 16 bits, level and angle (in 256 steps) as 8 bits each: six bytes a corner."""
    out = np.zeros(len(places), [("x", "<u2"), ("y", "<u2"), ("s", "u1"), ("a", "u1")])
    out["x"], out["y"], out["s"] = places[:, 0].clip(0, 65535), places[:, 1].clip(0, 65535), places[:, 2]
    out["a"] = np.rint(places[:, 3] / (2 * np.pi) * 256).astype(np.int64) & 255
    return out.tobytes()


def unpacked_places(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, [("x", "<u2"), ("y", "<u2"), ("s", "u1"), ("a", "u1")])
    return np.c_[x["x"], x["y"], x["s"], x["a"] * (2 * np.pi / 256)].astype(np.float32)


def nearest_pairs(places: np.ndarray, owner: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """(corner, one of its nearest of the same image and level), each two corners once. Corners of few are measured together."""
    group = owner * len(LEVELS) + places[:, 2].astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(order)])
    x, y = (np.r_[places[order, i], np.float32(np.inf)] for i in (0, 1))
    out = [np.zeros((0, 2), np.int64)]
    width = 2
    while (sizes > width // 2).any():
        mine = np.flatnonzero((sizes > max(1, width // 2)) & (sizes <= width))
        step = max(1, at_once // width**2)
        for lo in range(0, len(mine), step):
            first, size = starts[mine[lo : lo + step]], sizes[mine[lo : lo + step]]
            at = np.where(np.arange(width) < size[:, None], first[:, None] + np.arange(width), len(order))
            # A large group goes a few rows at a time.
            rows = max(1, at_once // (len(at) * width))
            for r in range(0, width, rows):
                this = at[:, r : r + rows]
                with np.errstate(invalid="ignore"):
                    apart = (x[this][:, :, None] - x[at][:, None, :]) ** 2 + (y[this][:, :, None] - y[at][:, None, :]) ** 2
                apart[np.isnan(apart) | (this[:, :, None] == at[:, None, :])] = np.inf
                for _ in range(NEIGHBOURS):
                    nearest = apart.argmin(axis=2)
                    least = np.take_along_axis(apart, nearest[:, :, None], 2)[:, :, 0]
                    some = np.isfinite(least)
                    other = np.take_along_axis(at, nearest, 1)
                    out.append(np.c_[order[this[some]], order[other[some]]])
                    np.put_along_axis(apart, nearest[:, :, None], np.inf, 2)
        width *= 2
    pairs = np.sort(np.concatenate(out), axis=1)
    code = np.unique(pairs[:, 0] * len(order) + pairs[:, 1])
    return np.stack(np.divmod(code, max(1, len(order))), axis=1)


def keys_of(places: np.ndarray, bits: np.ndarray, owner: np.ndarray, tables: Sequence[int] = range(SUBSTRINGS), shared: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(image, key) of some tables: the different keys of every image, 64 bits each, image by image. With shared, most keys that come once are left out."""
    pairs = nearest_pairs(places, owner)
    each = np.unpackbits(bits, axis=1)[:, : SUBSTRINGS * SUBSTRING_BITS].reshape(-1, SUBSTRINGS, SUBSTRING_BITS)
    value = (each @ (1 << np.arange(SUBSTRING_BITS)).astype(np.float32)).astype(np.uint64)[:, list(tables)]
    low, high = (f(value[pairs[:, 0]], value[pairs[:, 1]]) for f in (np.minimum, np.maximum))
    table = np.array(tables, np.uint64)[None, :]
    key = mix((((low << np.uint64(SUBSTRING_BITS)) | high) + (table << np.uint64(2 * SUBSTRING_BITS))).ravel())
    image = np.repeat(owner[pairs[:, 0]], len(tables))
    if shared:
        slot = (key >> np.uint64(64 - max(1, 2 * len(key)).bit_length())).astype(np.int64)
        several = np.bincount(slot)[slot] > 1
        image, key = image[several], key[several]
    order, first = groups(image, key)
    return image[order[first]], key[order[first]]


def pair_keys(places: list[np.ndarray], bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """keys_of() images with these places and descriptors each."""
    owner = np.repeat(np.arange(len(places)), [len(b) for b in bits])
    return keys_of(np.concatenate([np.zeros((0, 4), np.float32), *places]), np.concatenate([np.zeros((0, BITS // 8), np.uint8), *bits]), owner)


def joined(places: list[bytes], bits: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, descriptors and image numbers of packed images, end to end."""
    sizes = [len(b) // (BITS // 8) for b in bits]
    return unpacked_places(b"".join(places)), np.frombuffer(b"".join(bits), np.uint8).reshape(-1, BITS // 8), np.repeat(np.arange(len(bits)), sizes)


def ties(described: DataFrame, rows: int, tables: Sequence[int]) -> DataFrame:
    """(a, b) for each image a that shares a key of these tables with an earlier one, b being the least that has it."""
    tasks = max(2 * int(described.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_EACH))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row = batch.column("row_id").to_numpy()
            image, every = keys_of(*joined(batch.column("places").to_pylist(), batch.column("bits").to_pylist()), tables)
            yield placed((every % np.uint64(tasks)).astype(np.int64), row[image], key=(every >> np.uint64(32)).astype(np.uint32).view(np.int32))

    def tie(table: pa.Table) -> pa.Table:
        row, (key,) = row_ids(table), unpacked(table, "key")
        order = np.lexsort((row, key))
        row, key = row[order], key[order]
        first = np.ones(len(row), bool)
        first[1:] = key[1:] != key[:-1]
        least = row[np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))]
        a, b = np.unique(np.c_[row, least][row != least], axis=0).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    sent = described.select("row_id", "places", "bits").mapInArrow(send, "task long, base long, low array<int>, key array<int>")
    return sent.groupBy("task").applyInArrow(tie, "a long, b long")


def descriptors(images: DataFrame, column: str = "image", decode: Decoder = grey_maps) -> DataFrame:
    """(row_id, md5, n_corners, places, bits): digest, corners and descriptors as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            decoded, digests = zip(*decode(batch.column(column)), strict=True)
            found = describe_all(list(decoded))
            columns = [pa.array(digests, pa.binary()), pa.array([len(b) for _, b in found], pa.int32()), pa.array([packed_places(p) for p, _ in found], pa.binary()), pa.array([b.tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *columns], names=["row_id", "md5", "n_corners", "places", "bits"])

    return images.select("row_id", column).mapInArrow(run, "row_id long, md5 binary, n_corners int, places binary, bits binary")


def compared(places: list[np.ndarray], bits: list[np.ndarray], linked: np.ndarray) -> np.ndarray:
    """Which pairs of a matrix of booleans reach the consensus; most are settled by equal descriptors."""
    some = np.flatnonzero(linked.any(axis=1))
    out = np.zeros(linked.shape, bool)
    if not len(some):
        return out
    places, bits, linked = [places[i] for i in some], [bits[i] for i in some], linked[np.ix_(some, some)]
    sure, spot = surely_linked(places, bits, linked), {}
    for i, j in np.argwhere(np.triu(linked & ~sure, 1)).tolist():
        if min(len(bits[i]), len(bits[j])) >= CONSENSUS:
            if i not in spot:
                spot[i] = spots(places[i])
            sure[i, j] = sure[j, i] = consensus(places[i], bits[i], places[j], bits[j], CONSENSUS, spot[i]) >= CONSENSUS
    out[np.ix_(some, some)] = sure
    return out


def _met(piece: int, g: pd.DataFrame) -> np.ndarray:
    """Which images of a piece meet here: by its tiles, and if no lesser piece has both of them."""
    left, right = g.left.to_numpy(), g.right.to_numpy()
    meet = (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
    np.fill_diagonal(meet, False)
    return meet & (incidence([x[x < piece] for x in g.pieces]) == 0)


def _links(frame: pd.DataFrame) -> pd.DataFrame:
    """(rep, to, links) of the images of a task that link to others: the least that their links reach, and the weight of all linked images."""
    out = [pd.DataFrame({"rep": [], "to": [], "links": []})]
    meetings, kept, size = [], [], 0
    for piece, g in frame.sort_values(["piece", "rep"]).groupby("piece", sort=False):
        meet = _met(piece, g)
        some = meet.any(axis=1)
        if some.any():
            meetings.append((size, meet[np.ix_(some, some)]))
            kept.append(g.index[some])
            size += int(some.sum())
    if not kept:
        return out[0]
    frame = frame.loc[np.concatenate(kept)]
    ids, weight = frame.rep.to_numpy(), frame.n.to_numpy()
    every_place, every_bits, owner = joined(frame.places.tolist(), frame.bits.tolist())
    image, key = keys_of(every_place, every_bits, owner, shared=True)
    corner, at = (np.searchsorted(x, np.arange(size + 1)) for x in (owner, image))
    for lo, meet in meetings:
        hi = lo + len(meet)
        mine, rows = slice(at[lo], at[hi]), range(lo, hi)
        meet &= shared_counts(len(meet), image[mine] - lo, key[mine]) > 0
        linked = compared([every_place[corner[i] : corner[i + 1]] for i in rows], [every_bits[corner[i] : corner[i + 1]] for i in rows], meet)
        some = linked.any(axis=1)
        out.append(pd.DataFrame({"rep": ids[lo:hi][some], "to": ids[lo:hi][least_in_component(linked)][some], "links": (linked @ weight[lo:hi])[some]}))
    return pd.concat(out)


def pieces_of(tied: DataFrame) -> DataFrame:
    """(rep, piece) of (a, b): each b and all that are tied to it are the piece b."""
    return tied.select(F.col("a").alias("rep"), F.col("b").alias("piece")).union(tied.select("b", "b")).distinct()


def copies(images: DataFrame, column: str = "image", tile: int = TILE, decode: Decoder = grey_maps) -> DataFrame:
    """(row_id, class_id, n_equal, n_links, n_corners) for images (row_id unique, a column that decode turns into images); n_equal counts rows of the same bytes."""
    write = Written(images.sparkSession, clean=True)
    described = write(descriptors(images, column, decode))
    every, rows = described.select("row_id", "md5", "n_corners"), described.count()
    classes = write(every.where("md5 is not null").groupBy("md5").agg(F.min("row_id").alias("rep"), F.count("*").alias("n")))
    # Images of the same bytes have the same keys, so the least of a key is the least of its bytes.
    found = reduce(DataFrame.union, [write(ties(described, rows, tables)) for tables in WAVES])
    pieces = write(pieces_of(found.join(classes.select(F.col("rep").alias("a")), "a", "left_semi")))
    of_rep = pieces.groupBy("rep").agg(F.collect_list("piece").alias("pieces"))
    asked = write(meetings(pieces, tile).join(of_rep, "rep").join(classes.select("rep", "n"), "rep"))
    shipped = lambda n: asked.where(F.pmod(F.xxhash64("piece"), F.lit(SHIPMENTS)) == n).join(described.select(F.col("row_id").alias("rep"), "places", "bits"), "rep")
    linked = reduce(DataFrame.union, [write(shipped(n).groupBy("task").applyInPandas(_links, "rep long, to long, links long")) for n in range(SHIPMENTS)])
    label = components(linked.where("rep != to").select(F.col("rep").alias("a"), F.col("to").alias("b")).distinct()).toDF("rep", "class_rep")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(label, "rep", "left").join(links, "rep", "left")
    known = known.select("md5", F.coalesce("class_rep", "rep").alias("class_id"), F.col("n").alias("n_equal"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = every.join(known, "md5", "left")
    return out.select("row_id", F.coalesce("class_id", "row_id").alias("class_id"), F.coalesce("n_equal", F.lit(1)).cast("long").alias("n_equal"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_corners")


_DOTS = np.random.default_rng(9).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def draw(column: pa.Array, words_a_row: int = 21, side: int = 3, border: int = _MARGIN) -> list[tuple[np.ndarray | None, bytes | None]]:
    """Each text as a picture, every word a square of grey dots that its hash chooses, row by row; none of a text without words.

    Around the words the picture goes on from its other side, so that every dot of a word, however short the text, can
    be a corner of the first level.
    """
    out = []
    for _, data, offsets in chunks(pa.RecordBatch.from_arrays([column], names=["text"])):
        starts, ends, firsts = word_spans(data, offsets)
        dots = ((SpanHasher.of_bytes(data)(starts, ends)[:, None] * _DOTS[: side * side]) >> np.uint64(56)).astype(np.uint8).reshape(-1, side, side)
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            rows = -(-int(b - a) // words_a_row)
            grid = np.zeros((rows * words_a_row, side, side), np.uint8)
            grid[: b - a] = dots[a:b]
            page = np.ascontiguousarray(grid.reshape(rows, words_a_row, side, side).swapaxes(1, 2)).reshape(rows * side, words_a_row * side)
            out.append((np.pad(page, border, mode="wrap"), hashlib.md5(page).digest()) if rows else (None, None))
    return out


def drawn(texts: DataFrame, column: str) -> DataFrame:
    """(row_id, image): the pictures of draw() as grey maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            images = [None if image is None else write_grey(image) for image, _ in draw(batch.column(column))]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(images, pa.binary())], names=["row_id", "image"])

    return texts.select("row_id", column).mapInArrow(run, "row_id long, image binary")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so every page is drawn as one, whole."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("row_id"), "html")
    return copies(pages, "html", decode=draw).withColumnRenamed("row_id", "page_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_media": op7_media}
ORACLES: dict[str, str] = {}
