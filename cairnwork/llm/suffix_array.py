"""Suffix arrays by induced sorting, in numpy: whole buckets are induced at a time.

Suffixes are classed as smaller (S) or larger (L) than their right neighbour. The leftmost S suffixes split the text
into substrings; inducing from them in any order sorts those substrings, their names make a shorter text whose suffixes
are sorted in turn, and inducing from the sorted ones sorts all suffixes, both in linear time. The shorter text has too
many names for buckets, so it is sorted by doubled prefixes, up to a depth that the caller needs.
"""

from __future__ import annotations

import numpy as np

from .common import SpanHasher


def classify(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their right neighbour. The last symbol is the least and occurs once."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(following, n - 2)] > 0
    return out


class _Induction:
    def __init__(self, text: np.ndarray, small: np.ndarray):
        self.text, self.small = text, small
        self.size = int(text.max()) + 1
        self.tails = np.cumsum(np.bincount(text, minlength=self.size))
        self.heads = np.r_[0, self.tails[:-1]]

    def run(self, seeds: np.ndarray) -> np.ndarray:
        """All suffixes in the order that leftmost S suffixes, in this order, induce."""
        text, small, size = self.text, self.small, self.size
        out = np.empty(len(text), np.int32)
        free = self.heads.copy()

        def place(batch: np.ndarray, of_small: bool) -> None:
            before = batch[batch > 0] - 1
            before = before[small[before] == of_small]
            symbol = text[before]
            order = np.argsort(symbol, kind="stable")
            symbol, counts = symbol[order], np.bincount(symbol, minlength=size)
            nth = np.arange(len(symbol)) - (np.cumsum(counts) - counts)[symbol]
            if of_small:
                out[free[symbol] - 1 - nth] = before[order]
                free[:] -= counts
            else:
                out[free[symbol] + nth] = before[order]
                free[:] += counts

        order = np.argsort(text[seeds], kind="stable")
        seeds = seeds[order]
        ends = np.cumsum(np.bincount(text[seeds], minlength=size))
        for c in range(size):
            done = self.heads[c]
            while done < free[c]:
                batch, done = out[done : free[c]].copy(), free[c]
                place(batch, False)
            if (lo := ends[c - 1] if c else 0) < ends[c]:
                place(seeds[lo : ends[c]], False)
        large_ends, free = free, self.tails.copy()
        out[0] = len(text) - 1
        free[0] = 0
        for c in range(size - 1, -1, -1):
            done = self.tails[c]
            while done > free[c]:
                batch, done = out[free[c] : done][::-1].copy(), free[c]
                place(batch, True)
            if c and self.heads[c] < large_ends[c]:
                place(out[self.heads[c] : large_ends[c]][::-1].copy(), True)
        return out


def _sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a text of names, in order up to depth names; only ties are sorted again, by doubled prefixes."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    head = np.r_[True, names[order][1:] != names[order][:-1]]
    k = 1
    while k <= depth:
        start = np.flatnonzero(head)
        size = np.diff(np.r_[start, n])
        if (size == 1).all():
            break
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.repeat(start, size)
        rank[n] = -1
        tied = np.flatnonzero(np.repeat(size > 1, size))
        mine = order[tied]
        key = rank[mine] * (n + 2) + rank[np.minimum(mine + k, n)] + 1
        again = np.argsort(key, kind="stable")
        order[tied] = mine[again]
        head[tied] |= np.r_[True, key[again][1:] != key[again][:-1]]
        k *= 2
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of text (small whole numbers, the last the least and single), in order at least up to depth symbols."""
    if len(text) < 3:
        return np.arange(len(text), dtype=np.int32)[::-1].copy()
    _, text = np.unique(text, return_inverse=True)
    text = text.astype(np.uint16)
    small = classify(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    induction = _Induction(text, small)
    found = induction.run(seeds)
    seed = np.zeros(len(text), bool)
    seed[seeds] = True
    found = found[seed[found]]
    nth = np.empty(len(text), np.int32)
    nth[seeds] = np.arange(len(seeds))
    ends = np.minimum(np.r_[seeds[1:], len(text) - 1] + 1, len(text))
    whole = SpanHasher((text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))(seeds, ends)[nth[found]]
    length = (ends - seeds)[nth[found]]
    new = np.r_[True, (whole[1:] != whole[:-1]) | (length[1:] != length[:-1])]
    if new.all():
        return induction.run(found)
    names = np.empty(len(seeds), np.int64)
    names[nth[found]] = np.cumsum(new) - 1
    return induction.run(seeds[_sort_names(names, depth)])


def long_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """In text order: whether a suffix shares its first length symbols with the one before it (permuted common prefixes up to length)."""
    hashes = SpanHasher((text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)).windows(length)
    out = np.zeros(len(text), bool)
    if not len(hashes):
        return out
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    whole = np.flatnonzero((np.arange(len(text)) < len(hashes)) & (before >= 0) & (before < len(hashes)))
    out[whole] = hashes[whole] == hashes[before[whole]]
    return out


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """For each place of text whether its next length symbols also start elsewhere."""
    order = suffix_array(text, length)
    shared = long_prefixes(text, order, length)
    out = shared.copy()
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text))
    out[order[rank[np.flatnonzero(shared)] - 1]] = True
    return out
