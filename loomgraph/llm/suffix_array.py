"""Suffix arrays by two-stage sorting, in numpy.

Suffixes smaller than their successor are sorted directly; every other suffix is put in place by scanning the buckets of
first bytes in order. Order is decided by the first ``depth`` bytes; suffixes that agree on them are neighbours. Rolling
hashes shorten the sort; common prefixes of neighbours, and whether they are in order, are read from the text itself.
"""

from __future__ import annotations

import numpy as np

from loomgraph.llm.textarrays import mix, powers, prefix_hash, windows

#: Bytes that are compared without first asking how many a group shares.
PLAIN = 32


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts a byte later; the end counts as smallest."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = text[change + 1] > text[change]
    if not n:
        return np.zeros(0, bool)
    # bytes equal to their successor are as the last of their run
    at = np.searchsorted(change, np.arange(n))
    return np.r_[rises, False][at]


def common_prefix(sums: np.ndarray, powers_of: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, at most ``depth``, by halving on rolling hashes."""
    length = np.zeros(len(a), np.int64)
    step = 1 << (depth.bit_length() - 1)
    while step:
        longer = length + step <= depth
        x, y = a + length, b + length
        equal = (sums[x + step * longer] - sums[x]) * powers_of[y] == (sums[y + step * longer] - sums[y]) * powers_of[x]
        length += step * (longer & equal)
        step >>= 1
    return length


class Suffixes:
    """``text`` with its rolling hashes and room behind its end. ``kind`` chooses the hash function."""

    def __init__(self, text: np.ndarray, depth: int, kind: int = 0):
        self.n, self.depth = len(text), depth
        self.text = np.r_[text, np.zeros(depth + 16, np.uint8)]
        values = self.text + np.uint64(1)
        self.sums = prefix_hash(mix(values + np.uint64(kind << 8)) if kind else values)  # only ranges of one length are compared
        self.powers = powers(len(self.sums))[0]
        self.whole = windows(self.sums, depth)  # hash of the first ``depth`` bytes
        # the eight bytes from each place on as one number in their order
        self.eight = np.zeros(len(self.text) - 7, np.uint64)
        for k in range(8):
            self.eight <<= np.uint64(8)
            self.eight |= self.text[k : k + len(self.eight)]

    def sort_directly(self, at: np.ndarray) -> np.ndarray:
        """The given suffixes in order.

        One of each set that agrees on ``depth`` bytes is sorted by its first eight bytes; those that tie go on behind
        the prefix their whole group shares.
        """
        _, first, same = np.unique(self.whole[at], return_index=True, return_inverse=True)
        some = at[first]
        key = self.eight[some]
        order = np.argsort(key)
        key, some = key[order], some[order]
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if len(key) else np.zeros(0, np.int64)
        back = order
        open_ = np.flatnonzero(self._tied(group))
        known = 8
        while len(open_):
            # ``open_`` holds the places of tied groups, in order
            own, place = group[open_], some[open_]
            if known < PLAIN:  # most ties end soon
                ahead, known = known, known + 8
            else:
                head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                lcp = common_prefix(self.sums, self.powers, place[:-1], place[1:], self.depth)
                lcp[head[1:] - 1] = self.depth  # neighbours of different groups
                shared = np.minimum.reduceat(np.r_[lcp, self.depth], head)
                ahead = np.repeat(shared, np.diff(np.r_[head, len(own)]))
            key = self.eight[place + ahead]
            turn = np.lexsort((key, own))
            some[open_], back[open_] = place[turn], back[open_][turn]
            key, own = key[turn], own[turn]
            fresh = np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])]
            # the place of a group's first member numbers it, so groups keep their order
            group[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))] + len(group)
            open_ = open_[self._tied(np.cumsum(fresh))]
        # every suffix next to the one that stands for it
        rank = np.empty(len(first), np.int64)
        rank[back] = np.arange(len(first))
        return at[np.argsort(rank[same.ravel()], kind="stable")]

    @staticmethod
    def _tied(group: np.ndarray) -> np.ndarray:
        equal = group[1:] == group[:-1]
        return np.r_[equal, False] | np.r_[False, equal] if len(group) else np.zeros(0, bool)

    def array(self, wanted: np.ndarray | None = None) -> np.ndarray:
        """All suffixes in order, or the ``wanted`` ones (a mask).

        A suffix that is not wanted takes part only if one before it is put in place by it.
        """
        text, n = self.text[: self.n], self.n
        if not n:
            return np.zeros(0, np.int64)
        small = smaller_than_next(text)
        takes_part = np.ones(n, bool)
        if wanted is not None:
            # no directly sorted suffix lies between the last wanted one, with it, and this one
            last = np.maximum.accumulate(np.where(wanted, np.arange(n), -1))
            direct_before = np.cumsum(small) - small
            takes_part = wanted | (last >= 0) & (direct_before == direct_before[last])
        direct = self.sort_directly(np.flatnonzero(small & takes_part))
        bounds = np.searchsorted(text[direct], np.arange(257))
        large = ~small & takes_part
        induced: list[list[np.ndarray]] = [[] for _ in range(256)]

        def scan(suffixes: np.ndarray, byte: int) -> np.ndarray:
            """Put the predecessors that are larger than ``suffixes`` behind those of their buckets so far; the ones of
            this bucket are returned."""
            before = suffixes[suffixes > 0] - 1
            before = before[large[before]]
            first = text[before]
            turn = np.argsort(first, kind="stable")
            first, before = first[turn], before[turn]
            present = np.flatnonzero(np.bincount(first, minlength=1))
            for b, part in zip(present, np.split(before, np.searchsorted(first, present[1:]))):
                induced[b].append(part)
            return before[first == byte]

        induced[text[n - 1]].append(np.flatnonzero(takes_part[n - 1 :]) + n - 1)
        out = []
        for byte in range(256):
            own = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
            while len(own):
                out.append(own)
                induced[byte] = []
                own = scan(own, byte)
            own = direct[bounds[byte] : bounds[byte + 1]]
            if len(own):
                out.append(own)
                scan(own, byte)
        order = np.concatenate(out) if out else np.zeros(0, np.int64)
        return order if wanted is None else order[wanted[order]]

    def agreement(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes a and b have in common, at most ``depth``, read from the text."""
        length = np.full(len(a), self.depth, np.int64)
        open_ = np.arange(len(a))
        for known in range(0, self.depth, 8):
            differ = self.eight[a[open_] + known] ^ self.eight[b[open_] + known]
            ends = differ != 0
            low = differ[ends]
            same = sum((low < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
            length[open_[ends]] = np.minimum(known + same, self.depth)
            open_ = open_[~ends]
            if not len(open_):
                break
        return length

    def common_prefixes(self, order: np.ndarray) -> tuple[np.ndarray, bool]:
        """Bytes, at most ``depth``, that each suffix of ``order`` has in common with the one before it (0 for the
        first), and whether all neighbours are in order.

        A pair of neighbours whose two suffixes start one byte behind those of another pair, after an equal byte, agrees
        on one byte less. Such pairs form chains through the text, and only the last pair of a chain is compared.
        """
        before = np.full(len(self.text), -1, np.int64)
        before[order[1:]] = order[:-1]
        place = np.flatnonzero(before >= 0)
        other = before[place]
        if not len(place):
            return np.zeros(len(order), np.int64), True
        goes_on = (place[1:] == place[:-1] + 1) & (other[1:] == other[:-1] + 1)
        goes_on &= self.text[place[:-1]] == self.text[other[:-1]]
        last = np.flatnonzero(np.r_[~goes_on, True])
        known = self.agreement(other[last], place[last])
        part = known < self.depth
        at = known[part]
        in_order = bool((self.text[other[last[part]] + at] < self.text[place[last[part]] + at]).all())
        size = np.diff(np.r_[-1, last])
        found = np.zeros(len(self.text), np.int64)
        found[place] = np.repeat(known + last, size) - np.arange(len(place))
        return np.minimum(np.r_[0, found[order[1:]]], self.depth), in_order
