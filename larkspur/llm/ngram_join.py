"""N-gram Jaccard join by partitioning the universe of shingles, exact at every size.

Sets are dealt into size bands, such that similar sets lie in one band or in two neighbouring ones. Each
band has a scheme: the universe of shingles is hashed into m segments, and the part of a set that falls
into a segment is indexed by its hash. Two similar sets differ in at most H shingles, so with v_i the
difference that segment i forgives (0: equal parts; 1: equal after one deletion; -1: segment not used) a
pair is found unless its differences use up every segment, which takes more than the sum of
min(|part_i|, v_i + 1) differences on the side of either set. Sets whose own sum exceeds H are found by
their non-empty parts alone. The few whose sum does not ("poor" sets) also index all segments, empty ones
too, among themselves. Sets take part in their own band's scheme and in the one below.

All segments start at v = 0. What is in a bucket is tied together by candidates that form a tree, which are
verified exactly. Ties that aren't links, between different components, leave those components open. With D the
most that a set x may differ in from a linked one, both have at least c = (non-empty parts of x) - D of them in
common. If each set leaves half of c - 1 of its segments out, whichever it likes, linked sets still meet in one
that neither has left out, so a set first cuts the open ties that it can cut that way. The cost of an open tie is set against that of one-deletion neighbourhoods: where these are cheaper, the
costliest segments go to v = -1 and the cheapest ones of the scheme to v = 1. The components that the ties
of the final allocation join are one group, and a group is compared with itself by differences: each set
stands as what sets it apart from the group's pivot, a set near most of the others. Of two linked sets that
aren't both in the pivot's component, the differences d and e share at least (d + e - H) / 2 >= 1 elements,
so an index of the elements that come first in any order of the group's finds every such pair. Those seldom met with
in an eighth of its sets come first; elements behind are never listed.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, LongType, StructField, StructType

from larkspur.llm.common import (
    MIX_A,
    MIX_B,
    Scratch,
    WordHashes,
    arrow_rows,
    bounded_broadcast,
    byte_batches,
    shuffle_partitions,
    table,
    text_batches,
    texts_of,
    unused,
)
from larkspur.llm.components import components
from larkspur.llm.tokenizing import tidy

#: Signatures gathered in a task before they are sorted and dealt out.
FLUSH = 200_000
#: Buckets of so many nodes have every pair as a candidate; larger ones a tree.
SMALL_BUCKET = 8
#: How a candidate (a, b) was found: as one of all pairs of a bucket, tied to its head, tied to it with others tied to a.
WHOLE, TREE, STANDS = 0, 1, 2
#: Groups of at most so many nodes and shingles are compared whole in one task, their sets held at once.
SMALL_GROUP = 64
SMALL_SHINGLES = 1 << 17
#: Shared elements of differences that a pair must have among those indexed, if it must share as many at all.
TOGETHER = 2
#: Elements whose counts are told to the tasks that choose what is indexed, 16 bytes each.
USUAL = 1 << 17
#: Ids and signatures that may be broadcast (8 bytes each); beyond it, a shuffle join does the same.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts whose sets are made at once, and the longest stretch of a text that is split into words at once.
AT_ONCE = 1 << 20
STRETCH = 4 << 20

_32 = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Rule:
    """Shingles of n words; sets are linked from a similarity of num / den on."""

    n: int = 3
    num: int = 90
    den: int = 100

    def difference(self, total: int) -> int:
        """The most that two similar sets of `total` shingles together can differ in."""
        return total * (self.den - self.num) // (self.den + self.num)

    def reach(self, size: int) -> int:
        """The largest size of a set similar to one of this size."""
        return size * self.den // self.num

    def linked(self, common: int, total: int) -> bool:
        return self.den * common >= self.num * (total - common)


@functools.lru_cache(maxsize=8)
def bands(rule: Rule, upto: int) -> tuple[tuple[int, int], ...]:
    out, low = [], 1
    while low <= upto:
        out.append((low, rule.reach(low)))
        low = out[-1][1] + 1
    return tuple(out)


@functools.lru_cache(maxsize=4096)
def band_of(rule: Rule, size: int) -> int:
    limit = 1
    while limit < size:
        limit *= 4
    return next(k for k, (_, high) in enumerate(bands(rule, limit)) if size <= high)


@functools.lru_cache(maxsize=4096)
def scheme(rule: Rule, k: int) -> tuple[int, int]:
    """(m, H): segments of the band's scheme, and the most differences of a pair that meets in it."""
    limit = 1
    while len(bands(rule, limit)) <= k:
        limit *= 4
    low, high = bands(rule, limit)[k]
    h = rule.difference(high + rule.reach(high))
    m = h + 1
    while h and m < 4 * low:  # few sets of this band shall have no more than H parts that aren't empty
        empty = (1 - 1 / m) ** low
        if m * (1 - empty) - 2.5 * math.sqrt(m * empty * (1 - empty)) >= h + 1:
            break
        m += max(1, m // 20)
    return m, h


def spare(rule: Rule, k: int, size: int, full: int) -> int:
    """Half of what a set of this size, with `full` parts that aren't empty, has in common with any linked one beyond a first part.

    Of pairs that meet in the scheme of band k, one set at least is of that band.
    """
    limit = 1
    while len(bands(rule, limit)) <= k:
        limit *= 4
    high = bands(rule, limit)[k][1]
    most = rule.difference(size + (rule.reach(size) if size <= high else high))
    return max(0, full - most - 1) // 2


@dataclass(frozen=True)
class Sets:
    """Several sets: the ascending hashes of each, one set after the other; set i is flat[ends[i] : ends[i + 1]]."""

    flat: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    def only(self, chosen: np.ndarray) -> Sets:
        """The sets at True."""
        if chosen.all():
            return self
        sizes = self.sizes
        return Sets(self.flat[np.repeat(chosen, sizes)], _ends(sizes[chosen]))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values at each set's elements, modulo 2 ** 64; 0 for empty sets."""
        out = np.zeros(len(self), np.uint64)
        full = self.sizes > 0
        if full.any():
            out[full] = np.add.reduceat(values, self.ends[:-1][full])
        return out


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def one_set(own: np.ndarray) -> Sets:
    return Sets(own, np.array([0, len(own)]))


def _words(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a whole text, a stretch at a time."""
    at = 0
    while text and at < len(text):
        end = min(len(text), at + STRETCH)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].lower().split()
        at = end


def _window_hashes(own: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(own) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - n + 1 + k])
    return h


def shingles(texts: list[bytes | None], rule: Rule, words: WordHashes) -> Sets:
    """The sets of whole texts, as ascending 64-bit hashes."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        before = len(hashes)
        for part in _words(text):
            hashes.extend(map(words.__getitem__, part))
        counts[i] = len(hashes) - before
    own, n = np.fromiter(hashes, np.uint64, len(hashes)), rule.n
    all_windows = _window_hashes(own, n) if len(own) >= n else np.zeros(0, np.uint64)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    flat, ends = np.empty(sizes.sum(), np.uint64), _ends(sizes)
    for start, count, x, y in zip(_ends(counts).tolist(), counts.tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
        if count >= n:
            flat[x:y] = all_windows[start : start + y - x]
            flat[x:y].sort()
        elif count:
            flat[x:y] = _window_hashes(own[start : start + count], count)
    new = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.zeros(0, bool)
    new[ends[:-1][sizes > 0]] = True
    return Sets(flat[new], _ends(new)[ends])


def keys_of(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set; the first is its node."""
    n = sets.sizes.astype(np.uint64)
    first = mix(sets.sums(mix(sets.flat + np.uint64(1))) + n)
    second = mix(sets.sums(mix(sets.flat ^ np.uint64(0xA5A5A5A5A5A5A5A5))) ^ n)
    return first.view(np.int64), second.view(np.int64)


@dataclass(frozen=True)
class Allocation:
    """By scheme, the segments that are not used and those that forgive one deletion; all others are at 0."""

    skipped: dict[int, np.ndarray] = field(default_factory=dict)
    deep: dict[int, np.ndarray] = field(default_factory=dict)


START = Allocation()


class Parts:
    """The parts of sets in the segments of one scheme each: `k` and `m` are its number and segments by set."""

    def __init__(self, sets: Sets, k: np.ndarray, m: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(sets)), sets.sizes)
        segment = ((sets.flat >> _32) * m.astype(np.uint64)[owner]) >> _32
        self.first = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])]))
        self.token = mix(sets.flat ^ np.uint64(0x5851F42D4C957F2D))
        self.sums = np.add.reduceat(self.token, self.first)
        self.sizes = np.diff(np.append(self.first, len(sets.flat)))
        self.segment, self.owner = segment[self.first].astype(np.int64), owner[self.first]
        self.k = k[self.owner]

    def within(self, segments: dict[int, np.ndarray]) -> np.ndarray:
        """Whether each part's segment is among those of its scheme."""
        cells = [_cell(np.full(len(i), k), i) for k, i in segments.items()]
        return np.isin(_cell(self.k, self.segment), np.concatenate(cells)) if cells else np.zeros(len(self.k), bool)


def _signature(sums: np.ndarray, k: np.ndarray, segment: np.ndarray, space: int) -> np.ndarray:
    place = segment.astype(np.uint64) + (k.astype(np.uint64) << np.uint64(34)) + np.uint64((space << 33) + 1)
    return mix(sums + mix(place * np.uint64(MIX_B)))


def _schemes(sets: Sets, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(chosen, k, m, H) of the sets' own band's scheme, then of the one below, for the sets that have it."""
    sizes, back = np.unique(sets.sizes, return_inverse=True)
    tops = np.array([band_of(rule, n) if n else -1 for n in sizes.tolist()], np.int64)
    for below in (0, 1):
        of_size = [(k, *scheme(rule, k)) if k >= 0 else (k, 0, 0) for k in (tops - below).tolist()]
        k, m, h = np.array(of_size, np.int64).reshape(-1, 3)[back].T
        chosen = (k >= 0) & (h > 0)  # without a difference to forgive, similar sets are equal sets
        if chosen.any():
            yield chosen, k[chosen], m[chosen], h[chosen]


def signatures_of(sets: Sets, rule: Rule, allocation: Allocation = START) -> tuple[np.ndarray, ...]:
    """(signature, set, scheme, segment) of the equal-parts index of sets; segment -1 is a poor set's."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for chosen, k, m, h in _schemes(sets, rule):
        place, own = np.flatnonzero(chosen), sets.only(chosen)
        parts = Parts(own, k, m)
        used = ~parts.within(allocation.skipped)
        reached = np.bincount(parts.owner[used], minlength=len(own))
        if allocation.deep:
            reached += np.bincount(parts.owner[parts.within(allocation.deep) & (parts.sizes > 1)], minlength=len(own))
        segment = parts.segment[used]
        found.append((_signature(parts.sums[used], parts.k[used], segment, 0), place[parts.owner[used]], parts.k[used], segment))
        bounds = np.searchsorted(parts.owner, np.arange(len(own) + 1))
        for i in np.flatnonzero(reached <= h).tolist():
            x, y = bounds[i], bounds[i + 1]
            whole, scheme_ = np.zeros(m[i], np.uint64), np.full(m[i], k[i])
            whole[parts.segment[x:y]] = parts.sums[x:y]
            found.append((_signature(whole, scheme_, np.arange(m[i]), 1), np.full(m[i], place[i]), scheme_, np.full(m[i], -1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(own: np.ndarray, rule: Rule, allocation: Allocation = START) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, scheme, segment) of one set."""
    sig, _, k, segment = signatures_of(one_set(own), rule, allocation)
    return sig, k, segment


def neighbourhoods_of(
    sets: Sets, rule: Rule, allocation: Allocation, node: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, deletions, node) in the segments at v = 1: each part, and each part without one of its shingles.

    Equal parts meet as they are, so the deletions of a part are those of the smallest node that has it here.
    """
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for chosen, k, m, _ in _schemes(sets, rule):
        own, nodes = sets.only(chosen), node[chosen]
        parts = Parts(own, k, m)
        at = np.flatnonzero(parts.within(allocation.deep))
        whole = _signature(parts.sums[at], parts.k[at], parts.segment[at], 0)
        found.append((whole, np.zeros(len(at), np.int64), nodes[parts.owner[at]]))
        order = np.lexsort((nodes[parts.owner[at]], whole))
        order = order[np.append(True, whole[order][1:] != whole[order][:-1])] if len(order) else order
        at = at[order]
        at = at[parts.sizes[at] > 1]
        part = np.repeat(at, parts.sizes[at])
        element = np.arange(len(part)) - np.repeat(_ends(parts.sizes[at])[:-1] - parts.first[at], parts.sizes[at])
        less = _signature(parts.sums[part] - parts.token[element], parts.k[part], parts.segment[part], 0)
        found.append((less, np.ones(len(part), np.int64), nodes[parts.owner[part]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def neighbourhoods(own: np.ndarray, rule: Rule, allocation: Allocation) -> tuple[np.ndarray, np.ndarray]:
    """(signature, deletions) of one set."""
    return neighbourhoods_of(one_set(own), rule, allocation, np.zeros(1, np.int64))[:2]


def _sets(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    """Runs of rows of about AT_ONCE bytes, and the sets of the texts in their second column."""
    words = WordHashes()
    for part in byte_batches(batches, AT_ONCE, 1):
        yield part, shingles(texts_of(part.column(1)), rule, words)


def _nodes(sets: Sets, clashes: frozenset[int]) -> np.ndarray:
    first, second = keys_of(sets)
    return np.where(np.isin(first, list(clashes)), second, first) if clashes else first


def _different(batches: Iterator[pa.RecordBatch], rule: Rule, clashes: frozenset[int]) -> Iterator[tuple[np.ndarray, Sets]]:
    """(nodes, their sets) of the texts with shingles, of equal sets in a run only one."""
    for _, sets in _sets(batches, rule):
        node = _nodes(sets, clashes)
        full = np.flatnonzero(sets.sizes > 0)
        chosen = np.zeros(len(sets), bool)
        chosen[full[np.unique(node[full], return_index=True)[1]]] = True
        yield node[chosen], sets.only(chosen)


@tidy
def _profile(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for part, sets in _sets(batches, rule):
        empty = sets.sizes == 0
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(sets.sizes), *(pa.array(k, mask=empty) for k in keys_of(sets))],
            names=["doc_id", "n_shingles", "node", "other"],
        )


def _planes(x: np.ndarray) -> bytes:
    """Bytes of like significance together, so that the shuffle's compression finds the zeros."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _distinct(sig: np.ndarray, node: np.ndarray, stands: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signature, node, whether it stands for others), each pair once, ascending, and the size of each one's bucket."""
    order = np.lexsort((~stands, node, sig))
    sig, node, stands = sig[order], node[order], stands[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]) if len(sig) else np.zeros(0, bool)
    sig, node, stands = sig[new], node[new], stands[new]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    return sig, node, stands, np.repeat(np.diff(np.append(first, len(sig))), np.diff(np.append(first, len(sig))))


def _ties(pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
    return both[:, 0], both[:, 1]


def _tree(sig: np.ndarray, node: np.ndarray, stands: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signature, node, stands) that are left, and (a, b): of buckets above SMALL_BUCKET only the smallest node is, tied to the others."""
    sig, node, stands, size = _distinct(sig, node, stands)
    first = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
    head = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
    large = size > SMALL_BUCKET
    a, b = _ties([np.stack([node, head], 1)[large & ~first]])
    left = ~large | first
    return sig[left], node[left], (stands | large)[left], a, b


def _met(sig: np.ndarray, node: np.ndarray, stands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, tree) of whole buckets: every pair of small ones, and trees over those that are large or were tied in part before.

    tree is WHOLE, TREE, or STANDS where others are tied to a.
    """
    sig, node, stands, size = _distinct(sig, node, stands)
    if not len(sig):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    counts = np.diff(np.append(first, len(sig)))
    tree = (size > SMALL_BUCKET) | np.repeat(np.logical_or.reduceat(stands, first), counts)
    head = np.repeat(node[first], counts)
    tied, whole = np.stack([node, head], 1), []
    trees = [_ties([tied[tree & (node != head) & (stands == s)]]) for s in (False, True)]
    for d in range(1, SMALL_BUCKET):
        at = np.flatnonzero((sig[d:] == sig[:-d]) & ~tree[d:])
        whole.append(np.stack([node[at + d], node[at]], 1))
    found = [*trees, _ties(whole)]
    kinds = np.repeat(np.array([TREE, STANDS, WHOLE], np.int32), [len(a) for a, _ in found])
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), kinds


def _deep_tree(sig: np.ndarray, kind: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signature, kind, node) that are left, and (a, b): nodes whose parts are equal after one deletion on one side.

    Where a whole part (kind 0) is here, the parts that come to it by a deletion (kind 1) are tied to it and go.
    """
    order = np.lexsort((node, kind, sig))
    sig, kind, node = sig[order], kind[order], node[order]
    new = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))
    meets = kind[first] == 0
    pairs = np.stack([node, node[first]], 1)[meets & (node != node[first])]
    left = ~meets | new
    left[1:] &= ~((sig[1:] == sig[:-1]) & (kind[1:] == kind[:-1]) & (node[1:] == node[:-1]))
    pairs = np.unique(pairs, axis=0)
    return sig[left], kind[left], node[left], pairs[:, 0], pairs[:, 1]


_BLOCK = "block int, sigs binary, at binary, nodes binary"


def _block_rows(sig: np.ndarray, kind: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> pa.RecordBatch:
    """Ascending signatures, nodes and a bit for each, packed in blocks by the first bits, and the ties (a, b) found already."""
    rows = []
    starts = np.searchsorted(sig, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    for block, (x, y) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(sig)], strict=True)):
        if x < y:
            nodes, at = np.unique(node[x:y], return_inverse=True)
            at = (at * 2 + kind[x:y]).astype(np.uint32)
            rows.append((block, _planes(np.diff(sig[x:y], prepend=np.uint64(0))), _planes(at), nodes.tobytes()))
    for x in range(0, len(a), 4096):
        rows.append((int(a[x]) & ((1 << bits) - 1), None, a[x : x + 4096].tobytes(), b[x : x + 4096].tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "sigs", "at", "nodes"]
    )


@tidy
def _deal(batches: Iterator[pa.RecordBatch], rule: Rule, bits: int, clashes: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """Signatures in packed blocks by their first bits; large buckets are tied here already."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        sig, node = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        sig, node, stands, a, b = _tree(sig, node, np.zeros(len(sig), bool))
        return _block_rows(sig, stands, node, a, b, bits)

    for node, sets in _different(batches, rule, clashes):
        sig, owner, _, _ = signatures_of(sets, rule)
        held.append((sig, node[owner]))
        count += len(sig)
        if count >= FLUSH:
            yield flush()
            count = 0
    if held:
        yield flush()


@tidy
def _deal_deep(
    batches: Iterator[pa.RecordBatch], rule: Rule, bits: int, clashes: frozenset[int], allocation: Allocation
) -> Iterator[pa.RecordBatch]:
    """As _deal, the one-deletion neighbourhoods of an allocation and the signatures of sets that it makes poor."""
    for node, sets in _different(batches, rule, clashes):
        sig, kind, of = neighbourhoods_of(sets, rule, allocation, node)
        poor, owner, _, segment = signatures_of(sets, rule, allocation)
        poor, of_poor = poor[segment == -1], node[owner[segment == -1]]
        yield _block_rows(*_deep_tree(np.append(sig, poor), np.append(kind, np.zeros(len(poor), np.int64)), np.append(of, of_poor)), bits)


@tidy
def _meet(batches: Iterator[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, tree) of nodes that share a signature; rows come sorted by block, and one block is held at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    block = None

    def pairs(a: np.ndarray, b: np.ndarray, tree: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(tree)], names=["a", "b", "tree"])

    def done() -> pa.RecordBatch:
        sig, bit, node = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        if deep:
            a, b = _deep_tree(sig, bit, node)[-2:]
            return pairs(a, b, np.full(len(a), TREE, np.int32))
        return pairs(*_met(sig, node, bit > 0))

    for batch in batches:
        for key, sigs, at, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != block and held:
                yield done()
            block = key
            if sigs is None:
                a = np.frombuffer(at, np.int64)
                yield pairs(a, np.frombuffer(nodes, np.int64), np.full(len(a), TREE, np.int32))
            else:
                at = _unplanes(at, "<u4")
                held.append((np.cumsum(_unplanes(sigs, "<u8")), (at & 1).astype(np.int64), np.frombuffer(nodes, np.int64)[at >> 1]))
    if held:
        yield done()


@tidy
def _with_nodes(batches: Iterator[pa.RecordBatch], rule: Rule, clashes: frozenset[int], at: int, name: str) -> Iterator[pa.RecordBatch]:
    """The rows, with the node of the text in column `at`; null without shingles."""
    words = WordHashes()
    for batch in byte_batches(batches, AT_ONCE, at):
        sets = shingles(texts_of(batch.column(at)), rule, words)
        nodes = pa.array(_nodes(sets, clashes), mask=sets.sizes == 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, name])


@tidy
def _wanted_sets(batches: Iterator[pa.RecordBatch], rule: Rule, clashes: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """(node, its set) of rows (doc_id, text, node) whose text is that node's, or whose node is null."""
    for part, sets in _sets(batches, rule):
        node, any_ = _nodes(sets, clashes), part.column(2).is_null().to_numpy(zero_copy_only=False)
        wanted = part.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        chosen = (sets.sizes > 0) & (any_ | (wanted == node))
        own = sets.only(chosen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[chosen]), pa.ListArray.from_arrays(pa.array(own.ends.astype(np.int32)), pa.array(own.flat.view(np.int64)))],
            names=["node", "own"],
        )


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _cell(k: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """One number for a segment of a scheme; 0 in the low half stands for the sets that are poor."""
    return (k.astype(np.int64) << 32) + segment.astype(np.int64) + 1


def _shared(x: np.ndarray, y: np.ndarray, rule: Rule) -> np.ndarray:
    """The segments in which two sets meet."""
    (sig, k, segment), (other, _, _) = signatures(x, rule), signatures(y, rule)
    _, at, _ = np.intersect1d(sig, other, return_indices=True)
    return _cell(k[at], segment[at])


@functools.lru_cache(maxsize=4096)
def _layout(rule: Rule, size: int) -> dict[int, tuple[int, int, int]]:
    """Of a sketch of a set of this size: scheme -> (start, end, H)."""
    out, at, top = {}, 0, band_of(rule, size)
    for k in (top, top - 1):
        m, h = scheme(rule, k) if k >= 0 else (0, 0)
        if h:
            out[k] = (at, at + m, h)
            at += m
    return out


@tidy
def _sketches(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(node, n, sketch, spare) of (node, own): 16 bits for each part of the set in its schemes, 0 only for empty ones.

    spare: by scheme, the number of segments that the set may leave out, in the low half of a number.
    """
    for batch in batches:
        owns = _arrays(batch.column(1))
        sets = Sets(np.concatenate(owns) if owns else np.zeros(0, np.uint64), _ends(np.array([len(x) for x in owns], np.int64)))
        pieces: list[list[bytes]] = [[] for _ in owns]
        spares: list[list[int]] = [[] for _ in owns]
        for chosen, k, m, _ in _schemes(sets, rule):
            parts, ends = Parts(sets.only(chosen), k, m), _ends(m)
            full = np.bincount(parts.owner, minlength=len(k))
            for i, x, n, own in zip(np.flatnonzero(chosen).tolist(), k.tolist(), sets.sizes[chosen].tolist(), full.tolist(), strict=True):
                spares[i].append((x << 32) + spare(rule, x, n, own))
            marks = np.zeros(ends[-1], np.uint16)
            marks[ends[parts.owner] + parts.segment] = np.maximum(mix(parts.sums) >> np.uint64(48), np.uint64(1))
            for i, x, y in zip(np.flatnonzero(chosen).tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
                pieces[i].append(marks[x:y].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sets.sizes, pa.int64()),
                pa.array([b"".join(x) for x in pieces], pa.binary()),
                pa.array(spares, pa.list_(pa.int64())),
            ],
            names=["node", "n", "sketch", "spare"],
        )


def _apart(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, rule: Rule) -> tuple[bool, list[int]]:
    """Whether two sketches tell that their sets aren't linked, and the segments in which the sets meet.

    Parts whose 16 bits differ hold a difference at least each, so more of them than linked sets may differ in
    settle a pair. Parts may be taken for equal that aren't (one in 65,536), never the other way round.
    """
    of_x, of_y, apart, cells = _layout(rule, n_x), _layout(rule, n_y), False, []
    for k in of_x.keys() & of_y.keys():
        (i, j, h), (u, v, _) = of_x[k], of_y[k]
        one, two = x[i:j], y[u:v]
        equal = one == two
        apart |= len(equal) - int(equal.sum()) > rule.difference(n_x + n_y)
        full_x, full_y = one != 0, two != 0
        cells += ((k << 32) + np.flatnonzero(equal & full_x) + 1).tolist()
        if int(full_x.sum()) <= h and int(full_y.sum()) <= h and equal.any():
            cells.append(k << 32)
    return apart, cells


@tidy
def _sift(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs with sketches; those that a sketch settles have linked = false, and where they are in trees the segments."""
    for batch in batches:
        linked, shared = [], []
        tree, n_a, x, n_b, y = (batch.column(i).to_pylist() for i in range(2, 7))
        for in_tree, size, one, size_b, two in zip(tree, n_a, x, n_b, y, strict=True):
            apart, cells = _apart(np.frombuffer(one, np.uint16), np.frombuffer(two, np.uint16), size, size_b, rule)
            linked.append(False if apart else None)
            shared.append(cells if apart and in_tree else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(linked, pa.bool_()), pa.array(shared, pa.list_(pa.int64()))],
            names=["a", "b", "tree", "linked", "shared"],
        )


@tidy
def _verify(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Exact comparison of pairs of sets; of those that aren't linked, the segments in which they meet."""
    for batch in batches:
        linked, shared = [], []
        for x, y, tree in zip(_arrays(batch.column(2)), _arrays(batch.column(3)), batch.column(4).to_pylist(), strict=True):
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            linked.append(rule.linked(int((large[at] == small).sum()), len(x) + len(y)))
            shared.append(_shared(x, y, rule) if tree and not linked[-1] else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(4), pa.array(linked, pa.bool_()), pa.array(shared, pa.list_(pa.int64()))],
            names=["a", "b", "tree", "linked", "shared"],
        )


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open ties (a, b, shared) that are left; rows (node, tree, spare, a, b, shared) come sorted by node, those of few segments first.

    A node leaves segments out as long as `spare` allows, and is tied by the others. Ties of nodes that others are
    tied to in that bucket stay, and so do those of sets that are poor.
    """
    now = None
    left: dict[int, int] = {}
    gone: set[int] = set()
    for batch in batches:
        keep = []
        for node, tree, own, shared in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5)), strict=True):
            if node != now:
                now, left, gone = node, {x >> 32: x & 0xFFFFFFFF for x in own}, set()
            new = set(shared) - gone
            need = Counter(c >> 32 for c in new)
            cut = tree == TREE and all(c & 0xFFFFFFFF for c in new) and all(left.get(k, 0) >= n for k, n in need.items())
            if cut:
                gone |= new
                for k, n in need.items():
                    left[k] -= n
            keep.append(not cut)
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays(kept.columns[3:], names=["a", "b", "shared"])


def _links_within(nodes: list[int], sets: list[np.ndarray], rule: Rule) -> tuple[list[int], list[int]]:
    """(a, b): a forest over the linked sets of a small group, found by comparing all of them."""
    sizes = np.array([len(x) for x in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column, often = np.cumsum(n > 1) - 1, n[at] > 1
    holds = np.zeros((len(sets), int((n > 1).sum())), np.float32)
    holds[np.repeat(np.arange(len(sets)), sizes)[often], column[at[often]]] = 1
    common = np.rint(holds @ holds.T).astype(np.int64)
    linked = rule.den * common >= rule.num * (sizes[:, None] + sizes[None] - common)
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while ((low := np.where(linked, label, len(sets)).min(1)) != label).any():
        label = low
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return [nodes[i] for i in moved.tolist()], [nodes[i] for i in label[moved].tolist()]


def _element_keys(wide: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix(mix(wide.view(np.uint64)) + e.view(np.uint64))


@tidy
def _firsts(batches: Iterator[pa.RecordBatch], keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(wide, node, part, s, d, e, at) of rows (wide, node, part, s, d, least, apart), of each set the elements to be indexed.

    Elements of `apart` are ordered by their counts, then as numbers; `at` is the place there. Of at least `least`
    shared elements the first TOGETHER (or all, if there are fewer) are before the last `least` - TOGETHER.
    """
    for batch in batches:
        wide, node, part, s, d, least = (batch.column(i).to_numpy() for i in range(6))
        apart = batch.column(6)
        ends = apart.offsets.to_numpy()
        e, starts, sizes = apart.values.to_numpy()[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)
        owner, often = np.repeat(np.arange(len(node)), sizes), np.zeros(len(e), np.int64)
        if len(keys):
            own = _element_keys(wide[owner], e)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            often = np.where(keys[at] == own, counts[at], 0)
        order = np.lexsort((e, often, owner))  # sets stay where they are
        at = np.arange(len(e)) - starts[owner]
        kept = at < (d - least + np.minimum(least, TOGETHER))[owner]
        owner = owner[kept]
        columns = (wide[owner], node[owner], part[owner], s[owner], d[owner], e[order[kept]], at[kept])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["wide", "node", "part", "s", "d", "e", "at"])


@tidy
def _inside(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Links within small groups; rows (wide, node, own) come sorted, a group is held at a time."""
    nodes: list[int] = []
    sets: list[np.ndarray] = []
    group = None
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for wide, node, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), strict=True):
            if wide != group and len(nodes) > 1:
                x, y = _links_within(nodes, sets, rule)
                a, b = a + x, b + y
            if wide != group:
                nodes, sets, group = [], [], wide
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                sets.append(own.copy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    if len(nodes) > 1:
        x, y = _links_within(nodes, sets, rule)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def allocate(
    costs: dict[int, dict[int, float]], prices: dict[int, float], segments: dict[int, int], fixed: float = 0.0
) -> Allocation:
    """Exchanges in each scheme: the costliest segment goes to -1 and the cheapest to 1 while that saves work.

    costs: elements of differences to index for what a segment's equal parts leave open; prices: signatures
    that the one-deletion neighbourhoods of one segment take; fixed: what any exchange takes, as all texts are
    read again for it. Without savings beyond that, all segments stay at 0.
    """
    skipped, deep, saved = {}, {}, 0.0
    for k, own in costs.items():
        order = sorted(range(segments[k]), key=lambda i: (-own.get(i, 0.0), i))
        n = 0
        while 2 * n + 1 < len(order) and (gain := own.get(order[n], 0.0) - prices[k] - own.get(order[-1 - n], 0.0)) > 0:
            saved += gain
            n += 1
        if n:
            skipped[k], deep[k] = np.array(order[:n]), np.array(order[len(order) - n :])
    return Allocation(skipped, deep) if saved > fixed else START


#: Rows of a record batch: texts, or pairs of sets, that a task holds at once.
ROWS = 512


class Join:
    """One run over a table of (doc_id, text); see ngram_join."""

    def __init__(self, docs: DataFrame, rule: Rule) -> None:
        self.spark: SparkSession = docs.sparkSession
        text_batches(self.spark)
        self.scratch = Scratch(self.spark, "ngram-join")
        self.rule = rule
        self.docs = docs.select("doc_id", "text")
        kind = docs.schema["doc_id"].dataType.simpleString()
        profile = self.docs.mapInArrow(
            lambda b: _profile(b, rule), f"doc_id {kind}, n_shingles long, node long, other long"
        )
        self.profile = self.kept(profile, "profile")
        sums = self.profile.agg(F.sum("n_shingles").alias("n")).first()
        self.total = sums["n"] or 0
        classes = self.profile.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("first"), F.min("n_shingles").alias("n"), F.min("other").alias("x"), F.max("other").alias("y")
        )
        # different sets with equal 64-bit hashes: about n * n / 2 ** 65 of n sets, so a handful at 1e10
        self.clashes = frozenset(r["node"] for r in classes.where("x <> y").select("node").collect())
        if self.clashes:
            again = F.when(F.col("node").isin(list(self.clashes)), F.col("other")).otherwise(F.col("node"))
            self.profile = self.profile.withColumn("node", again)
            classes = self.profile.where("node is not null").groupBy("node")
            classes = classes.agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n"))
        self.classes = self.scratch.keep(classes.select("node", "first", "n"), "classes")

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """The table written by tasks that hold few rows at once."""
        with arrow_rows(self.spark, ROWS):
            return self.scratch.keep(df, name)

    @property
    def bits(self) -> int:
        """Of a block's number: a block is of about 750,000 shingles of all texts."""
        bits = max(1, (4 * shuffle_partitions(self.spark) - 1).bit_length(), int(self.total / 750_000).bit_length())
        return min(bits, 16)

    def candidates(self) -> DataFrame:
        rule, clashes, bits = self.rule, self.clashes, self.bits
        blocks = self.docs.mapInArrow(lambda b: _deal(b, rule, bits, clashes), _BLOCK)
        dealt = blocks.repartition(shuffle_partitions(self.spark), "block").sortWithinPartitions("block")
        pairs = dealt.mapInArrow(lambda b: _meet(b, False), "a long, b long, tree int")
        return self.kept(pairs.where("a <> b").groupBy("a", "b").agg(F.max("tree").alias("tree")), "candidates")

    def read(self, nodes: DataFrame, label: str, extra: str = "") -> DataFrame:
        """(node, own[, extra]) of the nodes, read from the first text of each; by node where all its rows have null ids.

        A node may come several times where ids are shared.
        """
        rule, clashes = self.rule, self.clashes
        more = [extra] if extra else []
        wanted = nodes.join(self.classes, "node").select(F.col("first").alias("doc_id"), "node", *more)
        wanted = self.scratch.keep(wanted, f"{label}-wanted")
        texts = self.docs.join(bounded_broadcast(wanted.drop(*more), BROADCAST_ROWS), "doc_id").select("doc_id", "text", "node")
        sets = texts.mapInArrow(lambda b: _wanted_sets(b, rule, clashes), "node long, own array<long>")
        if extra:
            sets = sets.join(bounded_broadcast(wanted.select("node", extra), BROADCAST_ROWS), "node")
        unnamed = wanted.where("doc_id is null").drop("doc_id")
        if unnamed.limit(1).count():
            texts = self.docs.where("doc_id is null").withColumn("node", F.lit(None).cast("long"))
            found = texts.mapInArrow(lambda b: _wanted_sets(b, rule, clashes), "node long, own array<long>")
            sets = sets.unionByName(found.join(bounded_broadcast(unnamed, BROADCAST_ROWS), "node"))
        return sets

    def sets(self, nodes: DataFrame, label: str) -> DataFrame:
        """(node, own) of the nodes, each once."""
        sets = self.kept(self.read(nodes, label), f"{label}-sets")
        if sets.groupBy("node").count().where("count > 1").limit(1).count():
            sets = self.kept(sets.groupBy("node").agg(F.first("own").alias("own")), f"{label}-single-sets")
        return sets

    def large(self, members: DataFrame) -> DataFrame:
        """(wide) of the groups that aren't held in one task: fewer than one to SMALL_GROUP nodes, or of very long texts."""
        sizes = members.join(self.classes.select("node", "n"), "node").groupBy("wide")
        sizes = sizes.agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"))
        return sizes.where(f"nodes > {SMALL_GROUP} or shingles > {SMALL_SHINGLES}").select("wide")

    def inside(self, rows: DataFrame, label: str) -> DataFrame:
        """(a, b): a forest over the links within small groups (wide, node, own)."""
        rule = self.rule
        dealt = rows.select("wide", "node", "own").repartition(shuffle_partitions(self.spark), "wide")
        links = dealt.sortWithinPartitions("wide", "node").mapInArrow(lambda b: _inside(b, rule), "a long, b long")
        return self.kept(links, f"{label}-inside")

    def sifted(self, pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
        """(a, b, tree, linked, shared) of candidate pairs: linked is null where sketches leave it open, else false."""
        rule = self.rule
        sketches = sets.select("node", "own").mapInArrow(lambda b: _sketches(b, rule), "node long, n long, sketch binary, spare array<long>")
        sketches = self.kept(sketches, f"{label}-sketches")
        for end in ("b", "a"):  # heads of trees come first: what is shuffled next repeats theirs, row by row, and compresses
            of_end = sketches.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
            pairs = pairs.join(of_end, end)
        sifted = pairs.select("a", "b", "tree", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(
            lambda b: _sift(b, rule), "a long, b long, tree int, linked boolean, shared array<long>"
        )
        self.spare = sketches.select("node", "spare")
        return self.scratch.keep(sifted, f"{label}-sifted")

    def verified(self, pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
        """(a, b, tree, linked, shared) of candidate pairs; shared only for those in trees."""
        rule = self.rule
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = sets.join(bounded_broadcast(self.scratch.keep(ends, f"{label}-ends"), BROADCAST_ROWS), "node", "left_semi")
        with_b = pairs.select("a", "b", "tree").join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
        with_a = with_b.join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
        out = with_a.select("a", "b", "own_a", "own_b", "tree").mapInArrow(
            lambda b: _verify(b, rule), "a long, b long, tree int, linked boolean, shared array<long>"
        )
        return self.kept(out, f"{label}-verified")

    def allocation(self, open_: DataFrame) -> Allocation:
        """What the open ties of each segment cost against one-deletion neighbourhoods."""
        rule, costs = self.rule, defaultdict(dict)
        # an open tie goes only with all the segments in which it meets, so each of them bears its share
        cells = open_.select(F.explode("shared").alias("cell"), (F.lit(1.0) / F.size("shared")).alias("share"))
        for r in cells.groupBy("cell").agg(F.sum("share").alias("ties")).collect():  # a row per segment: bounded by the longest text
            k, segment = r["cell"] >> 32, (r["cell"] & 0xFFFFFFFF) - 1
            if segment >= 0:
                costs[k][segment] = 2.0 * scheme(rule, k)[1] * r["ties"]
        prices = dict.fromkeys(costs, 0.0)
        for r in self.profile.where("n_shingles > 0").groupBy("n_shingles").count().collect():  # bounded by the longest text, too
            top = band_of(rule, r["n_shingles"])
            for k in {top, top - 1} & prices.keys():
                prices[k] += r["count"] * (r["n_shingles"] / scheme(rule, k)[0] + 1)
        return allocate(costs, prices, {k: scheme(rule, k)[0] for k in costs}, float(self.total))

    def cut(self, open_: DataFrame) -> DataFrame:
        """(a, b, shared) of the open ties that sets can't cut by leaving segments out; see _cut."""
        of_node = open_.join(self.spare, "node").select("node", "tree", "spare", "a", "b", "shared")
        dealt = of_node.repartition(shuffle_partitions(self.spark), "node").sortWithinPartitions("node", F.size("shared"))
        return self.scratch.keep(dealt.mapInArrow(_cut, "a long, b long, shared array<long>"), "cut")

    def deep_ties(self, allocation: Allocation) -> DataFrame:
        """(a, b): trees over what meets by one deletion, or as sets that the allocation makes poor."""
        rule, clashes, bits = self.rule, self.clashes, self.bits
        blocks = self.docs.mapInArrow(lambda b: _deal_deep(b, rule, bits, clashes, allocation), _BLOCK)
        dealt = blocks.repartition(shuffle_partitions(self.spark), "block").sortWithinPartitions("block")
        pairs = dealt.mapInArrow(lambda b: _meet(b, True), "a long, b long, tree int")
        return self.kept(pairs.where("a <> b").select("a", "b").distinct(), "deep")

    def groups(self, done: DataFrame, parts: DataFrame) -> DataFrame | None:
        """(node, part, wide): nodes of the components, or parts, that ties join to groups of several; None if none."""
        of_a = parts.select(F.col("node").alias("a"), F.col("component").alias("part_a"))
        of_b = parts.select(F.col("node").alias("b"), F.col("component").alias("part_b"))

        def between(ties: DataFrame) -> DataFrame:
            named = ties.join(of_a, "a", "left").join(of_b, "b", "left")
            named = named.withColumn("a", F.coalesce("part_a", "a")).withColumn("b", F.coalesce("part_b", "b"))
            return named.where("a <> b").drop("part_a", "part_b")

        open_ = between(done.where(f"tree <> {WHOLE} and not linked").select(F.col("a").alias("node"), "a", "b", "tree", "shared"))
        open_ = self.scratch.keep(open_, "open")
        left = self.cut(open_)
        self.scratch.drop("first-sketches")
        if not left.limit(1).count():
            return None
        allocation = self.allocation(left)
        skipped = [int(c) for k, i in allocation.skipped.items() for c in _cell(np.full(len(i), k), i)]
        ties = left.select("a", "b")
        if skipped:  # segments left out aren't to be skipped besides, so all open ties count
            left = F.array_except("shared", F.array(*map(F.lit, skipped)))
            ties = open_.where(F.size(left) > 0).select("a", "b").union(between(self.deep_ties(allocation)))
        wide = components(ties, self.scratch, "wide").select(F.col("node").alias("part"), F.col("component").alias("wide"))
        wide = wide.union(wide.select("wide", "wide").distinct())  # a component's smallest node isn't a row of it
        tops = wide.select(F.col("part").alias("node"), "part", "wide")
        rest = parts.select("node", F.col("component").alias("part")).join(wide, "part").select("node", "part", "wide")
        return self.scratch.keep(tops.union(rest), "members")

    def by_group(self, df: DataFrame, small: DataFrame, array: str) -> DataFrame:
        """df joined with small, a row and an array to a group; broadcast if all arrays are small together."""
        held = small.agg(F.sum(F.size(array) + 4).alias("n")).first()["n"] or 0
        return df.join(F.broadcast(small) if held <= BROADCAST_ROWS else small, "wide")

    def pivots(self, held: DataFrame) -> DataFrame:
        """(wide, pivot, pivot_part, pivot_own): in each group the set next to what more than half of it holds.

        Any set would do, a near one leaves less to index: it is chosen by an eighth of the universe of shingles.
        """
        held = held.withColumn("some", F.filter("own", lambda e: e.bitwiseAND(F.lit(7)) == 0))
        totals = held.groupBy("wide").agg(F.count("*").alias("total"))
        counts = held.select("wide", F.explode("some").alias("e")).groupBy("wide", "e").agg(F.count("*").alias("n"))
        most = counts.join(bounded_broadcast(totals, BROADCAST_ROWS), "wide").where("2 * n > total")
        most = most.groupBy("wide").agg(F.collect_list("e").alias("most"))  # less than twice the mean set
        most = totals.join(most, "wide", "left").select("wide", F.coalesce("most", F.array().cast("array<long>")).alias("most"))
        most = self.scratch.keep(most, "most")
        apart = F.size("some") + F.size("most") - 2 * F.size(F.array_intersect("some", "most"))
        near = self.by_group(held, most, "most").select("wide", F.struct(apart.alias("d"), "node").alias("x"))
        near = near.groupBy("wide").agg(F.min("x").alias("x")).select(F.col("x.node").alias("node"))
        pivots = held.join(bounded_broadcast(near, BROADCAST_ROWS), "node")
        pivots = pivots.select("wide", F.col("node").alias("pivot"), F.col("part").alias("pivot_part"), F.col("own").alias("pivot_own"))
        return self.scratch.keep(pivots, "pivots")

    def usual(self, diffs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts), keys ascending: elements that several of an eighth of the sets have among their differences.

        They bear on the order of the index alone, that is on cost; of more than USUAL the most frequent ones are told.
        """
        some = diffs.where(F.col("node").bitwiseAND(F.lit(7)) == 0).select("wide", F.explode("apart").alias("e"))
        counts = some.groupBy("wide", "e").agg(F.count("*").alias("n")).where("n > 1")
        found = counts.orderBy(F.desc("n"), "wide", "e").limit(USUAL).toArrow()
        wide, e, n = (found.column(i).to_numpy() for i in range(3))
        keys = _element_keys(wide, e)
        order = np.argsort(keys)
        return keys[order], n[order]

    def further(self, members: DataFrame, sets: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(a, b) of links with the pivots, and of every other pair of parts still apart that may be linked.

        With H the most that two sets of these sizes may differ in and d, e what they differ from the pivot
        in, linked sets share at least (d + e - H) / 2 of that. Sets with d <= H are linked with the pivot.
        In any order that is the same for all sets of a group, the first j of so many shared elements are before
        the last (d + e - H) / 2 - j of either set, so the others are neither listed nor counted.
        A set of the pivot's part meets sets that aren't, so their e exceeds what the pivot allows by one
        at least; H grows by no more than the set is larger than the pivot.
        """
        num, den = self.rule.num, self.rule.den
        held = self.scratch.keep(sets.join(bounded_broadcast(members, BROADCAST_ROWS), "node"), "held")
        both = self.by_group(held, self.pivots(held), "pivot_own").where("node <> pivot")
        apart = F.concat(F.array_except("own", "pivot_own"), F.array_except("pivot_own", "own"))
        diffs = both.select(
            "wide", "node", "part", "pivot", "pivot_part", F.size("own").cast("long").alias("s"),
            F.size("pivot_own").cast("long").alias("p"), apart.alias("apart"),
        ).withColumn("d", F.size("apart").cast("long"))
        diffs = self.scratch.keep(diffs, "diffs")
        direct = diffs.where(f"d <= ((s + p) * {den - num}) div {den + num}").select(F.col("node").alias("a"), F.col("pivot").alias("b"), "part")
        direct = self.scratch.keep(direct, "direct")
        near = bounded_broadcast(direct.select("part", F.lit(True).alias("near")).distinct(), BROADCAST_ROWS)
        diffs = diffs.join(near, "part", "left").withColumn("near", F.expr("near is not null or part = pivot_part"))
        diffs = diffs.withColumn("part", F.expr("if(near, pivot_part, part)"))
        most = F.expr(f"((s + s * {den} div {num}) * {den - num}) div {den + num}")
        central = F.expr("if(near, (d + 2 - greatest(0, s - p)) div 2, 1)")
        diffs = diffs.withColumn("least", F.greatest(F.lit(1), F.col("d") - most, central))
        diffs = diffs.select("wide", "node", "part", "s", "d", "least", "apart")
        usual = self.usual(diffs)
        firsts = diffs.mapInArrow(
            lambda b: _firsts(b, *usual), "wide long, node long, part long, s long, d long, e long, at long"
        )
        firsts = self.kept(firsts, "firsts")
        between = firsts.groupBy("wide", "e").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
        between = bounded_broadcast(self.scratch.keep(between.select("wide", "e"), "between"), BROADCAST_ROWS)
        placed = self.scratch.keep(firsts.join(between, ["wide", "e"]), "placed")
        x = placed.select("wide", "e", *(F.col(c).alias(f"{c}_a") for c in ("node", "part", "s", "d", "at")))
        y = placed.select("wide", "e", *(F.col(c).alias(f"{c}_b") for c in ("node", "part", "s", "d", "at")))
        need = F.expr(f"greatest(1, (d_a + d_b - ((s_a + s_b) * {den - num}) div {den + num} + 1) div 2)")
        met = x.join(y, ["wide", "e"]).where("part_a <> part_b and node_a < node_b").withColumn("need", need)
        # the first TOGETHER shared elements have `need` shared ones from them on, less those before them
        met = met.where(f"least(d_a - at_a, d_b - at_b) > need - {TOGETHER}")
        met = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("n"), F.max("need").alias("need"))
        pairs = met.where(f"n >= least({TOGETHER}, need)").select("a", "b")
        seen = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.join(seen, ["a", "b"], "left_anti").withColumn("tree", F.lit(WHOLE))
        return direct.select("a", "b"), self.scratch.keep(pairs, "further")

    def links(self) -> DataFrame:
        """(a, b): links enough to tell all components.

        Candidates that hang together are a group. Small groups are compared whole, each in a task; of large
        ones the candidates are verified, and what trees leave open makes narrower groups of their own.
        """
        pairs = self.candidates()
        wide = components(pairs, self.scratch, "tied").select("node", F.col("component").alias("wide"))
        members = wide.union(wide.select("wide", "wide").distinct())
        large = self.scratch.keep(self.large(members), "large")
        few = F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large
        small = self.read(members.join(few, "wide", "left_anti"), "small", "wide")
        links = self.inside(small, "small")
        self.scratch.drop("small-wanted")
        inner = members.join(few, "wide", "left_semi")
        pairs = self.scratch.keep(pairs.join(inner.select(F.col("node").alias("b")), "b", "left_semi"), "pairs")
        self.scratch.drop("candidates")
        if not large.limit(1).count():
            return links
        sets = self.sets(inner.select("node"), "first")
        sifted = self.sifted(pairs, sets, "first")
        open_, settled = sifted.where("linked is null"), sifted.where("linked is not null")
        done = settled.union(self.verified(open_, sets, "first").select(*settled.columns))
        found = links.union(done.where("linked").select("a", "b"))
        parts = components(done.where("linked").select("a", "b"), self.scratch, "parts")
        members = self.groups(done, parts)
        if members is None:
            return found
        nodes = members.select("node").join(sets, "node", "left_anti")
        if nodes.limit(1).count():  # those that met by one deletion alone
            sets = sets.union(self.sets(nodes, "more"))
        large = self.scratch.keep(self.large(members), "still-large")
        few = F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large
        narrow = bounded_broadcast(self.scratch.keep(members.join(few, "wide", "left_anti"), "narrow"), BROADCAST_ROWS)
        found = found.union(self.inside(sets.join(narrow, "node"), "open"))
        if not large.limit(1).count():
            return found
        direct, further = self.further(members.join(few, "wide", "left_semi"), sets, done)
        return found.union(direct).union(self.verified(further, sets, "second").where("linked").select("a", "b"))

    def run(self) -> DataFrame:
        parts = components(self.links(), self.scratch, "all")
        named = self.classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
        named = named.join(firsts, "component").select("node", "first", "component", "component_id")
        self.named = named = self.scratch.keep(named, "named")
        for name in self.scratch.kept - {"profile", "named"}:
            self.scratch.drop(name)
        named = named.select("node", "component_id")
        return self.profile.join(named, "node", "left").select(
            "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
        )


def ngram_join(docs: DataFrame, n: int = 3, similarity: tuple[int, int] = (90, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    A text's set is that of its shingles of n words (white space parts words, A-Z count as a-z); a text of
    fewer words is one shingle. Two texts are linked if their sets' Jaccard similarity is at least the
    fraction `similarity`; component_id is the smallest doc_id that links lead to. Equal sets are one
    node and linked whatever their number. Null and empty texts, and texts of white space alone, have no
    shingles and are linked with nothing: their component is their own id. Rows with equal ids are texts
    each on their own, the ids of their components the smallest of all that are in them. Rows with null ids
    link like others; a component has a null id only if all of its rows have. Further columns
    are ignored; an empty table gives an empty result. Links are verified on whole sets of 64-bit hashes.
    """
    return Join(docs, Rule(n, *similarity)).run()


def without_near_duplicates(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one row of each group of linked texts, that of the smallest id; columns stay as they are.

    Rows are told apart by id and set, so of one id's different texts each is judged by its own group. A null id
    counts as larger than any other; of texts of one id in a group, and of rows equal in id and set, one stays.
    Rows without shingles, linked with nothing, all stay.
    """
    join = Join(docs, Rule(n, *similarity))
    join.run()
    rule, clashes = join.rule, join.clashes
    lead = F.min(F.struct(F.col("first").isNull().alias("unnamed"), "first", "node")).alias("lead")
    leads = join.named.groupBy("component").agg(lead).select("lead.node", "lead.first", F.lit(True).alias("leads"))
    leads = join.scratch.keep(leads, "leads")
    rows = join.profile.where("node is not null").join(leads, "node", "left")
    rows = rows.select("doc_id", F.expr("leads is not null and doc_id <=> first").alias("stays"))
    rows = rows.union(join.profile.where("node is null").select("doc_id", F.lit(True)))
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("stays"))
    ids = join.scratch.keep(ids.where("n > 1 or not stays"), "ids")
    gone = bounded_broadcast(ids.select("doc_id"), BROADCAST_ROWS)
    left = docs.join(gone, "doc_id", "left_anti").where("doc_id is not null").select(*docs.columns)
    # ids of several rows of which some stay, and null ids: each row is judged by its own text
    shared = bounded_broadcast(ids.where("stays").select("doc_id"), BROADCAST_ROWS)
    several = docs.join(shared, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    name = unused(docs, "node")
    schema, at = StructType([*docs.schema.fields, StructField(name, LongType())]), docs.columns.index("text")
    several = several.mapInArrow(lambda b: _with_nodes(b, rule, clashes, at, name), schema)
    several = join.kept(several, "several")
    whole = leads.select(F.col("node").alias(f"{name}_lead"), F.col("first").alias(f"{name}_id"))
    own = several.where(F.col(name).isNotNull()).join(
        whole, (F.col(name) == F.col(f"{name}_lead")) & F.col("doc_id").eqNullSafe(F.col(f"{name}_id"))
    )
    plain = [f.name for f in docs.schema.fields if f.name != "text" and isinstance(f.dataType, AtomicType)]
    nth = F.row_number().over(Window.partitionBy(name).orderBy("text", *plain))
    own = own.withColumn(f"{name}_nth", nth).where(F.col(f"{name}_nth") == 1)
    return left.union(several.where(F.col(name).isNull()).select(*docs.columns)).union(own.select(*docs.columns))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
