"""Operator 8: n-gram Jaccard self-join by universe-partition pigeonhole.

Sets that are equal are one node, named by 128 bits of its hashes. Nodes fall into bands by size, each a
factor 10/9 wide, so a pair with Jaccard >= 0.9 lies in one band or two neighbouring ones; scheme b serves
pairs whose smaller set is in band b. Such a pair differs in at most H_b = floor((r + s) / 19) shingles for
the largest sizes r, s allowed. Scheme b hashes the universe of shingles into H_b + 1 segments: by the
pigeonhole the two sets agree on a whole segment, so the sub-set of each segment is an index entry.

Allocation by cost: an entry costs the bucket it lands in. All segments have about 9 shingles, which
makes their sub-sets selective, save empty ones, whose buckets grow with the table. An empty segment is
given no entry, and its unit of the pigeonhole goes to the next segment, which then also gets its
one-deletion neighbourhood: if the sets agree on g segments, the others hold g - 1 differences beyond one
each, so one of the g segments that follow an agreeing one differs in one shingle at most. The cost of all
other entries is counted: buckets of up to FEW nodes pay their pairs; larger ones pay a comparison with one
hub for each node and are indexed anew by the differences to it (difference_entries). Up to FAMILY
nodes of one hub (and FAMILY_BYTES of their texts) go to one task with all their differences, where the overlap of
every pair is counted, a slice of the pairs at a time, and only pairs that their hashes link come out; larger families
are spread by entry and have hubs again. From round LATER on each round pays pairs of buckets four times as large, so
rounds end whatever the sets.

Counting also prunes exactly. A pair with d differences agrees on all but d segments, so it shares at least
(segments - H of its own sizes - empty ones) entries; pairs and nodes that share fewer link with nothing.

The index is never stored nor expanded to rows: tasks send their entries sorted, in packed blocks by range
of the entry, one shuffle brings equal entries together, and only pairs of small buckets, rows of larger
ones and counts come out of it. Entries that many nodes of one task have go out as rows at once, so a block
holds a bounded number of nodes an entry and task however hot it is.

Verification is exact, on the shingles of whole texts. All pairs that could link two components are
verified, so components are exact; only links inside a component are skipped.

Defined cases: null or empty text has no shingles and is its own component; repeated rows and doc_ids
are rows of one node or of two; a null doc_id takes part but never names a component unless all its
component's are null; very long texts are one set as any other; an empty table gives no rows; other columns
are ignored or, by keep_one(), kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import caches
from foliospark.llm.components import components
from foliospark.session import discard, materialize, ship_package

WORDS = 3
NUMERATOR, DENOMINATOR = 9, 10  # the threshold as a fraction
FEW = 6  # nodes of a bucket whose pairs are all compared
HOT = 8  # times the bound on small buckets: nodes of a task's block with one entry that go out as rows
LATER, GROWTH = 3, 4  # of FEW from round to round
FAMILY = 4_096  # nodes of one hub that are compared in one task
FAMILY_BYTES = 16_000_000  # of their texts, and an eighth of the hub's for each of them
CELLS = 1_000_000  # pairs of a family's nodes in memory
ROWS = 100_000  # pairs of a family that come out at once
PAIRS_AT_ONCE = 500_000  # of buckets, in memory
BLOCK = 1_000_000  # entries of a task's block
PART = 500_000  # entries in a part of the shuffle, about
CACHED_WORDS = 200_000
FEW_ROWS = 1_000_000  # of (long, long) that are broadcast; more are joined by shuffle

_M1, _M2, _M3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = np.uint64(29), np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S[0])) * _M2
    return x ^ (x >> _S[1])


_NONE = np.empty(0, np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()  # of this worker
caches.register(__name__, _HASHES.clear)


def shingle_hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order. bytes.lower and bytes.split know A-Z and
    the six ASCII white-space characters only, as the word pattern does."""
    ws = text.lower().split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    if len(_HASHES) > CACHED_WORDS:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))
    size = min(words, len(h))
    n = len(h) - size + 1
    x = np.full(n, np.uint64(size))
    for k in range(size):
        x = _mix(x * _M1 + h[k : k + n])
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if n > 1 else x


def shingle_set(text: bytes | None, words: int = WORDS) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for exact verification."""
    ws = text.lower().split() if text else []
    return {tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()


class Bands:
    def __init__(self, num: int = NUMERATOR, den: int = DENOMINATOR):
        self.num, self.den = num, den
        self.low = [1]

    def _grow(self, n: int) -> None:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def band(self, n: int) -> int:
        self._grow(n)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def segments(self, band: int) -> int:
        """H + 1 of scheme `band`: the largest difference of a linked pair whose smaller set is in it, and 1."""
        self._grow(self.low[min(band, len(self.low) - 1)])
        while len(self.low) <= band + 1:
            self._grow(self.low[-1])
        r = self.low[band + 1] - 1
        return (r + r * self.den // self.num) * (self.den - self.num) // (self.den + self.num) + 1


def signatures(hashes: np.ndarray, bands: Bands) -> tuple[np.ndarray, int, int]:
    """The index entries of a set for its own band's scheme and the one below, 48 bits of which the lowest is
    the scheme's parity and the second is free; and the empty segments of either scheme."""
    n, out, empty = len(hashes), [], [0, 0]
    if n == 0:
        return _NONE, 0, 0
    own = bands.band(n)
    value, dealt = _mix(hashes * _M3), _mix(hashes + _M1)
    for band in (own, own - 1):
        m = bands.segments(band) if band >= 0 else 1
        if m < 2:  # a linked pair of this scheme is an equal pair
            continue
        segment = (dealt % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        total = np.concatenate([[np.uint64(0)], np.cumsum(value[order])])
        edge = np.searchsorted(segment[order], np.arange(m + 1))
        sums, counts = total[edge[1:]] - total[edge[:-1]], np.diff(edge).astype(np.uint64)
        salt = np.full(m, band + 1, np.uint64) * _M1 + np.arange(m, dtype=np.uint64) * _M2
        full = counts > 0
        found = [_mix(sums[full] + _mix(salt[full]) + counts[full])]
        empty[own - band] = int((~full).sum())
        for i in np.flatnonzero(~full).tolist():
            j = (i + 1) % m
            mark = _mix(salt[j : j + 1] + np.full(1, i + 1, np.uint64) * _M3)
            part = value[order[edge[j] : edge[j + 1]]]
            variants = np.concatenate([[sums[j]], sums[j] - part])
            sizes = np.array([len(part)] + [len(part) - 1] * len(part), np.uint64)
            found.append(_mix(variants + mark + sizes))
        out.append(_entries(np.concatenate(found), band & 1))
    return (np.unique(np.concatenate(out)) if out else _NONE), empty[0], empty[1]


def _entries(hashes: np.ndarray, mark: int) -> np.ndarray:
    return (hashes >> np.uint64(18)) << np.uint64(2) | np.uint64(mark)


def difference_entries(hub: np.ndarray, other: np.ndarray, linked: bool, hub_key: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """Index entries of a set among those compared with one hub, from its differences D to the hub; and its
    class, |D| and least overlaps t with partners of the other class and of its own.

    For two such sets |i ^ j| = |D_i ^ D_j|, so a link needs |D_i & D_j| >= t = (|D_i| + |D_j| - H) / 2, and the
    first |D| - t + 1 differences of both share one (prefix filtering), t the least such overlap with any
    partner. Shingles that the hub lacks come first, as they are the rare ones. Sets that aren't linked to the
    hub have |D_j| > (|j| + |hub|) / 19, so t > (|D_i| + (|hub| - |i|) / 19) / 2 for partners of theirs. Two sets
    that are both linked to the hub need no entry: the linked ones (class A) have entries marked 0 and the
    others (class B) such for partners of class A, and others marked 1 for those of their own.
    """
    new = other[~np.isin(other, hub, assume_unique=True)]
    lost = hub[~np.isin(hub, other, assume_unique=True)]
    k, n = len(new) + len(lost), len(other)
    less, more = den - num, den + num
    most = (n + n * den // num) * less // more
    value = _mix(np.concatenate([new, lost]) * _M1 + np.full(1, hub_key, np.uint64))
    against_b = max(1, (k * more + (len(hub) - n) * less) // (2 * more) + 1)  # the least overlap with a partner of class B
    out, against_a = [], max(1, k - most)
    if linked:
        out.append(_entries(value[: max(0, k - against_b + 1)], 0))
        return np.unique(np.concatenate(out)), (0, k, against_b, 0)
    if k - most <= (n * den // num + len(hub)) * less // more:  # else no set of class A is near enough
        out.append(_entries(value[: k - against_a + 1], 0))
    own = max(against_b, k - most)
    out.append(_entries(value[: max(0, k - own + 1)], 1))
    return np.unique(np.concatenate(out)), (1, k, against_a, own)


def family_entries(hub: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, bytes]:
    """48 bits of each shingle of a set that the hub lacks, in order; and a bit for each shingle of the hub, whether the set has it."""
    new = other[~np.isin(other, hub, assume_unique=True)]
    bits = np.packbits(np.isin(hub, other, assume_unique=True))
    return new >> np.uint64(16), bits.tobytes() + bytes(-len(bits) % 8)


# Rows that come out of the shuffle. kind 0: a row of docs (a node, x doc_id, entry text hash, y set size);
# 1: a pair of nodes (a, b, x entries shared, y entries needed, z scheme's parity); 2: a node a in a large
# bucket (entry); 3: a node's counts in a scheme (a, z parity, x entries shared, y needed, w in large buckets);
# 4: a link (a, b).
OUT = "kind int, a binary, b binary, entry long, x long, y long, z long, w long"
SENT = f"part long, data binary, {OUT}"
_TYPES = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5]
_NAMES = ["kind", "a", "b", "entry", "x", "y", "z", "w"]


def _rows(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)) if c == "kind" else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _sent(rows: pa.RecordBatch, parts: int, at: int) -> pa.RecordBatch:
    """Rows that pass the shuffle as they are, dealt evenly."""
    part = parts + (at + np.arange(len(rows))) % parts
    return pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(rows), pa.binary()), *rows.columns], names=["part", "data", *_NAMES])


def _planes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _pack(names: list[bytes], sizes: np.ndarray, marks: np.ndarray, entries: np.ndarray, place: np.ndarray) -> bytes:
    """A block of nodes and of rows (entry, node) in order of the entries."""
    raw = b"".join([
        np.array([len(entries), len(names)], "<u4").tobytes(), b"".join(names), np.asarray(sizes, "<u4").tobytes(), np.asarray(marks, "<u4").tobytes(),
        _planes(np.diff(entries, prepend=np.uint64(0)), 6), _planes(place, 4),
    ])
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


class Packer:
    """Index entries of a task, sent in blocks: nodes (name, size, four numbers) with their entries."""

    def __init__(self, parts: int, few: int = FEW, stats=None):
        self.parts, self.hot, self.stats = parts, HOT * few, stats
        self.clear()

    def clear(self) -> None:
        self.names, self.sizes, self.marks, self.entries, self.n, self.seen = [], [], [], [], 0, set()

    def add(self, name: bytes, size: int, marks: tuple[int, ...], entries: np.ndarray) -> None:
        self.names.append(name)
        self.sizes.append(size)
        self.marks.append(marks)
        self.entries.append(entries)
        self.n += len(entries)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            entries = np.concatenate(self.entries)
            node = np.repeat(np.arange(len(self.names)), [len(e) for e in self.entries])
            order = np.argsort(entries, kind="stable")
            entries, node = entries[order], node[order]
            edge = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1], [True]]))
            counts = np.diff(edge)
            names = np.array(self.names, object)
            if (counts >= self.hot).any():
                hot = np.repeat(counts >= self.hot, counts)
                yield _sent(_rows(2, a=names[node[hot]], entry=entries[hot].view(np.int64)), self.parts, 0)
                if self.stats:
                    yield _sent(self.stats(names, np.array(self.sizes), np.array(self.marks), node[hot], entries[hot], np.ones(int(hot.sum()), bool)), self.parts, 0)
                first = np.zeros(len(entries), bool)
                first[edge[:-1]] = True
                entries = np.where(hot, entries | np.uint64(2), entries)
                entries, node = entries[first | ~hot], node[first | ~hot]
            bound = np.searchsorted((entries >> np.uint64(16)) * np.uint64(self.parts) >> np.uint64(32), np.arange(self.parts + 1))
            parts, blocks = [], []
            for p, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist())):
                if a == b:
                    continue
                used, place = np.unique(node[a:b], return_inverse=True)
                parts.append(p)
                blocks.append(_pack(names[used].tolist(), np.array(self.sizes)[used], np.array(self.marks)[used], entries[a:b], place))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blocks, pa.binary()), *_rows(-1, entry=np.zeros(len(parts), np.int64)).columns], names=["part", "data", *_NAMES])
        self.clear()


class Families:
    """Nodes of hubs (name, size, whether it is linked to the hub, family_entries), sent in a block for each hub."""

    def __init__(self, parts: int):
        self.parts, self.of, self.n = parts, {}, 0

    def add(self, hub: bytes, name: bytes, size: int, linked: bool, entries: np.ndarray, bits: bytes) -> None:
        packer, within = self.of.setdefault(hub, (Packer(1), []))
        packer.add(name, size, (int(linked), 0, 0, 0), entries)
        within.append(bits)
        self.n += len(entries) + len(bits) // 8

    def flush(self) -> Iterator[pa.RecordBatch]:
        hubs, blocks = list(self.of), []
        for p, bits in self.of.values():
            entries, node = np.concatenate(p.entries), np.repeat(np.arange(len(p.names)), [len(e) for e in p.entries])
            order = np.argsort(entries, kind="stable")
            index = _pack(p.names, np.array(p.sizes), np.array(p.marks), entries[order], node[order])
            blocks.append(np.array([len(index), len(bits[0]), len(bits)], "<u4").tobytes() + index + pa.compress(b"".join(bits), "zstd", asbytes=True))
        if hubs:
            part = np.array([-1 - (xxhash.xxh64_intdigest(hub) >> 1) % self.parts for hub in hubs])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(blocks, pa.binary()), *_rows(-1, a=hubs).columns], names=["part", "data", *_NAMES])
        self.of, self.n = {}, 0


def _unpack(blocks: list[bytes]) -> tuple[np.ndarray, ...]:
    """Names (two numbers), sizes, marks of distinct nodes in order of their names; (entry, node) rows; each node's first place in the blocks."""
    names, sizes, marks, entries, nodes, at = [], [], [], [], [], 0
    for block in blocks:
        raw = pa.decompress(block[4:], decompressed_size=int.from_bytes(block[:4], "little"), codec="zstd", asbytes=True)
        n, k = np.frombuffer(raw, "<u4", 2).tolist()
        names.append(np.frombuffer(raw, ">u8", 2 * k, 8).reshape(k, 2))
        sizes.append(np.frombuffer(raw, "<u4", k, 8 + 16 * k).astype(np.int64))
        marks.append(np.frombuffer(raw, "<u4", 4 * k, 8 + 20 * k).reshape(k, 4).astype(np.int64))
        entries.append(np.cumsum(_numbers(raw[8 + 36 * k : 8 + 36 * k + 6 * n], n, 6)))
        nodes.append(_numbers(raw[8 + 36 * k + 6 * n :], n, 4).astype(np.int64) + at)
        at += k
    names, nodes = np.concatenate(names).astype(np.uint64), np.concatenate(nodes)
    order = np.lexsort((names[:, 1], names[:, 0]))
    new = np.concatenate([[True], (np.diff(names[order], axis=0) != 0).any(1)])
    rank = np.empty(len(names), np.int64)
    rank[order] = np.cumsum(new) - 1
    first = order[new]
    return names[first], np.concatenate(sizes)[first], np.concatenate(marks)[first], np.concatenate(entries), rank[nodes], first


class Sizes:
    """What the sizes of sets say, by arrays. first: empty segments in the own scheme and the one below."""

    def __init__(self, sizes: np.ndarray, marks: np.ndarray, num: int, den: int):
        bands = Bands(num, den)
        bands._grow(int(sizes.max(initial=1)))
        self.num, self.den, self.sizes, self.marks = num, den, sizes, marks
        self.low = np.array(bands.low)
        self.own = np.searchsorted(self.low, sizes, side="right") - 1
        self.segments = np.array([bands.segments(b) for b in range(int(self.own.max(initial=0)) + 1)])

    def differ(self, total: np.ndarray) -> np.ndarray:
        return total * (self.den - self.num) // (self.den + self.num)

    def pair_needs(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries that a linked pair shares at least, and its scheme."""
        b = np.minimum(self.own[u], self.own[v])
        empty = np.minimum(self.marks[u, self.own[u] - b], self.marks[v, self.own[v] - b])
        return self.segments[b] - self.differ(self.sizes[u] + self.sizes[v]) - empty, b

    def node_needs(self, u: np.ndarray, parity: np.ndarray) -> np.ndarray:
        """Entries of a scheme that a node shares at least if it links in it."""
        below = (self.own[u] & 1) != parity
        n = self.sizes[u]
        largest = np.where(below, self.low[self.own[u]] - 1, n * self.den // self.num)
        b = np.maximum(self.own[u] - below, 0)
        return self.segments[b] - self.differ(n + largest) - self.marks[u, below.astype(int)]


def _stats(num: int, den: int):
    def stats(names, sizes, marks, node, entries, large) -> pa.RecordBatch:
        key = node * 2 + (entries & np.uint64(1)).astype(np.int64)
        used, place = np.unique(key, return_inverse=True)
        u, parity = used // 2, used % 2
        known = Sizes(sizes, marks.reshape(-1, 4), num, den)
        return _rows(3, a=names[u], z=parity, x=np.bincount(place, minlength=len(used)), y=known.node_needs(u, parity), w=np.bincount(place, large, len(used)).astype(np.int64))

    return stats


def _bucket_pairs(start: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of each bucket, some buckets at a time."""
    total = np.cumsum(counts * (counts - 1) // 2)
    for lot in np.split(np.arange(len(start)), np.flatnonzero(np.diff(total // PAIRS_AT_ONCE)) + 1):
        n = counts[lot]
        row = np.repeat(start[lot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        later = np.repeat(start[lot] + n, n) - row - 1
        first = np.repeat(row, later)
        yield first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)


def _counted(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below n, and how often each occurs."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    lots: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        nonlocal keys, counts
        every = np.concatenate([keys, *[k for k, _ in lots]])
        keys, place = np.unique(every, return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, *[c for _, c in lots]]), len(keys)).astype(np.int64)
        lots.clear()

    for a, b in pairs:
        lots.append(np.unique(a * n + b, return_counts=True))
        if len(lots) == 16:
            merge()
    merge()
    return keys // n, keys % n, counts


def meet_family(blocks: list[bytes], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs of one hub's nodes that are linked by the hashes of their shingles, but for those that are both linked to the hub.

    Shingles that the hub lacks are counted by equal entries (equal 48 bits of unequal ones only add to the count),
    those of the hub by bits. A slice of the nodes meets all later ones at a time, so memory follows CELLS, the nodes
    and their entries, and not the pairs."""
    index, within = [], []
    for block in blocks:
        size, width, n = np.frombuffer(block, "<u4", 3).tolist()
        index.append(block[12 : 12 + size])
        within.append(np.frombuffer(pa.decompress(block[12 + size :], decompressed_size=width * n, codec="zstd", asbytes=True), "<u8").reshape(n, width // 8))
    names, sizes, marks, entries, node, first = _unpack(index)
    bits, linked, n = np.concatenate(within)[first], marks[:, 0] > 0, len(names)
    within_hub = np.bitwise_count(bits).sum(1, dtype=np.int64)
    labels = np.array([w.tobytes() for w in names.astype(">u8")], object)
    order = np.lexsort((node, entries))
    entries, node = entries[order], node[order]
    edge = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1], [True]])) if len(entries) else np.zeros(1, np.int64)
    later = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(entries)) - 1  # rows of the same entry behind each
    rows = np.flatnonzero(later)
    rows = rows[np.argsort(node[rows], kind="stable")]
    of_node = np.searchsorted(node[rows], np.arange(n + 1))
    step = max(1, CELLS // n)
    for low in range(0, n, step):
        high = min(n, low + step)
        both = np.zeros((high - low) * n, np.int64)
        own = rows[of_node[low] : of_node[high]]
        for lot in np.split(own, np.flatnonzero(np.diff(np.cumsum(later[own]) // CELLS)) + 1):
            k = later[lot]
            partner = node[np.repeat(lot + 1 - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
            both += np.bincount(np.repeat((node[lot] - low) * n, k) + partner, minlength=len(both))
        both = both.reshape(high - low, n)
        total = sizes[low:high, None] + sizes
        most = both + np.minimum(within_hub[low:high, None], within_hub)
        u, v = np.nonzero((den * most >= num * (total - most)) & (np.arange(low, high)[:, None] < np.arange(n)) & ~(linked[low:high, None] & linked))
        some = max(1, min(ROWS, CELLS // max(1, bits.shape[1])))
        for at in range(0, len(u), some):
            i, j = u[at : at + some], v[at : at + some]
            common = both[i, j] + np.bitwise_count(bits[low + i] & bits[j]).sum(1, dtype=np.int64)
            kept = den * common >= num * (total[i, j] - common)
            if kept.any():
                i, j = low + i[kept], j[kept]
                yield _rows(1, a=labels[i], b=labels[j], x=np.ones(len(i), np.int64), y=np.zeros(len(i), np.int64), z=np.zeros(len(i), np.int64))


def meet(table: pa.Table, sub: bool, num: int, den: int, few: int = FEW) -> Iterator[pa.RecordBatch]:
    """The rows of one part of the shuffle: those that pass, and what equal entries of its blocks give.
    sub: entries are differences to hubs, the nodes' first mark is the class (0 linked to the hub)."""
    yield from table.filter(pc.is_null(table.column("data"))).select(_NAMES).to_batches()
    blocks = [x for x in table.column("data").to_pylist() if x is not None]
    if blocks and table.column("part")[0].as_py() < 0:
        families: dict[bytes, list[bytes]] = {}
        for hub, block in zip(table.column("a").to_pylist(), blocks):
            families.setdefault(hub, []).append(block)
        for x in families.values():
            yield from meet_family(x, num, den)
    elif blocks:
        names, sizes, marks, entries, node, _ = _unpack(blocks)
        labels = np.array([w.tobytes() for w in names.astype(">u8")], object)
        flagged = (entries & np.uint64(2)) > 0
        hot = np.unique(entries[flagged] & ~np.uint64(2))
        entries, node = entries[~flagged], node[~flagged]
        order = np.lexsort((node, entries))
        entries, node = entries[order], node[order]
        if len(entries):
            new = np.concatenate([[True], (entries[1:] != entries[:-1]) | (node[1:] != node[:-1])])
            entries, node = entries[new], node[new]
            edge = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1], [True]]))
            start, counts = edge[:-1], np.diff(edge)
            is_hot, mark = np.isin(entries[start], hot, assume_unique=True), (entries & np.uint64(1)).astype(np.int64)
            if sub:
                one = marks[node, 0] == 0
                n_one = np.add.reduceat(one, start, dtype=np.int64)
                valid = np.where(mark[start] == 0, (n_one > 0) & (n_one < counts), counts > 1)
            else:
                known = Sizes(sizes, marks, num, den)
                one = (known.own[node] & 1) == mark  # in the scheme of its own band
                valid = (counts > 1) & (np.add.reduceat(one, start, dtype=np.int64) > 0)
            valid |= is_hot
            small = valid & (counts <= few) & ~is_hot
            large = np.repeat(valid & ~small, counts)

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for a, b in _bucket_pairs(start[small], counts[small]):
                    ok = np.where(mark[a] == 0, one[a] != one[b], True) if sub else one[a] | one[b]
                    m, n = sizes[node[a]], sizes[node[b]]
                    ok &= np.minimum(m, n) * den >= np.maximum(m, n) * num
                    yield node[a][ok], node[b][ok]

            u, v, times = _counted(pairs(), len(names))
            if len(u):
                needs, scheme = (np.zeros(len(u), np.int64),) * 2 if sub else known.pair_needs(u, v)
                yield _rows(1, a=labels[u], b=labels[v], x=times, y=needs, z=scheme & 1)
            if large.any():
                yield _rows(2, a=labels[node[large]], entry=entries[large].view(np.int64))
            some = np.repeat(valid, counts)
            if some.any() and not sub:
                yield _stats(num, den)(labels, sizes, marks, node[some], entries[some], large[some])


def index_rows(docs: DataFrame, parts: int, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """OUT: a row for every row of docs, and what their entries have in common."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only(__name__)
        bands, packer, at = Bands(num, den), Packer(parts, FEW, _stats(num, den)), TaskContext.get().partitionId()
        for b in batches:
            sizes, nodes = [], []
            for text in b.column("text").to_pylist():
                h = shingle_hashes(text, words)
                name = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                sizes.append(len(h))
                nodes.append(name)
                if name is not None and name not in packer.seen:
                    entries, own, below = signatures(h, bands)
                    packer.seen.add(name)
                    if len(entries):
                        packer.add(name, len(h), (own, below, 0, 0), entries)
                    if packer.n > BLOCK:
                        yield from packer.flush()
            rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int32)), pa.array(nodes, pa.binary()), pa.nulls(len(b), pa.binary()), b.column("text_hash"), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())], names=_NAMES)
            yield _sent(rows, parts, at)
            at += len(b)
        yield from packer.flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return meet(pa.Table.from_batches(batches), False, num, den)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, SENT).groupBy("part").applyInArrow(met, OUT)


def compare(pairs: DataFrame, texts: DataFrame, parts: int, few: int, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """OUT of pairs (u, v, hub): links, and what the differences to hubs have in common, where u is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only(__name__)
        packer, families, at, last = Packer(parts, few), Families(parts), TaskContext.get().partitionId(), None
        hashes, exact = _NONE, None
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for u, v, hub, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "hub", "a", "b"))):
                if u != last:
                    last, hashes, exact = u, shingle_hashes(a, words), None
                other = shingle_hashes(b, words)
                both = int(np.isin(other, hashes, assume_unique=True).sum())
                linked = den * both >= num * (len(hashes) + len(other) - both) > 0
                if linked:
                    exact = exact or shingle_set(a, words)
                    y = shingle_set(b, words)
                    both = len(exact & y)
                    linked = den * both >= num * (len(exact) + len(y) - both)
                if linked:
                    links.append((u, v))
                if hub:
                    if hub == 2:
                        families.add(u, v, len(other), linked, *family_entries(hashes, other))
                    else:
                        entries, marks = difference_entries(hashes, other, linked, xxhash.xxh64_intdigest(u), num, den)
                        packer.add(v, len(other), marks, entries)
                    if packer.n + families.n > BLOCK:
                        yield from packer.flush()
                        yield from families.flush()
            if links:
                yield _sent(_rows(4, a=[x for x, _ in links], b=[y for _, y in links]), parts, at)
                at += len(links)
        yield from packer.flush()
        yield from families.flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return meet(pa.Table.from_batches(batches), True, num, den, few)

    full = (
        pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        .join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    )
    return full.mapInArrow(run, SENT).groupBy("part").applyInArrow(met, OUT)


PAIRS = "u binary, v binary, hub int"  # hub: 0 u is none, 1 it has more nodes than FAMILY (or longer texts than wide_families() allows), 2 it has fewer


def hub_pairs(rows: DataFrame) -> DataFrame:
    """PAIRS of each bucket's hub and the other nodes of rows (entry, a, weight): the hub is the node of
    largest weight, so buckets that one family of copies fills have the same."""
    hubs = rows.groupBy("entry").agg(F.max(F.struct("weight", "a")).alias("hub")).select("entry", F.col("hub.a").alias("u"))
    star = materialize(rows.join(hubs, "entry").where("a != u").select("u", F.col("a").alias("v")).distinct())
    sizes = star.groupBy("u").agg(F.when(F.count(F.lit(1)) > FAMILY, 1).otherwise(2).alias("hub"))
    return star.join(sizes, "u").select("u", "v", "hub")


def first_pairs(index: DataFrame) -> DataFrame:
    """PAIRS that the index leaves after counting."""
    counted = index.where("kind = 3").groupBy("a", "z").agg(F.sum("x").alias("x"), F.max("y").alias("y"), F.sum("w").alias("weight")).where("x >= y").select("a", "z", "weight")
    alive = materialize(counted)
    pairs = index.where("kind = 1").groupBy("a", "b", "z").agg(F.sum("x").alias("x"), F.max("y").alias("y"))
    first, second = (alive.select(F.col("a").alias(c), "z", F.col("weight").alias(f"w{c}")) for c in ("a", "b"))
    pairs = pairs.join(first, ["a", "z"]).join(second, ["b", "z"]).where(F.col("x") + F.least("wa", "wb") >= F.col("y"))
    rows = index.where("kind = 2").select("entry", "a", F.col("entry").bitwiseAND(1).alias("z")).distinct().join(alive, ["a", "z"])
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("hub")).unionByName(hub_pairs(rows))


def next_pairs(found: DataFrame, roots: DataFrame | None) -> DataFrame:
    """PAIRS of nodes in different components that the last round's differences leave."""
    def rooted(df: DataFrame, c: str) -> DataFrame:
        if roots is None:
            return df.withColumn(f"root_{c}", F.col(c))
        return df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))

    pairs = rooted(rooted(found.where("kind = 1").select("a", "b").distinct(), "a"), "b").where("root_a != root_b")
    rows = rooted(found.where("kind = 2").select("entry", "a").distinct(), "a")
    mixed = rows.groupBy("entry").agg(F.min("root_a").alias("least"), F.max("root_a").alias("most")).where("least != most").select("entry")
    rows = materialize(rows.join(mixed, "entry", "left_semi").select("entry", "a"))
    weighed = rows.join(rows.groupBy("a").agg(F.count(F.lit(1)).alias("weight")), "a")
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("hub")).unionByName(hub_pairs(weighed))


def wide_families(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, int]:
    """A table (u) of the hubs whose nodes don't go to one task, by their number or FAMILY_BYTES; and about how many entries those have."""
    size = lambda c, name: texts.select(F.col("node").alias(c), F.col("bytes").alias(name))
    hubs = (
        pairs.where("hub > 0").join(size("v", "own"), "v").join(size("u", "hubs"), "u")
        .groupBy("u").agg(F.min("hub").alias("hub"), F.sum(F.col("own") + F.col("hubs") / 8).alias("weight"), F.sum(F.col("own") + F.col("hubs")).alias("bytes"))
    )
    wide = materialize(hubs.where((F.col("hub") == 1) | (F.col("weight") > FAMILY_BYTES)).select("u", "bytes"))
    # about 6 characters a word, and half of the differences are entries
    return wide, int(wide.agg(F.sum("bytes")).first()[0] or 0) // 12


def link_nodes(pairs: DataFrame, texts: DataFrame, **kind) -> DataFrame | None:
    """(node, root) of all linked nodes, or None. pairs: a table of PAIRS of the first round."""
    roots, level = None, 0
    while True:
        n = pairs.count()
        if not n:
            discard(pairs)
            return roots
        level += 1
        few = FEW * GROWTH ** max(0, level - LATER + 1)
        wide, entries = wide_families(pairs, texts)
        split = pairs.join(wide.select("u", F.lit(True).alias("wide")), "u", "left").select("u", "v", F.when(F.col("wide") & (F.col("hub") > 0), 1).otherwise(F.col("hub")).alias("hub")) if entries else pairs
        found = materialize(compare(split, texts, max(64, n * 20 // PART, entries // PART), few, **kind))
        discard(pairs, wide)
        links = found.where("kind = 4").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if links.head(1):
            if roots is not None:
                links = links.unionByName(roots.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")))
            before, roots = roots, materialize(components(links))
            discard(before)
        if not found.where("kind in (1, 2)").head(1):
            discard(found)
            return roots
        pairs = materialize(next_pairs(found, roots))
        discard(found)


def near_duplicate_components(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """A row for every row of docs: doc_id, text_hash, n_shingles, component_id, root (a node of the
    component, the same for all of it; null without shingles)."""
    text = F.col("text").cast("string")
    chars = docs.agg(F.sum(F.length(text).cast("double"))).first()[0] or 0.0
    # about 6 characters a word, and two schemes' segments
    parts = max(64, int(chars / 6 * 4 * (den - num) / (den + num) / PART))
    index = materialize(index_rows(docs, parts, words, num, den))
    rows = index.where("kind = 0").select(F.col("x").alias("doc_id"), F.col("entry").alias("text_hash"), F.col("y").alias("n_shingles"), F.col("a").alias("node"))
    pairs = materialize(first_pairs(index))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("place"))
    roots = None
    if pairs.head(1):
        needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        place = materialize(nodes.join(needed, "node").select("node", F.col("place.doc_id").alias("d"), F.col("place.text_hash").alias("h")))
        count = place.count()
        keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
        found = F.broadcast(place) if count <= FEW_ROWS else place
        texts = materialize(keyed.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("node", F.col("text").cast("binary").alias("text"), F.octet_length("text").alias("bytes")))
        if texts.count() > count:  # rows that are repeated
            once = materialize(texts.dropDuplicates(["node"]))
            discard(texts)
            texts = once
        discard(place)
        roots = link_nodes(pairs, texts, words=words, num=num, den=den)
        discard(texts)
    labels = nodes.select("node", "least")
    if roots is None:
        labels = labels.select("node", F.col("node").alias("root"), F.col("least").alias("name"))
    else:
        labels = labels.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        names = labels.groupBy("root").agg(F.min("least").alias("name"))
        labels = labels.select("node", "root").join(names, "root")
    return rows.join(labels, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"), "root"
    )


def keep_one(docs: DataFrame, **kind) -> DataFrame:
    """docs with one row of each component (the least doc_id, nulls last, then text hash), all columns;
    rows without shingles all stay, as they are linked with nothing."""
    names = docs.columns
    found = near_duplicate_components(docs, **kind)
    ranked = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = materialize(found.where("root is not null").groupBy("root").agg(F.min(ranked).alias("k")).select("k.doc_id", "k.text_hash"))
    # rows that share doc_id and text with a kept one are equal copies of it
    again = materialize(found.where("root is not null").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    empty = keyed.where(F.coalesce(F.length(F.regexp_replace(F.col("r.text").cast("string"), "[\\x20\\x09-\\x0D]+", "")), F.lit(0)) == 0)
    same = lambda x: keyed.doc_id.eqNullSafe(x.doc_id) & (keyed.text_hash == x.text_hash)
    full = keyed.join(kept, same(kept), "left_semi")
    twice = lambda how: full.join(again, full.doc_id.eqNullSafe(again.doc_id) & (full.text_hash == again.text_hash), how)
    if again.head(1):
        full = twice("left_anti").unionByName(twice("left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return full.select("r.*").unionByName(empty.select("r.*"))


def op8_pigeonhole_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
