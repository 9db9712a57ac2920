"""Operator 7: benchmark decontamination by suffix arrays over shards of the training documents.

A shard is some whole documents, as bytes. Its words and a hash of each come from array operations over the
bytes, and so do hashes of all runs of as many words as a window. Runs whose hash no window of the benchmark
has can't be an occurrence; the words of the others, numbered by the words of the benchmark (the words
themselves are compared, not their hashes), are the shard's text, with breaks between them. Its suffix array
is sorted by prefix doubling, and test suffixes are binary-searched in it: the range with a suffix's window
gives the hits, the neighbours of its place give the longest verbatim match and where it is. Documents
never leave their task.

Only the benchmark is sent to the tasks, in blocks of at most BLOCK_WORDS words. One block, the usual case,
is one pass without a shuffle; of several, each is a pass whose hits are stored before the next is sent.

Defined cases: null text has no words; an item without words has no windows; an item of fewer words
than a window is one window; repeated items count by distinct item_id, a null item_id is skipped;
repeated documents give a row each; a text longer than a shard is a shard of its own; an empty table on
either side gives rows without hits or no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import caches
from foliospark.session import materialize, ship_package

WINDOW = 10
SHARD_BYTES, CHUNK_BYTES, BYTES_AT_ONCE = 16_000_000, 2_000_000, 1 << 18  # a shard's words are found a chunk at a time
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
HITS = "row long, doc_id long, n_words long, spans binary, items array<string>"


def words(text: str | None) -> list[str]:
    # A to Z only: other upper-case letters stay as they are
    return WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER)) if text else []


class Suffixes:
    """The suffix array of one shard. tokens: numbers from 1, 0 a break."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.append(tokens, 0)
        at = np.flatnonzero(tokens)
        rank = self.tokens.astype(np.int64)
        width, n = 1, len(self.tokens)
        breaks = np.flatnonzero(self.tokens == 0)
        longest = int(np.max(np.diff(np.concatenate([[-1], breaks])), initial=1))  # words between breaks, and the break
        self.run = (breaks[np.searchsorted(breaks, at)] - at) if len(at) else at  # of each suffix up to its break
        order = np.argsort(rank[at], kind="stable")
        while width < longest and len(at):
            # suffixes as pairs of ranks, `width` apart; beyond a break all are equal
            live = self.run > width
            second = np.where(live, rank[np.minimum(at + width, n - 1)], 0)
            order = np.lexsort((second, rank[at]))
            a, b = rank[at][order], second[order]
            new = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            rank = np.zeros(n, np.int64)
            rank[at[order]] = new
            width *= 2
            if new[-1] == len(at):
                break
        self.array, self.runs = at[order], self.run[order]

    def _compare(self, k: int, query: np.ndarray) -> tuple[int, int]:
        """Words in common of suffix k and query, and the sign of suffix - query over query's words."""
        s = self.tokens[self.array[k] : self.array[k] + min(len(query), int(self.runs[k]))]
        q = query[: len(s)]
        differ = np.flatnonzero(s != q)
        if len(differ):
            i = int(differ[0])
            return i, -1 if s[i] < q[i] else 1
        return len(s), -1 if len(s) < len(query) else 0

    def search(self, query: np.ndarray, low: int = 0, high: int | None = None) -> tuple[int, int]:
        """The range of suffixes that start with query."""
        def first(sign: int, low: int, high: int) -> int:
            while low < high:
                mid = (low + high) // 2
                if self._compare(mid, query)[1] < sign:
                    low = mid + 1
                else:
                    high = mid
            return low

        high = len(self.array) if high is None else high
        start = first(0, low, high)
        return start, first(1, start, high)

    def longest(self, query: np.ndarray) -> tuple[int, int]:
        """Words and place of the longest match of a prefix of query."""
        k, _ = self.search(query)
        best = max(((self._compare(j, query)[0], -int(self.array[j])) for j in (k - 1, k) if 0 <= j < len(self.array)), default=(0, 0))
        return best[0], -best[1]


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[str]]]]:
    """Items (id as text, words), some at a time; a longer item is a block of its own."""
    block, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").toLocalIterator():
        w = words(r.t)
        if block and n + len(w) > block_words:
            yield block
            block, n = [], 0
        if w:
            block.append((r.i, w))
            n += len(w)
    yield block


_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
_CLASSES = np.array([c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 0 for c in range(256)], np.uint8)
_POWERS: list[np.ndarray] = []  # of _BASE and its inverse modulo 2 ** 64, of this worker


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, by sums over some whole words at a time."""
    out = (end - start).astype(np.uint64) * _STEP
    bounds = np.unique(np.concatenate([np.searchsorted(start, np.arange(0, len(data), BYTES_AT_ONCE)), [len(start)]])).tolist()
    for i, j in zip(bounds[:-1], bounds[1:]):
        a, b, low = start[i:j] - start[i], end[i:j] - start[i], int(start[i])
        power, inverse = _powers(int(b[-1]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(data[low : low + int(b[-1])] * power[: int(b[-1])])])
        out[i:j] += (total[b] - total[a]) * inverse[a]
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words, by doubling."""
    out, known, width, power = None, words, 1, _STEP
    done, shift = 0, np.uint64(1)
    while n:
        if n & 1:
            size = len(known) - done
            if size <= 0:
                return np.empty(0, np.uint64)
            out = known if out is None else out[:size] + known[done:] * shift
            done, shift = done + width, np.uint64(int(shift) * int(power) & (1 << 64) - 1)
        n >>= 1
        if n:
            if len(known) <= width:
                return np.empty(0, np.uint64)
            known = known[:-width] + known[width:] * power
            width, power = 2 * width, np.uint64(int(power) ** 2 & (1 << 64) - 1)
    return out


class Shard:
    """Words of some texts (UTF-8), as places in bytes."""

    def __init__(self, texts: list[bytes]):
        self.data = _CLASSES[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)] if texts else np.zeros(1, np.uint8)
        is_word = np.concatenate([[False], self.data != 0])
        edge = np.flatnonzero(is_word[1:] != is_word[:-1])
        self.start, self.end = edge[::2], edge[1::2]  # each text ends with a byte that is no word's
        borders = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, borders)  # the first word of each text

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


class Matcher:
    """The benchmark of one block, ready to search shards."""

    def __init__(self, block: list[tuple[str, list[str]]], window: int):
        vocabulary: dict[bytes, int] = {}
        self.vocabulary, self.window = vocabulary, window
        self.suffixes: list[np.ndarray] = []  # test suffixes that start a window, equal windows once
        self.sizes: list[int] = []
        self.items: list[list[str]] = []
        place: dict[tuple[int, ...], int] = {}
        for item, ws in block:
            ids = [vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in ws]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                k = place.setdefault(tuple(ids[i : i + size]), len(self.suffixes))
                if k == len(self.suffixes):
                    self.suffixes.append(np.asarray(ids[i:], np.int64))
                    self.sizes.append(size)
                    self.items.append([])
                self.items[k].append(item)
        self.items = [sorted(set(x)) for x in self.items]
        # the hashes of windows by size, in order, with the windows that have them
        known = Shard([b" ".join(vocabulary)])
        hashes = np.concatenate([[np.uint64(0)], word_hashes(known.data, known.start, known.end)]) if vocabulary else np.zeros(1, np.uint64)
        self.hashes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array(self.sizes, np.int64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            h = np.concatenate([run_hashes(hashes[self.suffixes[k][:size]], size) for k in own.tolist()])
            order = np.argsort(h, kind="stable")
            self.hashes[size] = h[order], own[order]

    def _candidates(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]] | None:
        """Words (numbers, 0 a break) and places of all runs that may be windows, and the windows that they may be."""
        n = len(shard.start)
        if not n or not self.hashes:
            return None
        hashes = word_hashes(shard.data, shard.start, shard.end)
        last = np.repeat(shard.first[1:], np.diff(shard.first))  # the word behind each one's text
        covered, windows = np.zeros(n + 1, np.int32), []
        for size, (known, numbers) in self.hashes.items():
            runs = run_hashes(hashes, size)
            at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            at = np.flatnonzero((known[at] == runs) & (np.arange(len(runs)) + size <= last[: len(runs)]))
            if len(at):
                np.add.at(covered, at, 1)
                np.add.at(covered, at + size, -1)
                found = np.unique(runs[at])
                low, high = np.searchsorted(known, found), np.searchsorted(known, found, side="right")
                windows += [numbers[a:b] for a, b in zip(low, high)]
        if not windows:
            return None
        places = np.flatnonzero(np.cumsum(covered)[:n] > 0)
        get = self.vocabulary.get
        ids = np.fromiter((get(shard.word(i), 0) for i in places.tolist()), np.int64, len(places))
        # a break between words that aren't neighbours, or of two texts
        apart = np.flatnonzero((np.diff(places) > 1) | (last[places][1:] != last[places][:-1])) + 1
        return np.append(np.insert(ids, apart, 0), 0), np.append(np.insert(places, apart, -1), -1), windows

    def occurrences(self, texts: list[bytes]) -> tuple[np.ndarray, Iterator[tuple[int, int, np.ndarray]]]:
        """Where each text's words begin, of all words of the shard; and (window number, its words, its first
        words' places) of every window that occurs in it."""
        first, tokens, places, windows, lot, size = [np.zeros(1, np.int64)], [], [], [], [], 0

        def chunk() -> None:
            shard, before = Shard(lot), int(first[-1][-1])
            first.append(shard.first[1:] + before)
            if found := self._candidates(shard):
                tokens.append(found[0])
                places.append(np.where(found[1] >= 0, found[1] + before, -1))
                windows.extend(found[2])

        for t in texts:
            if lot and size + len(t) > CHUNK_BYTES:
                chunk()
                lot, size = [], 0
            lot.append(t)
            size += len(t)
        if lot:
            chunk()

        def search() -> Iterator[tuple[int, int, np.ndarray]]:
            if windows:
                suffixes, at = Suffixes(np.concatenate(tokens)), np.concatenate(places)
                for k in np.unique(np.concatenate(windows)).tolist():
                    size = self.sizes[k]
                    low, high = suffixes.search(self.suffixes[k][:size])
                    if low < high:
                        yield k, size, at[suffixes.array[low:high]]

        return np.concatenate(first), search()


def _shards(batches: Iterator[pa.RecordBatch], most: int):
    """Some whole rows at a time, texts as UTF-8."""
    rows, n = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            text = row[-1] or b""
            if rows and n + len(text) > most:
                yield rows
                rows, n = [], 0
            rows.append((*row[:-1], text))
            n += len(text) + 1
    if rows:
        yield rows


def find_hits(docs: DataFrame, block: list[tuple[str, list[str]]], window: int = WINDOW) -> DataFrame:
    """Each row of docs (row, doc_id, text): its hit words as (from, to) pairs and the items with windows in it."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only()
        m = Matcher(shared.value, window)
        for rows in _shards(batches, SHARD_BYTES):
            first, found = m.occurrences([r[2] for r in rows])
            change = np.zeros(int(first[-1]) + 1, np.int32)
            items: dict[int, set[str]] = {}
            for k, size, places in found:
                np.add.at(change, places, 1)
                np.add.at(change, places + size, -1)
                for d in np.unique(np.searchsorted(first, places, side="right") - 1).tolist():
                    items.setdefault(d, set()).update(m.items[k])
            hit = (np.cumsum(change) > 0).astype(np.int8)
            spans = [b""] * len(rows)
            for d in items:
                own = hit[first[d] : first[d + 1]]
                spans[d] = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]))).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.binary()), pa.array([sorted(items.get(d, ())) for d in range(len(rows))], pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "spans", "items"],
            )

    return docs.select("row", "doc_id", F.col("text").cast("binary")).mapInArrow(run, HITS)


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each shard and test suffix, the longest verbatim match in it: item_id, item_word (where the
    suffix begins), doc_id, doc_word, n_words. A suffix without a word in the shard gives no row; the
    longest over all shards is a group-by of this."""
    ship_package(docs.sparkSession)
    out = None
    for block in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, 1)
            for rows in _shards(batches, SHARD_BYTES):
                shard = Shard([r[1] for r in rows])
                ids = np.fromiter((m.vocabulary.get(shard.word(i), 0) for i in range(len(shard.start))), np.int64, len(shard.start))
                tokens = np.insert(ids, shard.first[1:], 0)
                starts = shard.first + np.arange(len(shard.first))
                suffixes, found = Suffixes(tokens), []
                for item, ws in shared.value:
                    ids = np.asarray([m.vocabulary[w.encode()] for w in ws], np.int64)
                    for i in range(len(ids)):
                        n, at = suffixes.longest(ids[i:])
                        if n:
                            d = int(np.searchsorted(starts, at, side="right") - 1)
                            found.append((item, i, rows[d][0], at - int(starts[d]), n))
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] + [pa.int64()] * 4)], names=["item_id", "item_word", "doc_id", "doc_word", "n_words"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "item_id string, item_word long, doc_id long, doc_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def _digest(docs_hits: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("doc_id", "n_words", "spans", "items")}
            n_hit = [int((e := np.frombuffer(s, "<i8"))[1::2].sum() - e[::2].sum()) for s in c["spans"]]
            sha = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in c["items"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c["doc_id"], pa.int64()), pa.array(c["n_words"], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in c["items"]], pa.int64()), pa.array(sha), pa.array([x > 0 for x in n_hit])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs_hits.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _merge(rows: pa.Array) -> pa.Array:
    """Lists of spans, as from several blocks, to the spans of their union."""
    out = []
    for spans in rows.to_pylist():
        pairs = np.concatenate([np.frombuffer(s, "<i8").reshape(-1, 2) for s in spans])
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        reach = np.maximum.accumulate(pairs[:, 1])
        new = np.concatenate([[True] * bool(len(pairs)), pairs[1:, 0] > reach[:-1]]).astype(bool)
        last = np.roll(new, -1)  # where a new one begins, the one before ends; the first begins one
        out.append(np.stack([pairs[new, 0], reach[last]], 1).astype("<i8").tobytes())
    return pa.array(out, pa.binary())


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """HITS for every row of docs over all blocks of the benchmark. One block, the usual case, needs
    no shuffle; with more, rows are numbered in a table and their spans are merged by row."""
    blocks = benchmark_blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if second is None:
        return find_hits(rows, first, window)
    rows = materialize(rows)
    every = materialize(find_hits(rows, first, window))
    while second is not None:
        part = materialize(find_hits(rows, second, window).where("size(items) > 0"))
        every, second = every.unionByName(part), next(blocks, None)
    merge = F.arrow_udf(_merge, "binary")
    merged = every.groupBy("row", "doc_id", "n_words").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("row", "doc_id", "n_words", merge("spans").alias("spans"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    return _digest(hits(docs, benchmark, window))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a benchmark window, all columns: a pass for each block of the
    benchmark, without a shuffle. A shard is a batch of rows."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")
    for block in benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            caches.only()
            m = Matcher(shared.value, window)
            for b in batches:
                first, found = m.occurrences([(t or "").encode() for t in b.column(at).to_pylist()])
                clean = np.ones(len(b), bool)
                for _, _, places in found:
                    clean[np.searchsorted(first, places, side="right") - 1] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_suffix_array_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
