"""Operator 4: language-model scores by a probabilistic suffix tree.

A text is its words (bytes, ASCII lower-cased) and one end. Each position (a word or the end) is predicted
from the words before it. The tree grows level by level: contexts of one word, then of one word more
before each retained context, text starts included, until a level adds none; nothing else bounds its depth
or the number of its states. A context is retained where its next-word distribution diverges from that of the
context one word shorter by more than its symbols cost: (N - 1) * KL > k * (SLACK / 2 * ln N + NAMING * ln(n + v))
for N occurrences and k symbols, where ln(n + v) names a symbol among n tokens of v kinds and one
occurrence tells nothing. Distributions are
smoothed into that of the next shorter state (Witten and Bell), so a position is scored by the longest
retained suffix of the words before it.

The state without words is the distribution over training tokens, smoothed into their spelling with as much
weight for that as there are distinct tokens, so frequent words are scored as words and unseen ones by how
they are spelled. Spelling is a second suffix tree, over bytes: it predicts the next byte of a word, its
terminator (a space) or, at a word's start, the end of the text (a newline) from up to DEPTH bytes before
it, back to the space before the word, counted over all training tokens (each distinct token once, weighted),
retained where N * KL > SLACK * k/2 * ln N and smoothed alike, down to the uniform distribution, so every text has a probability.

Counts cover all training documents. Texts are read once, into coded blocks that all steps take. N-grams are
sent in packed blocks by their context, so one shuffle a level brings each context's successors together.
One-word contexts that can't pass the test, with the counts of the TOP tokens and bounds for others, end there;
deeper ones, sent only behind retained contexts and with the distribution above, are tested there. Blocks ask for
their tokens' counts by key and are scored with the answers and the tree, which comes in slices of SLICE rows, of
which a task holds one at a time. The byte tree is held whole; its contexts lie within words of DEPTH bytes, so
they become ever fewer new ones as the corpus grows.
Words and contexts are keyed by 64-bit hashes.

Defined cases: null or empty text is the end alone; a null doc_id is a training row; repeated rows
count and score one by one; very long texts are whole blocks; an empty table gives no rows; without training
rows the tree is uniform; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import discard, drop_dead_shuffles, materialize, ship_package

DEPTH = 4
SLACK, NAMING = 1.0, 0.6
TOP = 1_000_000  # most frequent tokens, whose counts prune bigrams where they meet
PART = 1_000_000  # bigrams in a part of their shuffle, about
SLICE = 1_000_000  # rows of the tree that a task holds at once, about
BLOCK_WORDS, BLOCK_DOCS = 2_500_000, 60_000
CHUNK = 100_000  # distinct tokens worked on at once
CHUNK_BYTES = 4_000_000
END = b"\n"
ROOT = np.uint64(0x2545F4914F6CDD1D)  # the context without words, in hashes

TOKENS = "token binary, c long"
CODED = f"{TOKENS}, block long, data binary"
PARTS = "part long, data binary"
GRAMS = "context long, word long, symbol long, n long"
LEVEL = "context long, word long, symbol long, total long, log_q double, lp double, change double, back double"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two 64-bit numbers, in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


def symbol_of(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


class Contexts:
    """Contexts of the positions of some texts, one word longer with each step."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        self.symbols, self.depth = symbols, 0
        self.at = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def longer(self, places: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The contexts at places, one word longer than those given; 0 stands before a text."""
        self.depth += 1
        before = np.where(self.at[places] >= self.depth, self.symbols[np.maximum(places - self.depth, 0)], np.uint64(0))
        return _mix(contexts, before)


def code(docs: DataFrame) -> DataFrame:
    """CODED: texts read once. For each block a row of coded documents, and a row (token, c) for each of its
    tokens with the count in training documents."""
    ship_package(docs.sparkSession)

    def rows_of(block: int, docs: list, vocabulary: dict, ids: list[np.ndarray]) -> pa.RecordBatch:
        every, sizes = np.concatenate(ids), np.array([len(x) for x in ids])
        c = np.bincount(every, _learned(docs, ids), len(vocabulary)).astype(np.int64)
        head = [
            np.array([len(docs), len(every), len(vocabulary)], "<u8").tobytes(), np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes(),
            np.array([(d is None) * 2 + bool(h) for d, h in docs], "<u1").tobytes(), sizes.astype("<u4").tobytes(),
            np.ascontiguousarray(every.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), symbol_of(list(vocabulary)).tobytes(),
        ]
        raw = b"".join(head)
        data = len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)
        n = len(vocabulary)
        return pa.RecordBatch.from_arrays(
            [pa.array([*vocabulary, None], pa.binary()), pa.array([*c.tolist(), None], pa.int64()), pa.array([None] * n + [block], pa.int64()), pa.array([None] * n + [data], pa.binary())],
            names=["token", "c", "block", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        state: list = [[], None, [], 0]

        def fresh() -> None:
            state[:] = [[], defaultdict(), [], 0]
            state[1].default_factory = state[1].__len__

        fresh()
        for b in batches:
            for d, held, text in zip(*(c.to_pylist() for c in b.columns)):
                words = text.lower().split() if text else []
                words.append(END)
                if state[0] and (state[3] + len(words) > BLOCK_WORDS or len(state[0]) >= BLOCK_DOCS):
                    yield rows_of(block, *state[:3])
                    block += 1
                    fresh()
                state[0].append((d, held))
                state[2].append(np.fromiter(map(state[1].__getitem__, words), np.int32, len(words)))
                state[3] += len(words)
        if state[0]:
            yield rows_of(block, *state[:3])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, CODED)


class Block:
    """Some coded documents: their doc_ids and flags (1 held out, 2 no doc_id), sizes in tokens, the tokens as
    numbers in the block's vocabulary, and the vocabulary's symbols."""

    def __init__(self, data: bytes):
        raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        d, n, v = np.frombuffer(raw, "<u8", 3).tolist()
        at = 24
        self.doc_ids, at = np.frombuffer(raw, "<i8", d, at), at + 8 * d
        self.flags, at = np.frombuffer(raw, "<u1", d, at), at + d
        self.sizes, at = np.frombuffer(raw, "<u4", d, at).astype(np.int64), at + 4 * d
        self.ids, at = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel().astype(np.int64), at + 4 * n
        self.names = np.frombuffer(raw, "<u8", v, at)

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of one word, of what stands before a text, then of the vocabulary, and each position's one as a number."""
        first = _mix(np.full(len(self.names) + 1, ROOT), np.concatenate([[np.uint64(0)], self.names]))
        before = np.concatenate([[0], self.ids[:-1] + 1])
        before[np.cumsum(self.sizes) - self.sizes] = 0
        return first, before

    def training(self) -> np.ndarray:
        """The places of training documents' tokens."""
        return np.flatnonzero(np.repeat((self.flags & 1) == 0, self.sizes))


def _blocks(coded: DataFrame, rows_of, schema: str) -> DataFrame:
    """rows_of(block number, Block) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist()):
                yield rows_of(number, Block(data))

    return coded.where("block is not null").select("block", "data").mapInArrow(run, schema)


def _learned(docs: list, ids: list[np.ndarray]) -> np.ndarray:
    """1 for each position of a training document."""
    return np.repeat(np.array([not h for _, h in docs]).astype(np.int64), [len(x) for x in ids])


def _numbers(data: np.ndarray) -> bytes:
    """Numbers by planes of bytes, which compress where they are alike."""
    return np.ascontiguousarray(data.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _packed(parts: int, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows, in order of their first column, a context, cut by it in parts: the parts' numbers and data."""
    context = columns[0]
    bound = np.searchsorted(((context >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1)).tolist()
    part, data = [], []
    for p, (a, b) in enumerate(zip(bound[:-1], bound[1:])):
        if a < b:
            raw = np.array([b - a], "<u8").tobytes() + _numbers(np.diff(context[a:b], prepend=np.uint64(0))) + b"".join(_numbers(c[a:b]) for c in columns[1:])
            part.append(p)
            data.append(len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True))
    return part, data


def _merged(table: pa.Table, k: int) -> list[np.ndarray]:
    """The k columns of a part's rows, of all blocks, by context and symbol, which are the first two; the third, counts, summed."""
    columns: list[list[np.ndarray]] = [[] for _ in range(k)]
    for blob in table.column("data").to_pylist():
        raw = pa.decompress(blob[4:], decompressed_size=int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)
        size = int(np.frombuffer(raw, "<u8", 1)[0])
        for i, out in enumerate(columns):
            x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, 8 + 8 * size * i).reshape(8, size).T).view("<u8").ravel()
            out.append(x if i else np.cumsum(x))
    context, symbol, n, *others = map(np.concatenate, columns)
    order = np.lexsort((symbol, context))
    context, symbol = context[order], symbol[order]
    edge = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])]))
    return [context[edge], symbol[edge], np.add.reduceat(n[order].astype(np.int64), edge), *(x[order[edge]] for x in others)]


def _sizes(context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's context as a number, and each context's first row, occurrences and symbols."""
    new = np.concatenate([[True], context[1:] != context[:-1]])
    start = np.flatnonzero(new)
    return np.cumsum(new) - 1, start, np.add.reduceat(n, start), np.diff(np.append(start, len(n)))


def _passes(gain: np.ndarray, total: np.ndarray, kinds: np.ndarray, naming: float) -> np.ndarray:
    """The divergence test, by an upper bound of each context's gain."""
    return gain * (total - 1) / total > kinds * (SLACK * 0.5 * np.log(total) + naming) - 1e-6


def bigrams(coded: DataFrame, parts: int) -> DataFrame:
    """(part, data): the bigrams of each block's training documents with their counts, packed, by context."""

    def rows(_, block: Block) -> pa.RecordBatch:
        names = block.names
        first, before = block.before()
        learn = block.training()
        before, here = before[learn], block.ids[learn]
        # numbered in order of the hashes, so that one sort leaves both in order
        order, place = (np.argsort(first), np.argsort(names)), [np.empty(len(x), np.int64) for x in (first, names)]
        for x, o in zip(place, order):
            x[o] = np.arange(len(o))
        keys, n = np.unique(place[0][before] * len(names) + place[1][here], return_counts=True)
        part, data = _packed(parts, first[order[0]][keys // len(names)], names[order[1]][keys % len(names)], n)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])

    return _blocks(coded, rows, PARTS)


def first_grams(coded: DataFrame, rated: DataFrame, n: int, v: int) -> DataFrame:
    """GRAMS of one-word contexts that may pass the test."""
    top = rated.where("c > 0").select("symbol", "c").orderBy(F.desc("c"), "symbol").limit(TOP).toArrow()
    names = top.column("symbol").to_numpy().view(np.uint64)
    order = np.argsort(names)
    shared = coded.sparkSession.sparkContext.broadcast((names[order], top.column("c").to_numpy()[order]))
    naming = NAMING * float(np.log(n + v))

    def meet(table: pa.Table) -> pa.Table:
        context, symbol, times = _merged(table, 3)
        of, start, total, kinds = _sizes(context, times)
        known, counts = shared.value
        at = np.minimum(np.searchsorted(known, symbol), max(len(known) - 1, 0))
        least = np.where(known[at] == symbol, counts[at], times)  # a token occurs as often as the bigram at least
        gain = np.add.reduceat(times * (np.log(times / total[of]) - np.log(least / n)), start)
        kept = _passes(gain, total, kinds, naming)[of]
        context = pa.array(context[kept].view(np.int64))
        return pa.table({"context": context, "word": context, "symbol": pa.array(symbol[kept].view(np.int64)), "n": pa.array(times[kept])})

    return bigrams(coded, max(64, n // 2 // PART)).groupBy("part").applyInArrow(meet, GRAMS)


def _find(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted in known numbers, -1 where there is none."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


class Level:
    """States and grams of contexts of one length: sorted keys with values."""

    def __init__(self, table: pa.Table):
        is_state = table.column("symbol").is_null().to_numpy()
        context, value, lp = (table.column(c).to_numpy() for c in ("context", "value", "lp"))
        context = context.view(np.uint64)
        symbol = table.column("symbol").fill_null(0).to_numpy().view(np.uint64)
        order = np.argsort(context[is_state])
        self.states, self.back = context[is_state][order], value[is_state][order].astype(np.float32)
        self.grams = _mix(context[~is_state], symbol[~is_state])
        order = np.argsort(self.grams)
        self.grams, value, lp = self.grams[order], value[~is_state][order], lp[~is_state][order]
        growing = len(lp) > 0 and not np.isnan(lp[0])
        self.change = value.astype(np.float32)
        self.log_q, self.lp = (value, lp) if growing else (None, None)


class Slice:
    """A part of the tree, all contexts that extend some words, by length."""

    def __init__(self, table: pa.Table, depth: int):
        self.levels = [Level(table.filter(pc.equal(table.column("depth"), d))) for d in range(1, depth + 1)]

    def walk(self, contexts: Contexts, first: np.ndarray, before: np.ndarray, state: np.ndarray) -> Iterator[tuple[Level, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level, the places in a retained state, with their contexts, its number and the context of
        one word. first: contexts of one word, state: their numbers in this slice or -1, before: each place's one."""
        places = np.flatnonzero(state[before] >= 0)
        words, state = first[before[places]], state[before[places]]
        longer, contexts.depth = words, 1
        for depth, level in enumerate(self.levels, 1):
            if depth > 1:
                longer = contexts.longer(places, longer)
                state = _find(level.states, longer)
                some = state >= 0
                places, longer, words, state = places[some], longer[some], words[some], state[some]
            yield level, places, longer, state, words


class Tree:
    """The retained contexts, to be held by tasks a slice at a time."""

    def __init__(self, table: DataFrame, depth: int):
        """table: depth, word, context, symbol (null: the state itself), value, lp (null but while the tree grows)."""
        self.depth, n = depth, table.count()
        self.number = 1 << max(0, -(-n // SLICE) - 1).bit_length()
        columns = ["depth", "context", "symbol", "value", "lp"]
        table = materialize(table.withColumn("slice", F.col("word").bitwiseAND(self.number - 1)).select("slice", *columns))
        sc = table.sparkSession.sparkContext
        self.slices = []
        for i in range(self.number):
            part = Slice(table.where(F.col("slice") == i).select(*columns).toArrow(), depth)
            self.slices.append(sc.broadcast(part))
            del part
            pa.default_memory_pool().release_unused()
        discard(table)

    def destroy(self) -> None:
        for x in self.slices:
            x.destroy()

    def walk(self, block: Block, symbols: np.ndarray) -> Iterator[Iterator]:
        """Each slice's walk over the positions of a block."""
        contexts = Contexts(symbols, block.sizes)
        first, before = block.before()
        own = first & np.uint64(self.number - 1)
        for i, x in enumerate(self.slices):
            mine = np.flatnonzero(own == i)
            state = np.full(len(first), -1)
            state[mine] = _find(x.value.levels[0].states, first[mine])
            yield x.value.walk(contexts, first, before, state)
            if self.number > 1:
                x._value = None
                del x._value  # it is read again from the worker's disk

    def changes(self, block: Block) -> np.ndarray:
        """What the retained contexts add to the log10 probability of each position."""
        symbols = block.names[block.ids]
        out = np.zeros(len(symbols))
        for levels in self.walk(block, symbols):
            for level, places, context, state, _ in levels:
                gram = _find(level.grams, _mix(context, symbols[places]))
                out[places] += np.where(gram >= 0, level.change[gram] if len(level.change) else 0.0, level.back[state])
        return out


def next_level(coded: DataFrame, tree: Tree, occurrences: int, naming: float) -> DataFrame:
    """LEVEL of the contexts one word longer than the tree's deepest that pass the test. occurrences: of the deepest, in all."""
    parts = max(64, occurrences // 2 // PART)

    def rows(_, block: Block) -> pa.RecordBatch:
        part, data = [], []
        symbols = block.names[block.ids]
        learn = np.repeat((block.flags & 1) == 0, block.sizes)
        for levels in tree.walk(block, symbols):
            *_, (level, places, context, _, word) = levels
            some = learn[places]
            if some.any():
                contexts = Contexts(symbols, block.sizes)
                contexts.depth = tree.depth
                places, context, word = places[some], context[some], word[some]
                longer, symbol = contexts.longer(places, context), symbols[places]
                order = np.lexsort((symbol, longer))
                edge = np.flatnonzero(np.concatenate([[True], (np.diff(longer[order]) != 0) | (np.diff(symbol[order]) != 0)]))
                at, n = order[edge], np.diff(np.append(edge, len(order)))
                gram = _find(level.grams, _mix(context[at], symbol[at]))
                for out, x in zip((part, data), _packed(parts, longer[at], symbol[at], n, word[at], level.log_q[gram].view("<u8"), level.lp[gram].view("<u8"))):
                    out += x
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(data, pa.binary())], names=["part", "data"])

    def meet(table: pa.Table) -> pa.Table:
        context, symbol, times, word, log_q0, lp0 = _merged(table, 6)
        log_q0, lp0 = log_q0.view("<f8"), lp0.view("<f8")
        of, start, total, kinds = _sizes(context, times)
        log_q = np.log(times / total[of])
        kept = _passes(np.add.reduceat(times * (log_q - log_q0), start), total, kinds, naming)[of]
        context, word, symbol, times, log_q, lp0, of = (x[kept] for x in (context, word, symbol, times, log_q, lp0, of))
        total, kinds = total[of], kinds[of]
        lp = np.log10((times + kinds * 10**lp0) / (total + kinds))
        columns = [context.view(np.int64), word.view(np.int64), symbol.view(np.int64), total, log_q, lp, lp - lp0, np.log10(kinds / (total + kinds))]
        return pa.table(dict(zip((c.split()[0] for c in LEVEL.split(", ")), map(pa.array, columns))))

    return _blocks(coded, rows, PARTS).groupBy("part").applyInArrow(meet, LEVEL)


def first_level(entries: DataFrame, rated: DataFrame, n: int, naming: float) -> DataFrame:
    """entries: GRAMS; rated: the root's symbols with c and lp. LEVEL of the contexts that pass the divergence test: their
    grams with log_q (the log of the symbol's share), lp, change (lp less that of the context above) and back (the
    change of symbols never seen there)."""
    above = rated.where("c > 0").select("symbol", F.log(F.col("c") / F.lit(float(max(n, 1)))).alias("log_q0"), F.col("lp").alias("lp0"))
    n = F.col("n").cast("double")
    rows = entries.join(above, "symbol")
    # a hot context's rows aren't gathered: sums by context, then a join
    sums = rows.groupBy("context").agg(F.sum(n).alias("total"), F.count(F.lit(1)).cast("double").alias("k"), F.sum(n * (F.log(n) - F.col("log_q0"))).alias("part"))
    kept = sums.where((F.col("part") - F.col("total") * F.log("total")) * (F.col("total") - 1) / F.col("total") > F.col("k") * (SLACK * 0.5 * F.log("total") + naming)).select("context", "total", "k")
    return (
        rows.join(kept, "context")
        .withColumn("log_q", F.log(n / F.col("total")))
        .withColumn("lp", F.log10((n + F.col("k") * F.pow(F.lit(10.0), "lp0")) / (F.col("total") + F.col("k"))))
        .select("context", "word", "symbol", F.col("total").cast("long").alias("total"), "log_q", "lp", (F.col("lp") - F.col("lp0")).alias("change"), F.log10(F.col("k") / (F.col("total") + F.col("k"))).alias("back"))
    )


class Symbols:
    """Every symbol of some tokens (with terminators) with the bytes before it."""

    def __init__(self, tokens: list[bytes]):
        size = np.array([0 if t == END else len(t) + 1 for t in tokens])
        data = np.frombuffer(b" " + b"".join([t + b" " for t in tokens if t != END]), np.uint8).astype(np.int64)
        self.of = np.repeat(np.arange(len(tokens)), size)
        begin = np.cumsum(size) - size
        at = np.arange(1, len(data))
        self.known = np.minimum(at - begin[self.of], DEPTH) if len(at) else at  # bytes of context within the word
        self.symbol = data[1:]
        self.context = np.zeros(len(at), np.int64)
        for k in range(1, DEPTH + 1):
            prior = data[np.maximum(at - k, 0)] << (8 * (k - 1))
            self.context |= np.where(self.known >= k, prior, 0)
        ends = np.array([i for i, t in enumerate(tokens) if t == END], np.int64)
        if len(ends):
            self.of = np.concatenate([self.of, ends])
            self.known = np.concatenate([self.known, np.ones(len(ends), np.int64)])
            self.symbol = np.concatenate([self.symbol, np.full(len(ends), END[0])])
            self.context = np.concatenate([self.context, np.full(len(ends), 32)])


def _mask(d: int) -> int:
    return (1 << (8 * d)) - 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Tokens and counts, a bounded number of tokens and bytes at once."""
    for b in batches:
        tokens, counts = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
        at = n = 0
        for i, t in enumerate(tokens):
            n += len(t)
            if n > CHUNK_BYTES or i - at >= CHUNK:
                yield tokens[at : i + 1], counts[at : i + 1]
                at, n = i + 1, 0
        if at < len(tokens):
            yield tokens[at:], counts[at:]


def count_contexts(tokens: DataFrame) -> DataFrame:
    """tokens (token, c) to (key, n): how often each symbol follows each context of 0 to DEPTH bytes.
    key: the context's length, its bytes, the symbol, in 8, 48 and 8 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts in _chunks(batches):
            s = Symbols(words)
            weight = counts[s.of]
            for d in range(DEPTH + 1):
                deep = s.known >= d
                key = ((s.context[deep] & _mask(d)) << 8) | s.symbol[deep]
                order = np.argsort(key)
                key, w = key[order], weight[deep][order]
                if len(key):
                    edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(key[edge] | (d << 56)), pa.array(np.add.reduceat(w, edge))], names=["key", "n"])

    return tokens.where("c > 0").select("token", "c").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def retained(counts: DataFrame, slack: float = SLACK) -> DataFrame:
    """(key, n) of the root and the contexts that pass the divergence test."""
    table = materialize(counts.withColumn("node", F.shiftright("key", 8)).withColumn("symbol", F.col("key").bitwiseAND(255)))
    depth = F.shiftright("node", 48)
    sizes = table.groupBy("node").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    masks = F.element_at(F.array(*[F.lit(_mask(d)).cast("long") for d in range(DEPTH)]), depth.cast("int"))
    child = (
        table.join(sizes, "node").where("node > 0")
        .withColumn("above", F.shiftleft(depth - 1, 48).bitwiseOR(F.col("node").bitwiseAND(masks)))
    )
    above = table.join(sizes, "node").select(F.col("node").alias("above"), "symbol", F.log(F.col("n") / F.col("total")).alias("log_q"))
    gain = (
        child.join(above, ["above", "symbol"])
        .groupBy("node", "total", "k").agg(F.sum(F.col("n") * (F.log(F.col("n") / F.col("total")) - F.col("log_q"))).alias("gain"))
        .where(F.col("gain") > slack * 0.5 * F.col("k") * F.log("total"))
    )
    best = gain.select("node").unionByName(counts.sparkSession.range(1).select(F.col("id").alias("node")))
    return table.join(best, "node").select("key", "n")


class SuffixTree:
    """Retained contexts by length, in arrays: sorted contexts with back-off logs, sorted (context, symbol) with logs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        keys, counts = np.asarray(keys, np.int64)[order], np.asarray(counts, np.float64)[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for d in range(DEPTH + 1):
            own = (keys >> 56) == d
            entry, n = keys[own] & ((1 << 56) - 1), counts[own]
            context = entry >> 8
            nodes, first = np.unique(context, return_index=True)
            if d == 0 and not len(nodes):
                nodes, first = np.zeros(1, np.int64), np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else np.zeros(len(nodes))
            kinds = np.maximum(np.diff(np.concatenate([first, [len(n)]])), 1) if len(first) else np.ones(len(nodes))
            back = kinds / (total + kinds)
            of = np.searchsorted(nodes, context)
            shorter = 10 ** self.log10(context & _mask(max(d - 1, 0)), np.full(len(entry), d - 1), entry & 255) if d else np.full(len(entry), 1 / 256)
            self.levels.append((nodes, np.log10(back), entry, np.log10((n + kinds[of] * shorter) / (total[of] + kinds[of]))))

    def log10(self, context: np.ndarray, known: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after the `known` last bytes of its context."""
        out = np.zeros(len(context))
        todo = np.arange(len(context))
        for d in range(len(self.levels) - 1, -1, -1):
            nodes, back, entries, logs = self.levels[d]
            some = todo[known[todo] >= d]
            if not len(nodes) or not len(some):
                continue
            c = context[some] & _mask(d)
            k = np.minimum(np.searchsorted(nodes, c), len(nodes) - 1)
            is_state = nodes[k] == c
            some, c, k = some[is_state], c[is_state], k[is_state]
            entry = (c << 8) | symbol[some]
            e = np.minimum(np.searchsorted(entries, entry), max(len(entries) - 1, 0))
            hit = entries[e] == entry if len(entries) else np.zeros(len(entry), bool)
            out[some[hit]] += logs[e[hit]]
            out[some[~hit]] += back[k[~hit]]
            done = np.zeros(len(context), bool)
            done[some[hit]] = True
            todo = todo[~done[todo]]
        out[todo] += -np.log10(256)  # past the root
        return out

    def score(self, tokens: list[bytes]) -> np.ndarray:
        s = Symbols(tokens)
        return np.bincount(s.of, self.log10(s.context, s.known, s.symbol), len(tokens))


def learn(tokens: DataFrame) -> SuffixTree:
    table = retained(count_contexts(tokens)).toArrow()
    return SuffixTree(table.column("key").to_numpy(), table.column("n").to_numpy())


def tree_of(levels: list[DataFrame], growing: bool) -> Tree:
    """The tree of LEVEL for each length; while it grows, the states and the distributions of the last length."""
    rows = []
    for d, x in enumerate(levels, 1):
        depth, none = F.lit(d).alias("depth"), F.lit(None)
        rows.append(x.select(depth, "word", "context", none.cast("long").alias("symbol"), F.col("back").alias("value"), none.cast("double").alias("lp")).distinct())
        if not growing:
            rows.append(x.select(depth, "word", "context", "symbol", F.col("change").alias("value"), none.cast("double").alias("lp")))
    if growing:
        rows.append(x.select(depth, "word", "context", "symbol", F.col("log_q").alias("value"), "lp"))
    return Tree(reduce(DataFrame.unionByName, rows), len(levels))


def grow(coded: DataFrame, rated: DataFrame, n: int, v: int) -> Tree | None:
    """The tree of retained contexts, level by level until none is retained."""
    naming = NAMING * float(np.log(max(n + v, 1)))
    entries = materialize(first_grams(coded, rated, n, v))
    drop_dead_shuffles(coded.sparkSession)
    levels, tree = [materialize(first_level(entries, rated, n, naming))], None
    discard(entries)
    while True:
        if tree:
            tree.destroy()
        drop_dead_shuffles(coded.sparkSession)
        occurrences = levels[-1].select("context", "total").distinct().agg(F.sum("total")).first()[0]
        if not occurrences:
            break
        tree = tree_of(levels, growing=True)
        levels.append(materialize(next_level(coded, tree, int(occurrences), naming)))
    whole = tree_of(levels[:-1], growing=False) if len(levels) > 1 else None
    discard(*levels)
    return whole


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    coded = materialize(code(docs))
    tokens = materialize(coded.where("token is not null").groupBy("token").agg(F.sum("c").alias("c")))
    size = tokens.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(size.n), int(size.v)
    shared = spark.sparkContext.broadcast(learn(tokens))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts in _chunks(batches):
            spelled = shared.value.score(words)
            lp = np.where(counts > 0, np.log10((counts + v * 10**spelled) / max(n + v, 1)), spelled + (np.log10(v / (n + v)) if n else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(symbol_of(words).view(np.int64)), pa.array(counts), pa.array(lp)], names=["symbol", "c", "lp"])

    rated = materialize(tokens.mapInArrow(rate, "symbol long, c long, lp double"))
    discard(tokens)
    tree = grow(coded, rated, n, v) if n else None
    drop_dead_shuffles(spark)

    def ask(number: int, block: Block) -> pa.RecordBatch:
        names = block.names.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), number)), pa.array(np.arange(len(names), dtype=np.int32))], names=["symbol", "block", "at"])

    def total(coded: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(coded.column("data")[0].as_py())
        at = answers.column("at").to_numpy()
        c, lp = np.zeros(len(block.names)), np.zeros(len(block.names))
        c[at], lp[at] = answers.column("c").to_numpy(), answers.column("lp").to_numpy()
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        start = np.cumsum(block.sizes) - block.sizes  # every text has a token, its end
        known, base, score = (np.add.reduceat(x[block.ids], start) for x in ((c > 0).astype(np.int64), base, lp))
        if tree:
            score += np.add.reduceat(tree.changes(block), start)
        return pa.table({
            "doc_id": pa.array(block.doc_ids, pa.int64(), mask=block.flags >= 2), "held_out": pa.array((block.flags & 1).astype(bool)),
            "n_tokens": pa.array(block.sizes), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(start), n, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
        })

    asked = _blocks(coded, ask, "symbol long, block long, at int")
    answers = asked.join(rated, "symbol").select("block", "at", "c", "lp")
    return coded.where("block is not null").select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, SCORES)


def op4_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
