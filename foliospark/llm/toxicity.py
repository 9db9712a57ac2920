"""Operator 1: toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words, their starts of 4 and 5 letters and marks stripped off
(the starts catch families of inflected words), each once a text, hashed by crc32 into BINS. From the
labelled training rows the FEATURES bins with the largest chi-square against the label become the
inputs, and with them all of the PAIRED most frequent bins that tell only in pairs: two that occur together
have a chi-square over the sum of their own by more than PAIR. The machine has a weight for each and a vector of FACTORS numbers for each, whose dot products
weigh the pairs that occur together (an insult with a group's mention, say) where the sum of single
weights can't.

The training sample is bounded: of each label at most SAMPLE rows, those with the smallest hash of
their doc_id and text, which is all of them in small tables. Hashed terms of these rows (and not texts)
go to the driver, at most 2 * SAMPLE * MOST_TERMS integers in blocks of arrays. The model is (FEATURES + PAIRED) * (1 + FACTORS)
numbers at most whatever the input, and is what the scoring tasks get. Scoring reads every whole text.

Defined cases: a null or empty text is scored by the bias alone; rows without a doc_id or with a null
or other label than 0 and 1 aren't learned from; a doc_id labelled more than once is learned from once
for each distinct label; with labels of one kind only or none, the score is that share (or 0.0);
repeated documents give a row each; other columns are ignored or, in the filter, kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import caches
from foliospark.session import ship_package

BINS = 1 << 20
FEATURES = 4096
PAIRED, PAIR = 4096, 40.0  # about one pair in 4e9 passes by chance
FACTORS = 4
SAMPLE = 6_000
MOST_TERMS = 4_000  # of a training row: the driver's bound; longer rows keep the smallest bins of a fixed hash
CACHED_WORDS = 150_000
EPOCHS, RATE, L2, BATCH, SEED = 20, 0.3, 1e-5, 64, 11
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")


def held_out(doc_id: Column, mod: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


_BINS: dict[str, tuple[int, ...]] = {}  # of this worker, by word
caches.register(__name__, _BINS.clear)


def term_bins(text: str | None) -> set[int]:
    """The bins of a text's terms."""
    out: set[int] = set()
    if not text:
        return out
    if len(_BINS) > CACHED_WORDS:
        _BINS.clear()
    for word in set(text.lower().split()):
        bins = _BINS.get(word)
        if bins is None:
            w = _STRIP.sub("", word)
            terms = {"w" + w, *(("p" + w[:n]) for n in (4, 5) if len(w) > n)} if w else ()
            bins = _BINS[word] = tuple(zlib.crc32(t.encode()) % BINS for t in terms)
        out.update(bins)
    return out


@dataclass
class Machine:
    """score(bins) = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the inputs among bins."""

    bins: np.ndarray  # of the inputs, increasing
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: arrays of input numbers."""
        n = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.bias)
        if n.sum():
            x = np.concatenate(rows).astype(np.int64)
            of = np.repeat(np.arange(len(rows)), n)
            v = self.factors[x]
            sums = np.stack([np.bincount(of, v[:, k], len(rows)) for k in range(v.shape[1])], 1)
            out += np.bincount(of, self.weights[x], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(of, (v**2).sum(1), len(rows)))
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def _chi(a: np.ndarray, seen: np.ndarray, n: int, pos: float) -> np.ndarray:
    """Chi-square against the label of what is seen in so many rows, a of them toxic."""
    b = seen - a
    c, d = pos - a, (n - pos) - b
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * pos * (n - pos)))


def paired_bins(rows: list[np.ndarray], y: np.ndarray, seen: np.ndarray, chi: np.ndarray) -> np.ndarray:
    """The frequent bins that tell with another one what neither tells alone."""
    often = np.argsort(-seen, kind="stable")[:PAIRED]
    often = often[seen[often] >= 2]
    number = np.full(BINS, -1)
    number[often] = np.arange(len(often))
    own, tells = chi[often], np.zeros(len(often), bool)
    for at in range(0, len(often), 512):
        # a block of rows at a time, so that memory doesn't follow the sample
        both, bad = (np.zeros((min(512, len(often) - at), len(often)), np.float32) for _ in range(2))
        for low in range(0, len(rows), 512):
            some = rows[low : low + 512]
            x = np.zeros((len(some), len(often)), np.float32)
            for i, r in enumerate(some):
                k = number[r]
                x[i, k[k >= 0]] = 1
            both += x[:, at : at + 512].T @ x
            x = x[y[low : low + 512] > 0]
            bad += x[:, at : at + 512].T @ x
        more = _chi(bad.astype(float), both.astype(float), len(y), y.sum()) - own[at : at + 512, None] - own
        more[np.arange(len(more)), at + np.arange(len(more))] = 0
        tells[at : at + 512] |= (more > PAIR).any(1)
    return often[tells]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> Machine:
    """AdaGrad on the logistic loss over rows of distinct bins."""
    y = np.asarray(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        odds = -30.0 if share == 0 else 30.0
        return Machine(np.empty(0, np.int64), odds, np.empty(0), np.empty((0, FACTORS)))
    seen, toxic = np.zeros(BINS), np.zeros(BINS)
    for r, label in zip(rows, y):
        seen[r] += 1
        toxic[r] += label
    n, pos = len(y), y.sum()
    chi = _chi(toxic, seen, n, pos)
    pairs = paired_bins(rows, y, seen, chi)
    chi[seen < 2] = 0
    top = np.argsort(-chi, kind="stable")[:FEATURES]
    bins = np.union1d(top[chi[top] > 10], pairs)  # about one input in 600 passes by chance
    number = np.full(BINS, -1)
    number[bins] = np.arange(len(bins))
    rows = [(x := number[r])[x >= 0] for r in rows]
    rng = np.random.default_rng(seed)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))  # both labels weigh the same, as in a full sample
    m = Machine(bins, 0.0, np.zeros(len(bins)), rng.normal(0, 0.01, (len(bins), FACTORS)))
    gw, gv, gb = np.full(len(bins), 1e-6), np.full((len(bins), FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            part = [rows[i] for i in at]
            size = np.array([len(r) for r in part])
            error = (m.score(part) - y[at]) * weight[at]
            g = error.mean()
            gb += g * g
            m.bias -= RATE * g / np.sqrt(gb)
            if not size.sum():
                continue
            x = np.concatenate(part)
            of = np.repeat(np.arange(len(part)), size)
            used, inverse = np.unique(x, return_inverse=True)
            # gradients of long rows are as large as those of short ones
            e = (error / np.sqrt(np.maximum(size, 1)))[of] / len(part)
            v = m.factors[x]
            sums = np.stack([np.bincount(of, v[:, k], len(part)) for k in range(FACTORS)], 1)
            dw = np.bincount(inverse, e, len(used)) + L2 * m.weights[used]
            dv = np.stack([np.bincount(inverse, e * (sums[of, k] - v[:, k]), len(used)) for k in range(FACTORS)], 1) + L2 * m.factors[used]
            gw[used] += dw**2
            gv[used] += dv**2
            m.weights[used] -= RATE * dw / np.sqrt(gw[used])
            m.factors[used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
    return m


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on the labelled rows of docs that aren't held out."""
    ship_package(docs.sparkSession)
    truth = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    )
    # the rows to learn from: the smallest hashes of each label, a bounded top-k
    chosen = [r for y in (0, 1) for r in truth.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not chosen:
        return fit([], np.empty(0))
    ids = docs.sparkSession.createDataFrame(chosen, truth.schema)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only(__name__)
        for b in batches:
            rows = [sorted(term_bins(t), key=lambda k: (k * 2_654_435_761 % (1 << 32)))[:MOST_TERMS] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(rows, pa.list_(pa.int32()))], names=["y", "bins"])

    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")
    data = known.select("y", "text").mapInArrow(terms, "y int, bins array<int>").toArrow()
    y = data.column("y").to_numpy()
    rows = [np.asarray(x, np.int32) for x in data.column("bins").to_numpy()]
    del data
    order = sorted(range(len(rows)), key=lambda i: (int(y[i]), zlib.crc32(rows[i].tobytes())))  # whatever order tasks end in
    return fit([rows[i] for i in order], y[order])


def score_texts(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; then every column of docs in the struct `row`."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only(__name__)
        m = shared.value
        number = dict(zip(m.bins.tolist(), range(len(m.bins))))
        for b in batches:
            rows = [np.fromiter((number[k] for k in term_bins(t) if k in number), np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(m.score(rows))], names=["doc_id", "held_out", "score"])

    return (
        docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def keep_clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs with a score under 0.5, all columns, in one pass and without a shuffle."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only(__name__)
        m = shared.value
        number = dict(zip(m.bins.tolist(), range(len(m.bins))))
        at = docs_columns.index("text")
        for b in batches:
            rows = [np.fromiter((number[k] for k in term_bins(t) if k in number), np.int64) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(m.score(rows) < 0.5))

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)


def op1_factorization_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
