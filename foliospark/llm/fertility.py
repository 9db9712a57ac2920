"""Operator 12: quality rules by tokeniser fertility, beside plain counts.

Words are encoded by two public vocabularies, one of pieces with byte fallback and one of bytes. A document's
characters per token of either, the share of tokens that fall back to bytes and the entropy of its tokens (in
bits, over that of as many different tokens) are compared with those of its peers: documents of the same
language (or, without one, of the same script) and the same power of two of words. A measure outside of
[lower quartile - WIDTH x spread, upper quartile + WIDTH x spread] rejects. Quartiles are sketches over all documents
that pass the plain rules; peers fewer than PEERS are measured by their language's or script's bands, and where
that has fewer as well nothing is rejected. Measures of all documents are a small table, so texts are read once.

Defined cases: null text has no words; without words all measures are null and base_failed holds; null and
empty languages go by script, which is `none` without letters; repeated rows give a row each; an empty table
gives no rows; texts are whole, however long; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import caches
from foliospark.session import materialize, ship_package

CHUNK = 1_000_000  # bytes of texts measured at once; a longer text is measured alone
PEERS = 100
WIDTH = 4.0
LEAST_WORDS, MOST_REPEATED = 50, 50
SKETCH = 10_000
MOST_BANDS = 50_000  # rows of some ten numbers that are broadcast

#: Characters that count as symbols, and white space between words.
SYMBOLS = "#*$%&|<>"
_SPACES = re.compile("[\x20\x09-\x0d]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")  # what str.split() takes besides
#: First code points of ranges of letters, and their scripts.
SCRIPTS = (
    (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xC0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"),
    (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x1F000, ""), (0x20000, "han"), (0x32000, "other"),
)
_STARTS, _NAMES = np.array([0, *(s for s, _ in SCRIPTS)]), ["", *(n for _, n in SCRIPTS)]

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURES = ("piece_chars", "byte_chars", "fallback", "entropy")
_MEASURED = f"{COUNTS}, script string, {', '.join(f'{m} double' for m in MEASURES)}"
_KINDS = dict(c.split() for c in _MEASURED.split(", "))
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def words_of(text: str) -> list[str]:
    if _OTHER_SPACE.search(text):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


def repeated_words(codes: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """For each text, words in windows of three that occur twice or more in it; codes number the words of all
    texts, and text tells where each is from."""
    if len(codes) < 3:
        return np.zeros(n_texts, np.int64)
    windows, most = text[:-2], int(codes.max()) + 1
    for k in range(3):  # numbered anew each time, so products stay small
        windows = np.unique(windows * most + codes[k : len(codes) - 2 + k], return_inverse=True)[1].ravel()
    inside = text[:-2] == text[2:]  # the others reach into the next text
    again = inside & (np.bincount(windows[inside], minlength=int(windows.max()) + 1)[windows] > 1)
    hit = np.zeros(len(codes), bool)
    for k in range(3):
        hit[k : len(codes) - 2 + k] |= again
    return np.bincount(text[hit], minlength=n_texts)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line and not _SPACES.fullmatch(line)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script of most letters."""
    places = np.searchsorted(_STARTS, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), "right") - 1
    counts: dict[str, int] = {}
    for k, n in enumerate(np.bincount(places, minlength=len(_NAMES))):
        if n and _NAMES[k]:
            counts[_NAMES[k]] = counts.get(_NAMES[k], 0) + int(n)
    return max(counts, key=lambda s: (counts[s], s), default="none")


class Pieces:
    """A vocabulary of pieces: ids of words, one after the other, and how many each has."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        self.falls = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.model.get_piece_size())])

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(words, num_threads=1)
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())), n


class Bytes:
    """A vocabulary of bytes: how many tokens each word has, with a space before it."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for t, i in ranks.items() if t.startswith(b" ")]] = True

    def __call__(self, words: list[str]) -> np.ndarray:
        # No token spans words, and the first of each begins with its space, so one call encodes all of them. Only other
        # kinds of white space at a word's end can take in that space; then words are encoded one by one.
        ids = np.array(self.model.encode_ordinary("".join(" " + w for w in words)), np.int64)
        word = np.cumsum(self.opens[ids]) - 1
        if len(word) and word[-1] == len(words) - 1 and not any(map(_OTHER_SPACE.search, words)):
            return np.bincount(word, minlength=len(words))
        return np.fromiter((len(self.model.encode_ordinary(" " + w)) for w in words), np.int64, len(words))


_MODELS: list = []  # of this worker
caches.register("fertility", _MODELS.clear)


class Measurer:
    """Counts and measures of texts, several at once: each word of a chunk is encoded once."""

    def __init__(self, pieces: str | None = None, bytes_: str | None = None):
        caches.only("fertility")
        if not _MODELS:
            _MODELS.extend((Pieces(pieces), Bytes(bytes_)))
        self.pieces, self.bytes = _MODELS

    def __call__(self, texts: list[str]) -> pd.DataFrame:
        words, n_texts = list(map(words_of, texts)), len(texts)
        n = np.fromiter(map(len, words), np.int64, n_texts)
        text = np.repeat(np.arange(n_texts), n)
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        codes = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, len(text))
        known = list(number)
        ids, n_ids = self.pieces(known)
        of_text = lambda by_word: np.bincount(text, np.asarray(by_word)[codes], n_texts).astype(np.int64) if known else np.zeros(n_texts, np.int64)
        chars = of_text(np.fromiter(map(len, known), np.int64, len(known)))
        n_pieces, n_bytes = of_text(n_ids), of_text(self.bytes(known))
        fell = of_text(np.bincount(np.repeat(np.arange(len(known)), n_ids), self.pieces.falls[ids], len(known)))
        out = {
            "n_words": n, "word_chars": chars, "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts], "n_dup_lines": list(map(duplicate_lines, texts)),
            "n_repeat_words": repeated_words(codes, text, n_texts), "script": list(map(script_of, texts)),
        }
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = self._bits(codes, text, ids, n_ids, n_texts) / np.log2(np.minimum(n_pieces, len(self.pieces.falls)))
            out |= {"piece_chars": chars / n_pieces, "byte_chars": chars / n_bytes, "fallback": fell / n_pieces, "entropy": np.where(n_pieces == 1, 0.0, bits)}
        return pd.DataFrame({c: np.where(n_pieces > 0, v, None) if c in MEASURES else v for c, v in out.items()}).astype(dict.fromkeys(MEASURES, "float64"))

    @staticmethod
    def _bits(codes: np.ndarray, text: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, n_texts: int) -> np.ndarray:
        """Entropy in bits of each text's pieces."""
        most = len(n_ids) or 1
        pairs, times = np.unique(text * most + codes, return_counts=True)
        owner, word = pairs // most, pairs % most
        n = n_ids[word]
        begin = np.cumsum(n_ids) - n_ids
        at = np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        width = int(ids.max(initial=0)) + 1
        found, which = np.unique(np.repeat(owner, n) * width + ids[at], return_inverse=True)
        count = np.bincount(which.ravel(), np.repeat(times, n), len(found))
        owner = found // width
        total = np.bincount(owner, count, n_texts)
        return np.log2(total) - np.bincount(owner, count * np.log2(count), n_texts) / total


def _chunks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, whose last column is text, of CHUNK bytes of text at most, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        yield b.slice(at, end - at)
        at = end


def measure_batches(batches: Iterator[pa.RecordBatch], measure) -> Iterator[pa.RecordBatch]:
    """The columns before the text, counts and measures. A chunk's texts become Python's one chunk at a time, so a task's
    memory follows from CHUNK, not from a batch's or the table's size."""
    for b in batches:
        for c in _chunks(b):
            m = measure([t or "" for t in c.column(c.num_columns - 1).to_pylist()])
            named = {n: c.column(n) for n in c.schema.names[:-1]}
            yield pa.RecordBatch.from_pydict(named | {n: pa.array(m[n], _ARROW[k], from_pandas=True) for n, k in _KINDS.items()})


def measured(docs: DataFrame, pieces: str | None = None, bytes_: str | None = None) -> DataFrame:
    """doc_id, lang, counts, script and measures of every row of docs; the vocabularies are paths."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from measure_batches(batches, Measurer(pieces, bytes_))

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, {_MEASURED}")


def base_failed() -> Column:
    """The plain rules: too few words, or too many that repeat."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def peers() -> list[Column]:
    return [F.coalesce(F.when(F.col("lang") != "", F.col("lang")), F.concat(F.lit("script "), F.col("script"))).alias("peer"), F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int").alias("magnitude")]


def bands(table: DataFrame) -> DataFrame:
    """(peer, magnitude, n_peers, low and high of each measure) of a table of measures; magnitude is null in the bands
    of all sizes. Sketches are combined in the map tasks, so a language with most rows is no hot key."""
    rows = table.where(~F.col("base_failed")).withColumn("magnitude", F.explode(F.array("magnitude", F.lit(None).cast("int"))))
    quartiles = rows.groupBy("peer", "magnitude").agg(F.count(F.lit(1)).alias("n_peers"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], SKETCH).alias(m) for m in MEASURES])
    out = ["peer", "magnitude", "n_peers"]
    for m in MEASURES:
        low, mid, high = (F.get(m, F.lit(i)) for i in range(3))
        spread = F.greatest(high - low, F.abs(mid) * 0.01, F.lit(0.005))  # equal documents leave room as well
        out += [(low - WIDTH * spread).alias(f"low_{m}"), (high + WIDTH * spread).alias(f"high_{m}")]
    return quartiles.where(F.col("n_peers") >= PEERS).select(*out)


def judge(table: DataFrame) -> DataFrame:
    """table with base_failed, kept and reasons: the measures outside of their bands."""
    table = table.withColumn("base_failed", base_failed()).select("*", *peers())
    all_bands = materialize(bands(table))
    # a hot language would go to one task of a shuffled join; few bands go to the rows instead, many are joined by key
    dealt = F.broadcast if all_bands.count() <= MOST_BANDS else lambda t: t
    own = all_bands.where("magnitude is not null")
    wide = all_bands.where("magnitude is null").drop("magnitude")
    wide = wide.select("peer", *[F.col(c).alias(f"wide_{c}") for c in wide.columns if c != "peer"])
    found = table.join(dealt(own), ["peer", "magnitude"], "left").join(dealt(wide), "peer", "left")
    outside = [F.when((F.col(m) < F.coalesce(f"low_{m}", f"wide_low_{m}")) | (F.col(m) > F.coalesce(f"high_{m}", f"wide_high_{m}")), m) for m in MEASURES]
    judged = found.withColumn("reasons", F.array_compact(F.array(*outside)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).select(*table.columns, "reasons", "kept")


def op12_tokeniser_fertility(spark, sf_dir: str) -> DataFrame:
    table = materialize(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    return judge(table).select("doc_id", *counts, "base_failed", "kept", "script", *MEASURES, "reasons")
