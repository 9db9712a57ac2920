"""Operator 6: best-fit packing whose bin counts are certified by dual-feasible-function bounds.

Tokenised documents (ids, then an end id) longer than a sequence are cut into full pieces and a rest.
Pieces are dealt by hash to partitions of a bounded number of pieces; each runs best-fit decreasing and
computes lower bounds of its bin count from dual feasible functions. A partition whose count equals its
bound is certified; one whose count exceeds it has a gap. Partitions with gaps exchange documents: those in
their bins that aren't full are dealt anew to fewer partitions and packed again, and the round stands only if
it saves bins. When partitions with gaps save no more and the count of all bins still exceeds the bound of all
lengths (each certified partition may be a part of a bin short of its bound), all partitions exchange
documents. Rounds end when such a one saves nothing or the bound is met.

Defined cases: null and empty text is the end id alone; equal rows and equal doc_ids are packed
one by one; an empty table gives no rows; ties in length are decided by (doc_id, piece, ids_crc32);
other columns are ignored. Rows of the same doc_id, piece and text are interchangeable.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import caches
from foliospark.session import materialize, ship_package

CAPACITY = 4096
END_ID = 1
PIECES_A_PARTITION = 200_000
WIDER = 4  # times that are in a partition of later rounds
CHUNK = 500_000  # characters of texts encoded at once, or one text
AT_ONCE = 100  # words of letters encoded at once
CACHED_WORDS = 500_000  # of a worker; beyond it the cache starts anew, results stay the same

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, slack long, certified boolean"
# Words are tokenised alone: the tokenizer drops white space and no token spans it. These are letters
# that lower-casing and composition treat one by one, then marks without an apostrophe.
_LATIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)\Z")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes (the byte order here), by a cache of words.

    A word of Latin letters with ASCII marks behind it is two pre-tokens, and its lower-cased letters
    are looked up by themselves; any other word is encoded as it is, and a text with control characters
    that Python takes for white space, or with an added token, is encoded as a whole. Lower-cased letters
    need neither normalizer nor pattern: many are encoded at once, told apart by white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.whole = ["\x1c", "\x1d", "\x1e", "\x1f", *(t for t, _ in _added(self.tokenizer))]

    def __call__(self, text: str) -> bytes:
        return self.encode([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if any(t in text for t in self.whole) else text.split() for text in texts]
        self._learn(set(chain.from_iterable(filter(None, split))))
        get = self.words.__getitem__
        return [
            _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids) if words is None else b"".join(map(get, words))
            for text, words in zip(texts, split)
        ]

    def _learn(self, wanted: set[str]) -> None:
        new = {w for w in wanted if w not in self.words}
        if not new:
            return
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
            new = wanted
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        plain = {w: w.lower() for w in new if w.isalpha() and w.isascii()}
        cut = {w: (m[1].lower(), m[2]) if (m := _LATIN.match(w)) else ("", w) for w in new if w not in plain}
        self._learn_letters([p for p in {*plain.values(), *(a for a, _ in cut.values())} if p and p not in self.parts])
        rest = [p for p in {"", *(b for _, b in cut.values())} if p not in self.parts]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.parts[p] = _bytes(e.ids)
        part = self.parts.__getitem__
        self.words.update(zip(plain, map(part, plain.values())))
        self.words.update({w: part(a) + part(b) for w, (a, b) in cut.items()})

    def _learn_letters(self, new: list[str]) -> None:
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            found = self.letters.encode(" ".join(some), add_special_tokens=False)
            ids, at = _bytes(found.ids), 0
            for p, n in zip(some, np.bincount(found.word_ids, minlength=len(some)).tolist()):
                self.parts[p] = ids[at : at + 4 * n]
                at += 4 * n


_ENCODERS: dict[str, WordEncoder] = {}  # of this worker, from task to task
caches.register(__name__, _ENCODERS.clear)


def encoder(path: str) -> WordEncoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordEncoder(path))


def _added(tokenizer) -> list[tuple[str, int]]:
    return [(t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items()]


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _chunks(keys: list, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    held, of, size = [], [], 0
    for k, t in zip(keys, texts):
        t = t.as_py() or ""
        if held and size + len(t) > CHUNK:
            yield of, held
            held, of, size = [], [], 0
        held.append(t)
        of.append(k)
        size += len(t)
    if held:
        yield of, held


def tokenize_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        caches.only(__name__)
        encode, end = encoder(path or tokenizer_path()).encode, _bytes([end_id])
        for b in batches:
            rows = []
            for docs_, texts in _chunks(b.column(0).to_pylist(), b.column(1)):
                for d, ids in zip(docs_, encode(texts)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of lengths given in decreasing order: (bin, offset in it) of each, and the free room of each bin.

    Open bins are kept by free room, and a bit set of the rooms in use finds the tightest that fits.
    """
    at, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            k, room = len(free), capacity
            free.append(0)
        at[i], offset[i] = k, capacity - room
        room -= n
        free[k] = room
        if room:
            by_room[room].append(k)
            rooms |= 1 << room
    return at, offset, np.asarray(free, np.int64)


def lower_bound(lengths: np.ndarray, counts: np.ndarray | None = None, capacity: int = CAPACITY) -> int:
    """The largest bound on the bin count from three families of dual feasible functions: the identity,
    the thresholds f_k(x) = C if x > C-k, x if k <= x, else 0, and the roundings
    u_m(x) = x if (m+1)x/C is whole, else floor((m+1)x/C) C/m."""
    if counts is None:
        lengths, counts = np.unique(lengths, return_counts=True)
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if not len(lengths):
        return 0
    best = -(-int((lengths * counts).sum()) // capacity)
    for k in np.unique(np.minimum(lengths, capacity - lengths)):
        if 0 < k <= capacity // 2:
            f = np.where(lengths > capacity - k, capacity, np.where(lengths >= k, lengths, 0))
            best = max(best, -(-int((f * counts).sum()) // capacity))
    for m in range(1, 65):
        whole = (m + 1) * lengths % capacity == 0
        # in units of C/m, so that all stays in integers for the rounded ones; whole ones are x m / C
        rounded = np.where(whole, 0, (m + 1) * lengths // capacity)
        total = int((rounded * counts).sum()) * capacity + int((lengths * counts)[whole].sum()) * m
        best = max(best, -(-total // (capacity * m)))
    return best


def _pack_round(pieces: DataFrame, parts: int, level: int, capacity: int) -> DataFrame:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        n = pdf["length"].to_numpy()
        at, offset, free = best_fit(n, capacity)
        pdf["sequence_id"] = (level << 56) + (part << 32) + at
        pdf["offset"], pdf["slack"] = offset, free[at]
        pdf["certified"] = bool(len(free) == lower_bound(n, capacity=capacity))
        return pdf.drop(columns="part")

    cols = [c.split()[0] for c in PIECES.split(", ")]
    dealt = pieces.select(*cols, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(level)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, PACKED)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, a_partition: int = PIECES_A_PARTITION) -> tuple[DataFrame, dict]:
    """pieces with sequence_id, offset, slack and certified, and the figures of the packing.

    The figures come from counts by length (at most `capacity` rows) and counts of bins.
    """
    lengths = pieces.groupBy("length").count().collect()
    n = sum(r["count"] for r in lengths)
    bound = lower_bound([r["length"] for r in lengths], [r["count"] for r in lengths], capacity)
    bins = F.count_if(F.col("offset") == 0)
    packed = materialize(_pack_round(pieces, max(1, -(-n // a_partition)), 0, capacity))
    figures = {"pieces": n, "bound": bound, "rounds": [int(packed.agg(bins).first()[0])]}
    level, gaps = 0, True
    while figures["rounds"][-1] > bound:
        level += 1
        loose = F.col("slack") > 0
        some = loose & ~F.col("certified") if gaps else loose
        open_ = packed.where(some)
        size = open_.agg(F.count(F.lit(1)).alias("n"), bins.alias("bins")).first()
        saved = 0
        if size.bins > 1:
            again = materialize(_pack_round(open_, max(1, -(-size.n // (a_partition * min(WIDER, 2**level)))), level, capacity))
            saved = size.bins - int(again.agg(bins).first()[0])
        if saved > 0:
            packed = packed.where(~some).unionByName(again)
            figures["rounds"].append(figures["rounds"][-1] - saved)
        elif gaps:
            gaps = False
        else:
            break
    figures["bins"] = figures["rounds"][-1]
    return packed, figures


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> tuple[DataFrame, dict]:
    return pack_pieces(materialize(tokenize_pieces(docs, path, capacity)), capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    packed, _ = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
