"""Operator 13: fill-in-middle by an Aho-Corasick scan for events.

Units are words with the white space before them, and white space at the end. One automaton finds, in one
scan over a text's code points, all ASCII characters of white space, where the class of characters changes,
and the sentinels. Between two neighbouring events of white space lie either nothing or one whole unit, so
the number of units is a count of gaps wider than one, and the end of the k-th unit is the event after the
k-th such gap: only events are held, never units. Two ranks drawn from the hash of doc_id give prefix, middle
and suffix.

Defined cases: null text is empty; empty texts, and those that hold a sentinel, stay plain; a null doc_id
hashes ``42:`` alone; rows stand for themselves, so repeated rows and doc_ids give a row each; an empty table
gives no rows; texts are whole, however long; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship_package

#: White space between words, and the marks of prefix, suffix and middle.
SPACE = "\t\n\x0b\x0c\r "
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_NAMES, _KINDS = ("n", "form", "prefix_chars", "middle_chars", "output"), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def automaton():
    """All events, valued 0 for white space and 1 for a sentinel."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in [*((c, 0) for c in SPACE), *((m, 1) for m in (PREFIX, SUFFIX, MIDDLE))]:
        out.add_word(word, kind)
    out.make_automaton()
    return out


class Ranks:
    """Units of a text by their rank, from its events."""

    def __init__(self, events, text: str):
        at, kind = np.fromiter(chain.from_iterable(events.iter(text)), np.int64).reshape(-1, 2).T
        self.marked = bool(kind.any())
        space = at[kind == 0]
        edges = np.concatenate(([-1], space, [len(text)]))
        self.ends = edges[1:][np.diff(edges) > 1]  # of the words, in order
        self.length = len(text)
        self.n = len(self.ends) + int(len(space) > 0 and space[-1] == len(text) - 1)

    def end(self, k: int) -> int:
        """Code points in the first k units."""
        return 0 if k == 0 else self.length if k == self.n else int(self.ends[k - 1])


def hashes(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits from the hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for every row of docs: rate of 100 texts are
    transformed, and spm_rate of 100 of those have the suffix in front."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = automaton()
        for b in batches:
            rows = []
            for text, h1, h2, h3, h4 in zip(*(b.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4")), strict=True):
                ranks = Ranks(events, text)
                if not text or ranks.marked or h3 % 100 >= rate:
                    rows.append((ranks.n, "plain", None, None, text))
                    continue
                low, high = map(ranks.end, sorted((h1 % (ranks.n + 1), h2 % (ranks.n + 1))))
                prefix, middle, suffix = text[:low], text[low:high], text[high:]
                if h4 % 100 < spm_rate:
                    rows.append((ranks.n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                else:
                    rows.append((ranks.n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _KINDS, strict=True)] if rows else [pa.array([], t) for t in _KINDS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *_NAMES])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("doc_id"), seed), 1)])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that transform() had, from its output and form alone: no piece holds a sentinel, so the first
    one of each kind is where pieces meet."""

    def between(opening: str, closing: str) -> Column:
        rest = F.substring(output, F.locate(opening, output) + len(opening), F.char_length(output))
        return F.substring_index(rest, closing, 1) if closing else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, ""), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, ""), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_event_scan_fill_middle(spark, sf_dir: str) -> DataFrame:
    done = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
