"""Operator 5: language identification by compression with a raw-content dictionary for each language.

For each language a dictionary is the lower-cased text of training documents, up to DICTIONARY bytes.
A text is encoded in blocks of BLOCK characters with every dictionary; the language with the smallest
total wins. The margin is 1 - smallest / second smallest; below NARROW the operator rejects
(`rejected`, and `lang` is `und`), while lang_pred still names the best guess.

The training sample is bounded: rows of the languages with the smallest hashes, about ROWS of each,
at most PIECE characters of each row. That is what goes to the driver and, as dictionaries, to the
tasks. The texts to classify are read whole, in one pass without a shuffle.

Defined cases: null text or text without a letter is `und` with score 0; equal sizes go to the
language with more training rows, then by name; with one language only the score is 1; without
training rows all are `und`; repeated rows give a row each; null and empty lang isn't learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship_package

DICTIONARY = 110_000
ROWS, PIECE = 200, 4_000
BLOCK = 4_000
LEVEL = 7
NARROW = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn_dictionaries(docs: DataFrame, rows: int = ROWS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionaries by language, the languages with most training rows first."""
    train = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & (F.coalesce("lang", F.lit("")) != ""))
    counts = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    order = sorted(counts, key=lambda g: (-counts[g], g))
    if not order:
        return {}
    share = F.create_map(*[F.lit(x) for g in order for x in (g, min(1.0, rows / counts[g]))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    picked = (
        train.withColumn("place", place).where(F.col("place") < share[F.col("lang")] * 1_000_003)
        .select("lang", "place", F.lower(F.substring("text", 1, PIECE)).alias("text")).collect()
    )
    out: dict[str, bytes] = {}
    for g in order:
        pieces = [r.text for r in sorted((r for r in picked if r.lang == g), key=lambda r: (r.place, r.text))]
        # The nearest history is the cheapest to refer to, so a surplus is cut off at the front.
        out[g] = "\n".join(pieces).encode()[-size:] or b" "
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.encoders = []
        for lang, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.encoders.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Best language and margin."""
        if not text or not self.encoders or not _LETTER.search(text):
            return UNKNOWN, 0.0
        low = text.lower()
        blocks = [low[i : i + BLOCK].encode() for i in range(0, len(low), BLOCK)]
        sizes = [(sum(len(e.compress(b)) for b in blocks), k) for k, (_, e) in enumerate(self.encoders)]
        sizes.sort()
        margin = 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]
        return self.encoders[sizes[0][1]][0], margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, lang for every row of docs."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for b in batches:
            found = [classify(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([g for g, _ in found], pa.string()), pa.array([m for _, m in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return (
        docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
        .withColumn("rejected", F.col("score") < narrow)
        .withColumn("lang", F.when(F.col("rejected"), UNKNOWN).otherwise(F.col("lang_pred")))
    )


def op5_compression_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn_dictionaries(docs)).drop("lang")
