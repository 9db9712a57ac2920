"""Operator 10: reproducible sharding by a Feistel permutation with cycle walking.

Law ``rows``: with N rows numbered 0..N-1 in the order of (doc_id, text_crc32, size), nulls first,
row i goes to p = walk(i), a permutation of 0..N-1, and p gives shard = p % shards and
slot = p // shards. Shard counts are at most one apart and slots have no gaps, whatever the skew.
All of it is DataFrame functions; the row numbers need no single-task window and no collect of rows:
rows fall into ordered buckets (split points of doc_id; a doc_id that fills several buckets, or a
null one, is cut once more by crc32), bucket counts give offsets, a window numbers each bucket.

Defined cases: null text has size 1 and crc32 0; an empty table gives no rows; equal rows are
interchangeable, so they are counted, numbered as a run and expanded again; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
ROWS_A_BUCKET = 50_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
CHUNK = 65_536
SUB_BITS = 26  # a hot doc_id is cut by the upper 6 bits of crc32


def feistel(x: Column, n: int, seed: int) -> Column:
    """x in 0..n-1 to its place in a permutation of 0..n-1.

    The domain is a x b >= n with a = ceil(sqrt n), so less than a places lie beyond n. Halves (l, r)
    are changed in turn by keyed additions modulo a or b; places beyond n are permuted again (cycle
    walking). A walk can't be longer than the number of places beyond n; 64 steps are laid out at most
    (for n > 4096, a longer walk has a chance below n ** -31), and a walk that doesn't end is an error.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    steps = min(a * b - n, 64)
    key = F.lit(seed).cast("long")

    def once(v: Column) -> Column:
        halves = F.struct(F.floor(v / F.lit(float(b))).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r"))
        if n >= 1 << 52:  # doubles aren't exact there
            halves = F.struct(((v - F.pmod(v, F.lit(b))) / F.lit(b)).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r"))

        def turn(s: Column, k: Column) -> Column:
            left = F.struct(F.pmod(s.l + F.pmod(F.xxhash64(s.r, key, k), F.lit(a)), F.lit(a)).cast("long").alias("l"), s.r.alias("r"))
            right = F.struct(s.l.alias("l"), F.pmod(s.r + F.pmod(F.xxhash64(s.l, key, k), F.lit(b)), F.lit(b)).cast("long").alias("r"))
            return F.when(k % 2 == 0, left).otherwise(right)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: (s.l * F.lit(b) + s.r).cast("long"))

    walked = F.aggregate(
        F.sequence(F.lit(0), F.lit(steps)),
        x.cast("long"),
        lambda v, i: F.when((i > 0) & (v < F.lit(n)), v).otherwise(once(v)),
    )
    return F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("the cycle walk did not end; use another seed")).cast("long"))


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, row_number) for every row, and the number of rows."""
    base = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    n = docs.select("doc_id").count()
    if n == 0:
        return base.withColumn("row_number", F.lit(0).cast("long")), 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, n // ROWS_A_BUCKET))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("p")).first().p or []
    points = sorted(set(cuts))
    hot = sorted({c for c in points if cuts.count(c) > 1})
    points_col, hot_col = (F.array(*[F.lit(v) for v in x]).cast("array<bigint>") for x in (points, hot))
    is_hot = F.array_contains(hot_col, F.col("doc_id")) if hot else F.lit(False)
    # how many points lie below, by binary search: steps of falling powers of two
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(points).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(points_col, n + step - 1) < F.col("doc_id"), n + step).otherwise(n)) if points else F.lit(0)
    sub = F.shiftright("text_crc32", SUB_BITS).cast("int")
    grouped = (
        base.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(2 * below + is_hot.cast("int")))
        .withColumn("sub", F.when(F.col("doc_id").isNull() | is_hot, sub).otherwise(0))
    )
    counts = grouped.groupBy("bucket", "sub").agg(F.sum("n").alias("n"))
    # One row a bucket: at most 2 * 4096 * 64 rows of three numbers, whatever the input.
    ordered = Window.orderBy("bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "sub", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "sub").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        grouped.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), ["bucket", "sub"])
        .select("doc_id", "size", "text_crc32", "n", (F.col("before") + F.col("offset")).alias("first"))
    )
    parts = runs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    low = F.col("first") + F.col("part") * CHUNK
    high = F.least(low + CHUNK - 1, F.col("first") + F.col("n") - 1)
    return parts.select("doc_id", "size", "text_crc32", F.explode(F.sequence(low, high)).alias("row_number")), n


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20_240_607) -> DataFrame:
    """One row a row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number."""
    rows, n = numbered(docs)
    return (
        rows.withColumn("place", feistel(F.col("row_number"), n, seed))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
            F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
            ((F.col("place") - F.pmod("place", F.lit(shards))) / shards).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "row_number",
        )
    )


def op10_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
