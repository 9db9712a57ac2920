"""Identifier sets: distinct ids, universes, pending work, batches and the latest record of an id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import materialize


def column_at(df: DataFrame, ordinal: int, name: str = "id") -> DataFrame:
    """One column by its place."""
    return df.select(df[df.columns[ordinal]].alias(name))


def distinct_ids(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """Distinct values; null is a value."""
    return df.select(F.col(column).alias(name)).distinct()


def nonempty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def universe(*ids: DataFrame) -> DataFrame:
    """Distinct values over several one-column frames of one type."""
    return reduce(DataFrame.unionByName, ids).distinct()


def universe_count(*ids: DataFrame) -> DataFrame:
    """n_ids; null counts as a value."""
    return universe(*ids).agg(F.count(F.lit(1)).alias("n_ids"))


def first_ids(ids: DataFrame, column: str, limit: int) -> DataFrame:
    """The first `limit` ids in order; 0 means all."""
    return ids.orderBy(column).limit(limit) if limit else ids


def pending(ids: DataFrame, done: DataFrame, column: str, limit: int = 0, limit_after_resume: bool = False) -> DataFrame:
    """Ids that aren't done. The limit applies to all ids, or to those left with limit_after_resume.
    Spark broadcasts the done side itself where statistics show that it is small."""
    done = done.select(column).distinct()
    if limit_after_resume:
        return first_ids(ids.join(done, column, "left_anti"), column, limit)
    return first_ids(ids, column, limit).join(done, column, "left_anti")


def retry(notes: DataFrame, status: str = "status") -> DataFrame:
    """Of earlier results those that are done for good: errors are tried again."""
    return notes.where(F.col(status) != "error")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last record of each key, as repeated writes of one file leave it. By aggregation with a
    map-side combine, so a key with many records isn't sorted in one task."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """batch_no of fixed-size batches in total order, of keys of any type that has one. Rows are dealt by ranges
    of the key (and of a hash, so that equal keys spread) to as many tasks as a shuffle has; numbers within a
    task and the tasks' counts give row numbers, so no task sees all rows. The dealt rows are a table, as both need the same ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    dealt = materialize(keyed.repartitionByRange(parts, order, "__tie").sortWithinPartitions(order, "__tie").withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)  # such an id is the task, and the row in it in 33 bits
    counts = dealt.groupBy(part.alias("__part")).count()
    before = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = dealt.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row a task
    number = F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)
    return numbered.withColumn("batch_no", F.floor(number / size).cast("long")).drop("__part", "__before", "__id", "__tie")


def multiplicity(mapping: DataFrame, gene: str, model: str, prediction: str) -> DataFrame:
    """Genes with several curated models (splice variants), with their numbers of models and predictions."""
    counts = mapping.groupBy(gene).agg(F.count_distinct(model).alias("n_models"), F.count_distinct(prediction).alias("n_preds"))
    return counts.where(F.col("n_models") > 1)


def multiplicity_classes(mapping: DataFrame, gene: str, model: str, prediction: str) -> DataFrame:
    """Genes with several curated models (splice variants) or several predictions (merged genes), or both, with
    their numbers and the classes. Nulls count as no model and no prediction."""
    counts = mapping.groupBy(gene).agg(F.count_distinct(model).alias("n_models"), F.count_distinct(prediction).alias("n_preds"))
    marked = counts.select("*", (F.col("n_models") > 1).alias("splice_variant"), (F.col("n_preds") > 1).alias("merged_gene"))
    return marked.where("splice_variant or merged_gene")
