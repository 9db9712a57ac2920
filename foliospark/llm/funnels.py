"""Operator 11: ordered funnel counting by a frontier that the funnels' definitions drive.

Definitions are rows (funnel, step, kind, excluded kind). Every event of a funnel's first kind starts an attempt, and
in each round the rows of the next step join the active attempts of all funnels at once. A lookup in bucketed
successors gives an attempt the first event of its next kind and of its excluded kind after where it is; min_by
takes the earlier of the two, the excluded one first if equal. Attempts that advanced in time are written
to the shared folder, which ends their lineage, and go on in the next round until none is left.

Buckets: a client's time is cut at a power of two of microseconds above the time limit, so a successor lies in the
same bucket or the next. Buckets of more than LEAF events are cut into 1,024 parts, those again, down to a
few thousand microseconds. A leaf holds sorted times by kind and, for each kind, the first event in later parts and
buckets; events know their leaf, so a lookup reads one row. No client, however hot, and no moment, however
crowded, makes a row of more than LEAF (or what a few thousand microseconds can hold) times.

Percentiles are exact: distinct durations are counted (combined in the map tasks), summed by parts of 2^16 microseconds,
and only the part with the wanted rank is looked at by single durations.

Defined cases: events without client, kind or time aren't there; equal events are one; an empty table gives no rows;
clients without attempts have no row; excluded events at a step's own time end nothing, at the next one's they do; steps of one
kind need later events each; a duration of the time limit exactly is in time; other columns, whatever their names, are ignored;
long texts don't occur.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import discard, materialize

LIMIT = 30 * 60 * 1_000_000
LEAF = 1024
PART_BITS = 10
DURATION_BITS = 16


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    excluding: str | None = None


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), "error"),
    Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    Funnel("C", ("click", "click", "purchase", "view"), "signup"),
)


def micros(at: Column, kind: str) -> Column:
    """Microseconds since 1970; of a time without a zone by its own calendar, whatever the session's zone is."""
    if kind == "timestamp":
        return F.unix_micros(at)
    day = F.unix_date(at.cast("date")).cast("long") * 86_400_000_000
    return day + (F.hour(at) * 60 + F.minute(at)).cast("long") * 60_000_000 + (F.date_part(F.lit("second"), at) * 1_000_000).cast("long")


def events_of(table: DataFrame, kinds: Sequence[str], client: str = "client_id", kind: str = "kind", at: str = "arrived_at") -> DataFrame:
    """(client_id, kind, at): distinct events of some kinds, kind as its place in kinds and at in microseconds."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind)) - 1
    rows = table.select(F.col(client).alias("client_id"), place.cast("int").alias("kind"), micros(F.col(at), table.schema[at].dataType.simpleString()).alias("at"))
    return rows.where("client_id is not null and kind >= 0 and at is not null").distinct()


def _prefix(shift: Column | int, at: str = "at") -> Column:
    return F.call_function("shiftright", F.col(at), shift if isinstance(shift, Column) else F.lit(shift))


def leaves_of(events: DataFrame, kinds: int, limit: int, leaf: int) -> DataFrame:
    """(client_id, shift, prefix, own): events by leaf, sorted times by kind; prefix is the time without its last shift bits."""
    shifts = list(range(limit.bit_length(), 0, -PART_BITS))
    placed, rest = [], events
    for shift in shifts:
        keyed = rest.withColumn("prefix", _prefix(shift))
        crowded = None
        if shift != shifts[-1]:
            crowded = materialize(keyed.groupBy("client_id", "prefix").count().where(F.col("count") > leaf).select("client_id", "prefix"))
        if crowded is None or crowded.isEmpty():
            placed.append(keyed.withColumn("shift", F.lit(shift)))
            break
        placed.append(keyed.join(crowded, ["client_id", "prefix"], "left_anti").withColumn("shift", F.lit(shift)))
        rest = keyed.join(crowded, ["client_id", "prefix"], "left_semi").drop("prefix")
    rows = reduce(DataFrame.unionByName, placed)
    own = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("at")))) for k in range(kinds)]
    return rows.groupBy("client_id", "shift", "prefix").agg(F.array(*own).alias("own"))


def successors_of(leaves: DataFrame, kinds: int, limit: int) -> DataFrame:
    """leaves with following: for each kind the first event behind the leaf, in its bucket or the next, and that event's
    shift. Parts of a crowded bucket are at most 1,024, so no window has more rows."""
    top = limit.bit_length()
    names = [f"f{k}" for k in range(kinds)]
    firsts = leaves.select("client_id", "shift", "prefix", *[F.when(F.size(F.col("own")[k]) > 0, F.struct(F.col("own")[k][0].alias("at"), F.col("shift"))).alias(n) for k, n in enumerate(names)])
    present = sorted((r[0] for r in leaves.select("shift").distinct().collect()), reverse=True)  # at most four
    found, above = [], None
    for shift in range(top, min(present, default=top) - 1, -PART_BITS):
        below = firsts.where(F.col("shift") <= shift).withColumn("prefix", F.call_function("shiftright", F.col("prefix"), F.lit(shift) - F.col("shift")))
        nodes = below.groupBy("client_id", "prefix").agg(*[F.min(n).alias(n) for n in names], (F.max("shift") == shift).alias("is_leaf"))
        if above is None:
            later = nodes.select("client_id", (F.col("prefix") - 1).alias("prefix"), *[F.col(n).alias(f"g{n}") for n in names])
            nodes = nodes.join(later, ["client_id", "prefix"], "left")
        else:
            siblings = Window.partitionBy("client_id", "parent").orderBy(F.desc("prefix")).rowsBetween(Window.unboundedPreceding, -1)
            nodes = nodes.withColumn("parent", _prefix(PART_BITS, "prefix")).withColumns({f"s{n}": F.min(n).over(siblings) for n in names})
            nodes = nodes.join(above.select("client_id", F.col("prefix").alias("parent"), *[f"g{n}" for n in names]), ["client_id", "parent"], "left")
            nodes = nodes.withColumns({f"g{n}": F.coalesce(f"s{n}", f"g{n}") for n in names})
        found.append(nodes.where("is_leaf").select("client_id", F.lit(shift).alias("shift"), "prefix", F.array(*[f"g{n}" for n in names]).alias("following")))
        above = nodes
    return leaves.join(reduce(DataFrame.unionByName, found), ["client_id", "shift", "prefix"])


def _rules(spark, funnels: Sequence[Funnel], kinds: Sequence[str]) -> DataFrame:
    """(funnel, step, kind, excluded): a row a step, kinds by place, excluded -1 if there is none."""
    rows = [(f.name, i, kinds.index(k), kinds.index(f.excluding) if f.excluding else -1) for f in funnels for i, k in enumerate(f.steps, 1)]
    return F.broadcast(spark.createDataFrame(rows, "funnel string, step int, kind int, excluded int"))


def advance(attempts: DataFrame, rules: DataFrame, successors: DataFrame, limit: int) -> DataFrame:
    """The attempts (funnel, client_id, start, at, shift, step) that reach their next step, there, and the time it took."""
    step = rules.select("funnel", (F.col("step") - 1).alias("step"), F.col("kind").alias("wanted"), "excluded")
    placed = attempts.join(step, ["funnel", "step"]).withColumn("prefix", _prefix(F.col("shift")))
    rows = placed.join(successors, ["client_id", "shift", "prefix"])

    def first(kind: str, turn: int) -> Column:
        """The first event of a kind after the attempt's place, as turn, order and shift."""
        inside = F.array_min(F.filter(F.get("own", F.col(kind)), lambda x: x > F.col("at")))
        behind = F.get("following", F.col(kind))
        return F.struct(F.lit(turn).alias("turn"), (F.coalesce(inside, behind["at"]) * 2 + turn).alias("order"), F.when(inside.isNotNull(), F.col("shift")).otherwise(behind["shift"]).alias("shift"))

    nearest = rows.select("funnel", "step", "client_id", "start", "at", F.explode(F.array(first("excluded", 0), first("wanted", 1))).alias("c"))
    nearest = nearest.where(F.shiftright("c.order", 1) <= F.col("start") + limit)
    taken = nearest.groupBy("funnel", "step", "client_id", "start").agg(
        F.min("at").alias("since"), F.min("c.order").alias("order"), F.min_by("c.turn", "c.order").alias("turn"), F.min_by("c.shift", "c.order").alias("shift")
    )
    at = F.shiftright("order", 1)
    return taken.where("turn = 1").select("funnel", "client_id", "start", at.alias("at"), "shift", (F.col("step") + 1).alias("step"), (at - F.col("since")).alias("took"))


def reached_steps(table: DataFrame, funnels: Sequence[Funnel] = FUNNELS, limit: int = LIMIT, leaf: int = LEAF, **columns: str) -> list[DataFrame]:
    """A table (funnel, client_id, start, at, shift, step, took) for each step of which some attempt reached the one before;
    times in microseconds."""
    spark = table.sparkSession
    kinds = sorted({k for f in funnels for k in (*f.steps, *([f.excluding] if f.excluding else []))})
    events = materialize(events_of(table, kinds, **columns))
    leaves = materialize(leaves_of(events, len(kinds), limit, leaf))
    successors = materialize(successors_of(leaves, len(kinds), limit))
    rules = _rules(spark, funnels, kinds)
    flat = successors.select("client_id", "shift", F.posexplode("own").alias("kind", "times")).select("client_id", "shift", "kind", F.explode("times").alias("at"))
    started = flat.join(rules.where("step = 1"), "kind")
    out = [started.select("funnel", "client_id", F.col("at").alias("start"), "at", "shift", "step", F.lit(None).cast("long").alias("took"))]
    for _ in range(max(len(f.steps) for f in funnels) - 1):
        out.append(materialize(advance(out[-1], rules, successors, limit)))
        if out[-1].isEmpty():
            break
    discard(events, leaves)
    return out


def ranked_durations(counts: DataFrame, groups: list[str], percent: int) -> DataFrame:
    """groups and took: the ceil(percent * n / 100)-th smallest of a group's n durations; counts: (groups, took, n)."""

    def pick(rows: DataFrame, by: str, rank: Column) -> DataFrame:
        ordered = Window.partitionBy(*groups).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("upto", F.sum("n").over(ordered)).withColumn("rank", rank).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))

    parts = counts.withColumn("part", F.shiftright("took", DURATION_BITS))
    sums = parts.groupBy(*groups, "part").agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*groups))
    part = pick(sums, "part", F.floor((percent * whole + 99) / F.lit(100))).select(*groups, "part", (F.col("rank") - F.col("upto") + F.col("n")).alias("left"))
    return pick(parts.join(part, [*groups, "part"]), "took", F.col("left")).select(*groups, "took")


def funnel_counts(table: DataFrame, funnels: Sequence[Funnel] = FUNNELS, limit: int = LIMIT, percent: int = 90, leaf: int = LEAF, **columns: str) -> DataFrame:
    """A row a funnel and client with attempts: n1, ... attempts reaching each step, deepest, t2, ... the percentile of
    the times from the previous step, same_depth."""
    steps = reached_steps(table, funnels, limit, leaf, **columns)
    groups = ["funnel", "client_id", "step"]
    counts = materialize(reduce(DataFrame.unionByName, [s.groupBy(*groups, "took").agg(F.count(F.lit(1)).alias("n")) for s in steps]))
    discard(*steps[1:])
    most = max(len(f.steps) for f in funnels)
    times = ranked_durations(counts.where("step > 1"), groups, percent)
    facts = counts.select(*groups, "n", F.lit(None).cast("long").alias("t")).unionByName(times.select(*groups, F.lit(0).cast("long").alias("n"), F.col("took").alias("t")))
    table = facts.groupBy("funnel", "client_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).cast("long").alias(f"n{k}") for k in range(1, most + 1)],
        F.max("step").alias("deepest"), *[F.max(F.when(F.col("step") == k, F.col("t"))).alias(f"t{k}") for k in range(2, most + 1)],
    )
    depths = table.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))
    return table.join(F.broadcast(depths), ["funnel", "deepest"])  # a row a step of a definition at most


def op11_funnel_frontier(spark, sf_dir: str) -> DataFrame:
    found = funnel_counts(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
    return found.select("funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth")
