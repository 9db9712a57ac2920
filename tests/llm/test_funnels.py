import random
from bisect import bisect_right
from datetime import datetime, timedelta

import pytest

from foliospark.llm import funnels as M

START = datetime(2024, 1, 31, 23, 40)


def brute(rows, funnels=M.FUNNELS, limit=M.LIMIT, percent=90):
    """{(funnel, client): (n1.., deepest, t2.., same_depth)} attempt by attempt."""
    events = {(c, k, t) for c, k, t in rows if None not in (c, k, t)}
    times = {}
    for c, k, t in sorted(events):
        times.setdefault((c, k), []).append(t)

    def after(c, k, t):
        at = times.get((c, k), [])
        i = bisect_right(at, t)
        return at[i] if i < len(at) else None

    micros, out = timedelta(microseconds=1), {}
    for f in funnels:
        for c, k, t in events:
            if k != f.steps[0]:
                continue
            took = out.setdefault((f.name, c), [[] for _ in f.steps])
            took[0].append(0)
            at = t
            for i, kind in enumerate(f.steps[1:], 1):
                there, bad = after(c, kind, at), after(c, f.excluding, at) if f.excluding else None
                if there is None or there > t + limit * micros or (bad is not None and bad <= there):
                    break
                took[i].append((there - at) // micros)
                at = there
    result = {}
    for key, took in out.items():
        rank = [sorted(d)[-(-percent * len(d) // 100) - 1] if d else None for d in took[1:]]
        result[key] = (*map(len, took), sum(1 for d in took if d), *rank)
    depth = [(k[0], v[len(v) // 2]) for k, v in result.items()]
    return {k: (*v, depth.count((k[0], v[len(v) // 2]))) for k, v in result.items()}


def got(df):
    return {(r[0], r[1]): tuple(r)[2:] for r in df.select("funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth").collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "client_id long, kind string, arrived_at timestamp_ntz")


def events(seed, crowded):
    """Clients of few events over days, and one with a crowded half hour: at seconds, then at single microseconds."""
    draw = random.Random(seed)
    kinds = ["view", "click", "purchase", "error", "signup", "other"]
    rows = [(c, draw.choices(kinds, [8, 6, 4, 1, 1, 1])[0], START + timedelta(seconds=draw.randrange(8 * 3600))) for c in range(12) for _ in range(60)]
    for span in (1_800_000_000, 60_000_000, 30_000, 500):
        rows += [(99, draw.choices(kinds, [9, 9, 6, 0.2, 0.2, 1])[0], START + timedelta(microseconds=draw.randrange(span))) for _ in range(crowded)]
    return rows + draw.choices(rows, k=200)


@pytest.mark.parametrize("leaf", [3, 40, 100_000])
def test_equals_brute_force_at_any_crowding(spark, leaf):
    rows = events(leaf, 150)
    assert got(M.funnel_counts(frame(spark, rows), leaf=leaf)) == brute(rows)


def test_leaves_are_bounded_and_hold_each_event_once(spark):
    rows = events(1, 300)
    kinds = ["click", "error", "purchase", "signup", "view"]
    have = M.events_of(frame(spark, rows), kinds).cache()
    leaves = M.leaves_of(have, len(kinds), M.LIMIT, 20).collect()
    assert {r["shift"] for r in leaves} >= {31, 21}
    assert all(sum(map(len, r.own)) <= 20 or r["shift"] == 1 for r in leaves)
    held = sorted((r.client_id, k, t) for r in leaves for k, times in enumerate(r.own) for t in times)
    assert held == sorted(map(tuple, have.collect())) and all(t >> r["shift"] == r.prefix for r in leaves for times in r.own for t in times)


def test_defined_cases(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [
        (1, "view", at(0)), (1, "view", at(0)), (1, "click", at(0)), (1, "click", at(60)), (1, "view", at(1800)), (1, "purchase", at(1801)),  # exactly in time, then late
        (2, "view", at(0)), (2, "error", at(0)), (2, "click", at(5)), (2, "error", at(9)), (2, "view", at(9)),  # excluded at the previous step, then at the next
        (3, "click", at(0)), (3, "click", at(1)), (None, "view", at(0)), (4, None, at(0)), (4, "view", None), (5, "error", at(0)),
    ]
    have = got(M.funnel_counts(frame(spark, rows)))
    assert have == brute(rows)
    assert have["A", 1][:5] == (2, 1, 1, 0, 3) and have["A", 2][:4] == (2, 1, 0, 0) and have["C", 3][:4] == (2, 1, 0, 0)
    assert {c for _, c in have} == {1, 2, 3}
    assert M.funnel_counts(frame(spark, [])).count() == 0
    wide = frame(spark, rows).selectExpr("*", "1 as at", "2 as shift", "3 as prefix", "4 as step", "5 as funnel", "6 as own", "7 as n")
    assert got(M.funnel_counts(wide)) == have


def test_own_definitions(spark):
    """Funnels of other lengths, without an excluded kind, and another limit."""
    rows = events(5, 40)
    mine = (M.Funnel("x", ("view", "view")), M.Funnel("y", ("click", "view", "click", "view", "other"), "error"))
    found = M.reached_steps(frame(spark, rows), mine, limit=90_000_000, leaf=10)
    want = brute(rows, mine, limit=90_000_000)
    have = {}
    for i, step in enumerate(found):
        for r in step.groupBy("funnel", "client_id").count().collect():
            have.setdefault((r[0], r[1]), [0] * 5)[i] = r[2]
    assert have == {k: [*v[: 2 if k[0] == "x" else 5], *[0] * 3][:5] for k, v in want.items()}


def test_percentiles_of_many_durations(spark):
    draw = random.Random(2)
    rows = [(g, draw.randrange(1 << draw.randrange(1, 31)), draw.randrange(1, 4)) for g in (1, 1, 1, 2, 3) for _ in range(400)] + [(7, 5, 1)]
    counts = spark.createDataFrame(rows, "g int, took long, n long").groupBy("g", "took").agg({"n": "sum"}).toDF("g", "took", "n")
    for percent in (1, 50, 90, 100):
        want = {}
        for g in {r[0] for r in rows}:
            all_ = sorted(t for h, t, n in rows for _ in range(n) if h == g)
            want[g] = all_[-(-percent * len(all_) // 100) - 1]
        assert dict(map(tuple, M.ranked_durations(counts, ["g"], percent).collect())) == want
