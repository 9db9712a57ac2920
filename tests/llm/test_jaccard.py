import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import jaccard as J


def brute(rows, words=3, num=9, den=10):
    sets = [J.shingle_set((t or "").encode(), words) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    index = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for j, n in collections.Counter(j for w in x for j in index[w]).items():
            if den * n >= num * (len(x) + len(sets[j]) - n):
                up[root(i)] = root(j)
        for w in x:
            index[w].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def made(seed, n=250):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(n):
        w = r.choices(vocabulary, k=r.choice([0, 1, 2, 3, 5, 9, 10, 11, 12, 13, 15, 20, 25, 30, 50, 80]))
        rows.append("  ".join(w))
        for _ in range(r.randint(0, 3)):
            z = list(w)
            for _ in range(r.randint(0, 3)):
                if z:
                    k = r.randrange(len(z))
                    z[k : k + 1] = r.choice([[], ["x"], [z[k], "y"]])
            rows.append(" ".join(z))
    return list(enumerate(rows))


def crowd(seed, n=220):
    """A text and many copies of it with a few to many changed words: most pairs of copies aren't linked."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for c in range(n):
        z = list(base)
        for k in r.sample(range(len(z)), r.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            z[k] = f"c{c}.{k}" if r.random() < 0.8 else "same"
        rows.append(" ".join(z))
    return list(enumerate(rows))


@pytest.mark.parametrize("rows, kind", [(made(1), {}), (made(2), {"words": 5, "num": 4, "den": 5}), (crowd(3), {}), (crowd(4), {"words": 5, "num": 4, "den": 5})])
def test_components_equal_brute_force(spark, rows, kind):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.near_duplicate_components(docs, **kind).collect()
    want = brute(rows, **kind)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    kept = J.keep_one(docs, **kind)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(int(d) for d, n, c in want if d == c)


def test_pigeonhole_finds_every_linked_pair():
    rng = np.random.default_rng(5)
    bands = J.Bands()
    for _ in range(300):
        n = int(rng.integers(9, 120))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        drop = int(rng.integers(0, 4))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 60, int(rng.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 10 * both >= 9 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
            assert len(np.intersect1d(J.signatures(a, bands)[0], J.signatures(b, bands)[0]))


def test_defined_cases(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = J.near_duplicate_components(odd).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    kept = J.keep_one(odd)
    assert kept.schema.names == odd.schema.names and kept.count() == odd.count() - 1  # one repeated row
    assert J.near_duplicate_components(odd.limit(0)).count() == 0 and J.keep_one(odd.limit(0)).count() == 0


@pytest.mark.xfail(reason="open: 417,465 pairs of 1,500 copies come out for verification")
def test_rows_of_large_families_stay_in_proportion(spark, monkeypatch):
    """Copies of one text with one to ten words of their own: rows out of the index and of each round are
    bounded by the number of copies, not its square."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for c in range(1500):
        z = list(base)
        for k in r.sample(range(len(z)), r.choice([1, 1, 2, 3, 4, 6, 10])):
            z[k] = f"c{c}.{k}"
        texts.append((c, " ".join(z)))
    rows = []
    for name in ("index_rows", "compare"):
        def counted(*a, made=getattr(J, name), **k):
            out = J.materialize(made(*a, **k))
            rows.append(out.count())
            return out

        monkeypatch.setattr(J, name, counted)
    got = J.near_duplicate_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(rows) >= 2 and rows[0] < 60 * len(texts) and all(n < 10 * len(texts) for n in rows[1:])
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute(texts)


def family(seed, n, words=150):
    """Texts that share a line with each other and one of two more lines, so they meet at a hub and aren't linked; each tenth has a near copy."""
    r = random.Random(seed)
    line, more = [f"line{i}" for i in range(words // 3)], [[f"more{k}.{i}" for i in range(words // 5)] for k in range(2)]
    rows = []
    for c in range(n):
        rows.append(" ".join(line + more[c % 2] + [f"own{c}.{i}" for i in range(words // 3)]))
        if c % 10 == 0:
            rows.append(rows[-1] + f" end{c}")
    r.shuffle(rows)
    return list(enumerate(rows))


def test_unlinked_pairs_of_a_family_do_not_come_out(spark, monkeypatch):
    rows, pairs = family(6, 500), []

    def counted(*a, made=J.compare, **k):
        out = J.materialize(made(*a, **k))
        pairs.append(out.where("kind = 1").select("a", "b").distinct().count())
        return out

    monkeypatch.setattr(J, "compare", counted)
    kind = {"words": 5, "num": 4, "den": 5}
    got = J.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), **kind).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, **kind)
    assert sum(pairs) <= 50


@pytest.mark.parametrize("bound", [{"FAMILY": 8}, {"FAMILY_BYTES": 20_000}, {"CELLS": 50, "ROWS": 2}])
def test_families_spread_or_in_small_slices_give_the_same(spark, monkeypatch, bound):
    for name, value in bound.items():
        monkeypatch.setattr(J, name, value)
    rows = [(i, t) for i, (_, t) in enumerate(family(7, 120) + crowd(8, 120))]
    kind = {"words": 5, "num": 4, "den": 5}
    got = J.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), **kind).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, **kind)


def test_memory_of_a_family_does_not_follow_its_pairs():
    rng = np.random.default_rng(9)
    hub, pool = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (300, 600))
    sets = []
    for c in range(1500):
        own = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        sets.append(np.unique(np.concatenate([hub[: 50 + c % 7], pool[rng.random(len(pool)) < 0.2], own])))
    sets += [x[2:] for x in sets[:20]] + [hub[20:150], hub[25:150]]  # the last ones have nothing that the hub lacks
    families = J.Families(1)
    for c, x in enumerate(sets):
        families.add(b"h" * 16, c.to_bytes(16, "big"), len(x), False, *J.family_entries(hub, x))
    (batch,) = families.flush()
    tracemalloc.start()
    found = []
    for out in J.meet(pa.Table.from_batches([batch]), True, 4, 5):
        found += zip((int.from_bytes(x, "big") for x in out.column("a").to_pylist()), (int.from_bytes(x, "big") for x in out.column("b").to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == [(c, 1500 + c) for c in range(20)] + [(1520, 1521)]
    assert peak < 150e6
