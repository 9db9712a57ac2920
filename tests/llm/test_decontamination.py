import collections
import hashlib
import random

import numpy as np
import pytest

from foliospark.llm import decontamination as D


def brute(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = D.words(t)
        n = min(D.WINDOW, len(w))
        if n and i is not None:
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = D.words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (s := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= s
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    vocabulary = "ab cd Ef gh ij kl Äm no pq rs".split()
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(25)] + [(3, "repeated item here"), (None, "ab cd"), (40, None), (41, "")]
    docs = []
    for i in range(60):
        w = r.choices(vocabulary + ["zz"], k=r.randint(0, 40))
        if i % 3 == 0:
            w[5:5] = (r.choice(items)[1] or "").split()
        docs.append((i, ", ".join(w)))
    return docs + docs[:2], items


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_hits_equal_brute_force(spark, texts, odd, monkeypatch, block_words):
    monkeypatch.setattr(D.benchmark_blocks, "__defaults__", (block_words,))
    docs, items = texts
    b = spark.createDataFrame([i + ("z",) for i in items], "item_id long, text string, row string")
    every = odd.select("doc_id", "text", "row").unionByName(spark.createDataFrame([d + ("z",) for d in docs], "doc_id long, text string, row string"))
    rows = [(r.doc_id, r.text) for r in every.collect()]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(every, b).collect())
    want = brute(rows, items)
    assert got == want
    kept = D.remove_contaminated(every, b)
    assert kept.schema == every.schema and sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def test_empty_tables(spark, texts):
    docs = spark.createDataFrame(texts[0], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).where("contaminated").count() == 0 and D.contamination(docs, none).count() == len(texts[0])
    assert D.contamination(docs.limit(0), spark.createDataFrame(texts[1], "item_id long, text string")).count() == 0


def test_suffix_array_is_sorted_and_complete():
    tokens = np.array([1, 2, 1, 2, 3, 0, 1, 2, 0, 0, 2, 2, 2, 2])
    s = D.Suffixes(tokens)
    runs = {int(a): tuple(tokens[a : a + r]) for a, r in zip(s.array, s.runs)}
    assert sorted(runs) == np.flatnonzero(tokens).tolist()
    assert [runs[a] for a in s.array.tolist()] == sorted(runs.values())
    assert s.search(np.array([2, 2])) == (len([r for r in runs.values() if r < (2, 2)]), len([r for r in runs.values() if r < (2, 3) and r[:2] <= (2, 2)]))
    assert s.longest(np.array([1, 2, 3, 3]))[0] == 3


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "b c q")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c z")], "item_id long, text string")
    got = {r.item_word: r for r in D.longest_matches(docs.coalesce(1), items).collect()}
    assert (got[0].doc_id, got[0].doc_word, got[0].n_words) == (1, 1, 3) and 3 not in got
