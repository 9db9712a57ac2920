import collections
import math
import re
import zlib

import numpy as np

from foliospark.llm import suffix_tree_lm as L


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())) + [b"\n"]


def test_base_scores_are_exact(spark, odd):
    rows = [(i, f"the {'cat' if i % 3 else 'Dog'} sat on w{i % 7} ÄB{i}") for i in range(200)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    known = collections.Counter()
    for r in docs.collect():
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10:
            known.update(tokens(r.text))
    n, v = sum(known.values()), len(known)
    want = sorted((str(r.doc_id), len(t := tokens(r.text)), sum(known[w] > 0 for w in t), n, round(sum(math.log10((known[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for r in docs.collect())
    got = L.score_documents(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)


def test_distributions_sum_to_one(spark):
    tree = L.learn(spark.createDataFrame([(b"the", 50), (b"then", 30), (b"an", 40), (b"\n", 20), (b"ten", 0)], "token binary, c long"))
    assert sum(len(x[0]) for x in tree.levels) > 1
    for context in (b"", b" ", b" t", b" th", b" the", b" x", b" then"):
        code = sum(x << (8 * k) for k, x in enumerate(reversed(context[-L.DEPTH :])))
        p = 10 ** tree.log10(np.full(256, code), np.full(256, min(len(context), L.DEPTH)), np.arange(256))
        assert abs(p.sum() - 1) < 1e-9


def test_contexts_are_counted_and_retained(spark):
    words = spark.createDataFrame([(b"ab", 400), (b"cb", 400), (b"xax", 300), (b"xcy", 300)], "token binary, c long")
    counts = {r.key: r.n for r in L.count_contexts(words).collect()}
    assert counts[ord("b")] == 800 and counts[(2 << 56) | (ord(" ") << 16) | (ord("a") << 8) | ord("b")] == 400
    kept = {r.key >> 8 for r in L.retained(L.count_contexts(words)).collect()}
    assert 0 in kept and (1 << 48) | ord("b") in kept
    # "a" is followed by b or x; only " a" and "xa" tell which
    assert (2 << 48) | (ord("x") << 8) | ord("a") in kept


def test_unseen_words_cost_little_more_than_their_entropy(spark):
    """Words are six of five syllables, so most held-out ones are unseen; log10(5 ** 6) is what a word carries."""
    rng = np.random.default_rng(3)
    parts = ["ka", "lo", "mi", "ren", "to"]
    rows = [(i, " ".join("".join(rng.choice(parts, 6)) for _ in range(30))) for i in range(400)]
    got = L.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").selectExpr("sum(score) s", "sum(n_tokens - 1) n").first()
    assert 6 * math.log10(5) <= -got.s / got.n < 1.2 * 6 * math.log10(5)


def test_the_order_of_words_counts(spark):
    """Words follow one another in a ring; the same words in another order, and by brute force."""
    ring = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(ring[(i + k) % 12] for k in range(40))) for i in range(300)]
    held = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0)
    text = rows[held][1].split()
    rows += [(held, " ".join(text[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.score for r in L.score_documents(docs).where(f"doc_id = {held}").collect())
    assert got[0] < 2 * got[1] and got[1] > -0.5 * len(text)


def test_positions_are_scored_by_the_longest_retained_words(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(250):
        words = ["a", "b"]
        for _ in range(30):
            words.append(str(rng.choice(["a", "b", "c", "d"], p=[0.85, 0.05, 0.05, 0.05] if words[-2:] == ["a", "b"] else [0.1, 0.5, 0.2, 0.2] if words[-1] == "a" else [0.4, 0.2, 0.2, 0.2])))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows + [(250, "a b zz a b")], "doc_id long, text string")
    deepest = 4
    counts = [collections.defaultdict(collections.Counter) for _ in range(deepest + 1)]
    positions = {}
    for i, text in rows + [(250, "a b zz a b")]:
        t = [None] * deepest + tokens(text)
        positions[i] = [(tuple(t[k - deepest : k]), t[k]) for k in range(deepest, len(t))]
        if zlib.crc32(str(i).encode()) % 10:
            for c, w in positions[i]:
                for d in range(deepest + 1):
                    counts[d][c[deepest - d :]][w] += 1
    root = counts[0][()]
    tree = L.learn(spark.createDataFrame([(w, c) for w, c in root.items()], L.TOKENS))
    n, v = sum(root.values()), len(root)
    spelled = {w: 10 ** tree.score([w])[0] for _, w in {p for x in positions.values() for p in x}}

    def retained(c):
        if not c:
            return True
        here, above = counts[len(c)].get(c, {}), counts[len(c) - 1].get(c[1:], {})
        total, k = sum(here.values()), len(here)
        gain = sum(m * math.log(m / total / (above[s] / sum(above.values()))) for s, m in here.items())
        return total and gain * (total - 1) / total > k * (0.5 * math.log(total) + L.NAMING * math.log(n + v)) and retained(c[1:])

    def p(c, w):
        if not c:
            return (root[w] + v * spelled[w]) / (n + v)
        here = counts[len(c)].get(c, {})
        total, k = sum(here.values()), len(here)
        return (here.get(w, 0) + k * p(c[1:], w)) / (total + k) if retained(c) else p(c[1:], w)

    assert retained((b"a",)) and not retained((b"zz",))
    got = {r.doc_id: r.score for r in L.score_documents(docs).collect()}
    assert all(abs(got[i] - sum(math.log10(p(c, w)) for c, w in x)) < 1e-6 for i, x in positions.items())


def test_empty_table(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
