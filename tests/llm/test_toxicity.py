import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import toxicity as X

LABELS = "doc_id long, quality int, toxic int"


def test_interactions_are_learned():
    """Two harmless terms are toxic only together: weights alone can't tell, pairs can."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.unique(np.concatenate([[10] if a else [11], [20] if b else [21], rng.integers(100, 160, 8)])).astype(int))
        y.append(int(a == b))
    m = X.fit(rows, np.array(y))
    m2 = X.Machine(np.array([10, 11, 20, 21]), 0.0, np.zeros(4), np.array([[1.0], [-1], [1], [-1]]))
    assert (m2.score([np.array([0, 2])]) > 0.5).all() and (m2.score([np.array([0, 3])]) < 0.5).all()
    assert np.isfinite(m.weights).all()


def test_the_fitted_machine_tells_interactions():
    """As above, of the machine that fit() makes: no term tells alone, so all come in by their pairs."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.unique(np.concatenate([[10] if a else [11], [20] if b else [21], rng.integers(100, 160, 8)])).astype(int))
        y.append(int(a == b))
    m = X.fit(rows[:1500], np.array(y[:1500]))
    assert {10, 11, 20, 21} <= set(m.bins.tolist())
    number = dict(zip(m.bins.tolist(), range(len(m.bins))))
    scores = m.score([np.array([number[k] for k in r if k in number], int) for r in rows[1500:]])
    assert ((scores >= 0.5) == np.array(y[1500:])).mean() > 0.97


def test_pairs_formula_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = X.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, X.FACTORS)))
    row = np.array([0, 2, 3, 5])
    by_hand = 0.3 + m.weights[row].sum() + sum(m.factors[i] @ m.factors[j] for k, i in enumerate(row) for j in row[k + 1 :])
    assert np.allclose(m.raw([row, np.array([], int)]), [by_hand, 0.3])


def test_held_out_accuracy(spark):
    words = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(rng.choice(words, 20)) + (" idiotic" if bad else "")
        docs.append((i, text))
        labels.append((i, 1, int(bad)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    scored = X.score_texts(docs, X.learn(docs, labels)).join(labels, "doc_id")
    assert scored.where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0] > 0.97
    assert X.keep_clean(docs, X.learn(docs, labels)).count() == 450


def test_defined_cases(spark, odd):
    none = spark.createDataFrame([], LABELS)
    got = X.score_texts(odd, X.learn(odd, none)).collect()
    assert len(got) == odd.count() and all(0 <= r.score < 0.01 and r.predicted == 0 for r in got)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 1), (5, 1, None), (None, 1, 1), (7, 1, 0), (99, 1, 2)], LABELS)
    m = X.learn(odd, labels)
    assert X.score_texts(odd, m).count() == odd.count()
    kept = X.keep_clean(odd, m)
    assert kept.schema == odd.schema and X.score_texts(odd.limit(0), m).count() == 0
