import hashlib
import random
import re

from pyspark.sql import functions as F

from foliospark.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the units themselves."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_text(draw):
    return "".join(draw.choices(["a", "bc", " ", "  ", "\n", "\t", "\x0b", "\r", "é", "漢", "\U0001f600", "\xa0", "<", "P>", "<S", "S>", ">", "<M"], k=draw.randrange(0, 60)))


def test_ranks_equal_units():
    draw, events = random.Random(1), M.automaton()
    for t in ["", " ", "a", " a", "a ", "\n\n", "a b", *(random_text(draw) for _ in range(3000))]:
        units, ranks = UNIT.findall(t), M.Ranks(events, t)
        assert ranks.n == len(units) and [ranks.end(k) for k in range(ranks.n + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
        assert ranks.marked == any(m in t for m in ("<P>", "<S>", "<M>"))


def test_outputs_equal_brute_force_and_are_restored(spark):
    draw = random.Random(2)
    rows = [(i, random_text(draw)) for i in range(600)]
    have = M.transform(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in have} == {i: brute(i, t) for i, t in rows}
    assert {r.doc_id: r.back for r in have} == dict(rows) and {r.form for r in have} == {"plain", "psm", "spm"}


def test_defined_cases(spark, odd):
    rows = [*((r.doc_id, r.text) for r in odd.collect())]
    long = ("word " * 300_000) + "\n\n"
    more = spark.createDataFrame([(i, long if i < 4 else "x <S> y") for i in range(8)], "doc_id long, text string")
    wide = odd.selectExpr("*", "'z' as h1", "'z' as form", "'z' as output", "'z' as prefix_chars")
    have = M.transform(wide.unionByName(more, allowMissingColumns=True)).withColumn("back", M.restored(F.col("output"), F.col("form")))
    want = [(*brute(i, t), t or "") for i, t in rows + [tuple(r) for r in more.collect()]]
    assert sorted((tuple(r)[1:] for r in have.collect()), key=str) == sorted(want, key=str)
    assert M.transform(odd.limit(0)).count() == 0
    assert M.transform(odd, rate=0).where("form <> 'plain'").count() == 0
