import math
import random
import re
import tracemalloc
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import fertility as M

PIECES, BYTES = M.Pieces(), M.Bytes()


def brute(text):
    """Counts and measures of one text, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(hit))
    if not words:
        return (*counts, None, None, None, None)
    pieces, coder = PIECES, BYTES
    ids = [i for w in words for i in pieces.model.encode(w)]
    falls = sum(map(pieces.model.is_byte, ids)) / len(ids)
    bits = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
    most = math.log2(min(len(ids), pieces.model.get_piece_size()))
    tokens = sum(len(coder.model.encode_ordinary(" " + w)) for w in words)
    return (*counts, counts[1] / len(ids), counts[1] / tokens, falls, bits / most if most else 0.0)


def texts():
    draw = random.Random(3)
    words = ["the", "of", "and", "été", "über", "漢字", "a b", "x y", "Zahl", "can't", "'s", "##", "&amp;", "\U0001f600", "a\x1cb", "end ", "привет"]
    some = [" ".join(draw.choices(words, k=n)) for n in (1, 2, 3, 4, 5, 30, 200)]
    return [*some, "", "   \n\t ", "one", "a b c\na b c\n\na b c", "a b c a b c a", "\n".join(["same line here"] * 9), "x" * 5000, "a\x0bb\x0cc\rd", "tail  \n"]


def test_measures_equal_brute_force():
    ts = texts()
    have = M.Measurer()(ts)
    for t, row in zip(ts, have.itertuples(index=False), strict=True):
        want = brute(t)
        assert tuple(row)[:5] == want[:5], t
        for a, b in zip((row.piece_chars, row.byte_chars, row.fallback, row.entropy), want[5:], strict=True):
            assert (b is None and pd.isna(a)) or a == pytest.approx(b, abs=1e-9), t


def test_chunks_do_not_matter():
    ts = texts() * 3
    one = M.Measurer()(ts)
    each = pd.concat([M.Measurer()([t]) for t in ts], ignore_index=True)
    pd.testing.assert_frame_equal(one, each, check_dtype=False)


def test_windows_end_with_their_text():
    """The last words of a text and the first of the next one are no window, though they look like an earlier one."""
    ts = ["a b c x a", "b c d", "a b c x a b", "c a b c", "", "a b c a b c"]
    assert list(M.Measurer()(ts).n_repeat_words) == [brute(t)[4] for t in ts] == [0, 0, 0, 0, 0, 6]


def test_scripts():
    assert [M.script_of(t) for t in ("abc é", "привет мир a", "漢字かな漢", "123 ...", "", "שלום")] == ["latin", "cyrillic", "han", "none", "none", "hebrew"]


def test_bands_reject_outliers_by_peer(spark):
    """Documents that spell another language's words are rejected in their own language only; plain failures don't shape bands."""
    draw = random.Random(4)
    plain = lambda: " ".join(draw.choices("the people of this place have found that some other things were made from good water".split(), k=90))
    coded = lambda: " ".join("".join(draw.choices("qxzjkvw#$", k=9)) for _ in range(90))
    rows = [(i, plain(), "en") for i in range(300)] + [(i, coded(), "xx") for i in range(300, 600)] + [(600, coded(), "en"), (601, plain(), "xx"), (602, coded(), None), (603, "few words", "en")]
    table = M.judge(M.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    have = {r.doc_id: r for r in table.collect()}
    assert len(have) == len(rows)
    assert not have[600].kept and "piece_chars" in have[600].reasons and not have[601].kept
    assert have[602].kept  # no peers to differ from
    assert have[603].base_failed and not have[603].kept
    assert sum(have[i].kept for i in range(600)) >= 595


def test_defined_cases(spark, odd):
    from foliospark.llm.fertility import judge, measured

    wide = odd.selectExpr("*", "'z' as script", "'z' as peer", "'z' as magnitude", "'z' as reasons", "'z' as m", "'z' as n_words")
    have = sorted(judge(measured(wide)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect(), key=str)
    want = []
    for r in odd.collect():
        b = brute(r.text)[:5]
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want.append((r.doc_id, *b, failed, not failed))  # too few peers to reject
    assert sorted(map(tuple, have), key=str) == sorted(want, key=str)
    assert judge(measured(odd.limit(0))).count() == 0


def test_long_text_and_all_rows(spark):
    long = " ".join(f"w{i % 5003}" for i in range(400_000))
    df = spark.createDataFrame([(1, long, "en")], "doc_id long, text string, lang string").unionByName(spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang")))
    have = {r.doc_id: r.n_words for r in M.measured(df).where("n_words > 2").collect()}
    assert have == {1: 400_000} and M.measured(df).count() == 6


def test_memory_of_a_batch_is_that_of_a_chunk():
    """A batch of any size is measured in slices: every row, in order, and its whole text never lies in Python at once."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(3000)]
    some = [" ".join(draw.choices(words, k=300)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4003)), "lang": [None] * 4003, "text": some * 4 + [None, "x " * 600_000, ""]})
    measure = M.Measurer()
    tracemalloc.start()
    have = [(i, n) for out in M.measure_batches(iter([batch]), measure) for i, n in zip(out["doc_id"].to_pylist(), out["n_words"].to_pylist())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert have == [(i, 300) for i in range(4000)] + [(4000, 0), (4001, 600_000), (4002, 0)]
    assert peak < 80_000_000, peak  # 187 MB in chunks of 4,000,000
