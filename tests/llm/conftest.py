import pytest

#: Columns whose names clash with those that operators make.
CLASHES = "row, rid, n, node, score, entry, unit, shard, found, added, size, text_hash".split(", ")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every defined case: nulls, empty, repeated rows and ids, a very long text, ties, clashing columns."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 5), (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 5),
        (1, "another text under the same number", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "  \n\t ", "en", None, 4),
        (None, "a row without a number", "en", "b", 1), (None, None, None, None, None), (5, long, "en", "a", 1), (6, "über ß 漢字 \U0001f600 x@y.zz", "de", "b", 1), (7, "x", "", "b", 1),
    ]
    extra = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([r + tuple("z" for _ in CLASHES) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
