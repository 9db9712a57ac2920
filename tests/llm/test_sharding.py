import zlib

import pytest
from pyspark.sql import functions as F

from foliospark.llm import sharding as S


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 10, 17, 99, 100, 1000, 4099])
def test_feistel_is_a_permutation(spark, n):
    assert sorted(r[0] for r in spark.range(n).select(S.feistel(F.col("id"), n, 3)).collect()) == list(range(n))


def test_shards_are_even_and_gapless(spark):
    rows = [(1, "same")] * 500 + [(1, f"x{i}") for i in range(700)] + [(None, None)] * 100 + [(i, "b") for i in range(303)]
    got = S.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    sizes = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1 and all(s == list(range(len(s))) for s in sizes)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)
    ordered = sorted(got, key=lambda r: r.row_number)
    assert [key(r) for r in ordered] == sorted(map(key, got))


def test_layout_does_not_matter(spark, odd):
    a, b = (sorted(map(str, S.shard_documents(d).collect())) for d in (odd.coalesce(1), odd.repartition(7)))
    assert a == b


def test_defined_cases(spark, odd):
    got = S.shard_documents(odd).collect()
    texts = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == texts and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert S.shard_documents(odd.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, odd):
    plan = S.shard_documents(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan
