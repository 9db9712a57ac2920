"""Searches and lookups of a local service: pages read by tasks, narrowing, connections, pace; streams with checkpoints."""

import os

import pytest
from pyspark.sql import functions as F

from foliospark.functions import search
from foliospark.operators import articles
from foliospark.plans import pipeline
from foliospark.sources import files, landed, paged
from foliospark.streaming import resume
from tests.server import serving
from tests.test_sources import pages


def records(n, start=0):
    return [{"id": f"i{i}", "pmid": str(i), "source": ["MED", "PMC", "PPR", None][i % 4], "title": f"t{i} dictyostelium", "inEPMC": "YN"[i % 2], "firstPublicationDate": f"20{i % 30:02d}-05-01", "pubYear": f"20{i % 30:02d}"} for i in range(start, start + n)]


def whole(service):
    return [q["cursorMark"] for path, q, *_ in service.asked if path == "/search" and q["resultType"] == "core"]


def test_batch_reads_a_page_a_task(spark):
    with serving() as s:
        s.records = records(23)
        found = paged.read_search(spark, url=f"{s.url}/search", query="x", pagesize=5, synonym="N", useragent="me")
        assert found.rdd.getNumPartitions() == 5
        s.asked.clear()
        rows = found.orderBy("ord").collect()
        assert [(r.ord, r.id) for r in rows] == [(i, f"i{i}") for i in range(23)] and rows[3].source is None and rows[4].source == "MED"
        assert sorted(set(whole(s))) == sorted(["*", "c5", "c10", "c15", "c20"])
        assert {q["synonym"] for _, q, *_ in s.asked} == {"N"} and {agent for _, _, agent, _ in s.asked} == {"me"}
        assert [r.ord for r in paged.read_search(spark, url=f"{s.url}/search", query="x", pagesize=5, maxrecords=7).orderBy("ord").collect()] == list(range(7))
        assert paged.hit_count(url=f"{s.url}/search", query="x") == 23
        s.records = []
        assert paged.read_search(spark, url=f"{s.url}/search", query="x").count() == 0


def test_a_stream_reads_pages_in_tasks_and_goes_on_from_its_checkpoint(spark, tmp_path):
    with serving() as s:
        s.records = records(12)

        def run():
            s.asked.clear()
            stream = paged.stream_search(spark, url=f"{s.url}/search", query="x", pagesize=5)
            seen = stream.select("ord", "id", F.spark_partition_id().alias("task"))
            resume.append_versions(seen, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
            return spark.read.parquet(str(tmp_path / "out")).orderBy("ord").collect(), whole(s)

        rows, cursors = run()
        assert [(r.ord, r.id) for r in rows] == [(i, f"i{i}") for i in range(12)]
        assert sorted(cursors) == ["*", "c10", "c5"] and len({r.task for r in rows}) == 3
        s.records = records(19)
        rows, cursors = run()
        assert [(r.ord, r.id) for r in rows] == [(i, f"i{i}") for i in range(19)]
        assert sorted(cursors) == ["c12", "c17"]  # nothing before the checkpoint is fetched again
        rows, cursors = run()
        assert len(rows) == 19 and cursors == []


def test_a_failing_page_ends_the_stream_and_a_restart_reads_it(spark, tmp_path, monkeypatch):
    with serving() as s:
        s.records = records(12)
        options = dict(url=f"{s.url}/search", query="x", pagesize=5)
        flag = tmp_path / "broken"
        flag.write_text("")
        broken = F.udf(lambda n: 1 / 0 if n == 7 and os.path.exists(flag) else n, "long")
        run = lambda: resume.append_versions(paged.stream_search(spark, **options).select(broken("ord").alias("ord"), "id"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        with pytest.raises(Exception):
            run()
        flag.unlink()
        s.records = records(14)
        for n in (12, 14):  # the batch that failed as it was planned, then what came since
            run()
            assert sorted(r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(n))


def test_landed_pages_stream_as_they_arrive(spark, tmp_path):
    path = pages(tmp_path / "p", sizes=(3, 2), last_empty=False)
    run = lambda: resume.append_versions(paged.stream_search(spark, path=path, pages_a_batch=1).select("ord", "id"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ord").collect()] == [f"i{i}" for i in range(5)]
    os.replace(pages(tmp_path / "q", sizes=(4,), last_empty=False) + "/page-0000.json", f"{path}/page-0002.json")
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("ord").collect()
    assert [r.ord for r in rows] == [0, 1, 2, 1000, 1001, 2000, 2001, 2002, 2003]
    assert paged.landed_hit_count(spark, path) == 5


def test_conditions_narrow_the_search(spark):
    with serving() as s:
        s.records = records(40)
        plain = paged.read_search(spark, url=f"{s.url}/search", query="x", pagesize=5)
        every = sorted(r.id for r in plain.collect() if r.source in ("MED", "PMC") and r.pubYear > "2010")
        s.asked.clear()
        found = plain.where(F.col("source").isin("MED", "PMC") & (F.col("pubYear") > "2010"))
        assert sorted(r.id for r in found.collect()) == every
        asked = {q["query"] for _, q, *_ in s.asked}
        assert any('SRC:"MED" OR SRC:"PMC"' in q for q in asked) and len(set(whole(s))) == 4  # 20 of 40 records
        s.asked.clear()
        assert plain.where("source = 'PMC' and title like '%9%'").count() == sum(1 for r in s.records if r["source"] == "PMC" and "9" in r["title"])
        assert any('(SRC:"PMC")' in q["query"] for _, q, *_ in s.asked)
        assert paged.narrowing("title", ["x"]) is None and paged.narrowing("source", ['a"b']) is None and paged.narrowing("source", [3]) is None


def test_what_of_a_search_goes_along():
    ours = "( dictyostelium ) AND ( (HAS_FT:Y) AND (SRC:MED OR SRC:PMC ) )"
    assert articles.narrowed("q", ours) == "(q) AND (((HAS_FT:Y) AND (SRC:MED OR SRC:PMC)))"
    assert articles.narrowed("q", 'word OR SRC:MED') == "(q)" and articles.narrowed("", "SRC:MED") == "(SRC:MED)"
    assert search.required('a ((SRC:X OR SRC:Y) NOT (LANG:"eng")) (b AND PUB_YEAR:[2000 TO 2001])', articles.FIELDS) == ['((SRC:X OR SRC:Y) NOT (LANG:"eng"))', "PUB_YEAR:[2000 TO 2001]"]
    assert search.required("NOT SRC:MED", articles.FIELDS) == [] and search.required("OTHER:x AND SRC:MED", articles.FIELDS) == ["SRC:MED"]


def test_a_live_search_equals_the_same_on_all_results(spark, tmp_path):
    with serving() as s:
        s.records = records(40)
        asked = "dictyostelium AND ((HAS_FT:Y) AND (SRC:MED OR SRC:PMC))"
        want = sorted(r["id"] for r in s.records if r["inEPMC"] == "Y" and r["source"] in ("MED", "PMC"))
        out = str(tmp_path / "out")
        pipeline.main(["fetch", "--url", f"{s.url}/search", "--query", "x", "--search", asked, "--synonym", "N", "--output_path", out])
        assert sorted(r.id for r in files.read_articles(spark, out)[0].collect()) == want
        assert all("SRC:MED OR SRC:PMC" in q["query"] and q["synonym"] == "N" for _, q, *_ in s.asked)


@pytest.mark.parametrize("asked", ["( dictyostelium ) AND ( (HAS_FT:Y) AND (SRC:MED OR SRC:PMC ) )", '( dictyostelium ) AND ( (FIRST_PDATE:[2000 TO 2025]) AND (HAS_FT:Y) AND (((SRC:MED OR SRC:PMC OR SRC:AGR OR SRC:CBA) NOT (PUB_TYPE:"Review"))) )'])
def test_the_notebooks_searches_run_on_results(spark, asked):
    rows = [(r["id"], r["source"], r["title"], None, r["inEPMC"], r["firstPublicationDate"], (["Review"] if r["id"].endswith("8") else ["x"],)) for r in records(60)]
    df = spark.createDataFrame(rows, "id string, source string, title string, abstractText string, inEPMC string, firstPublicationDate string, pubTypeList struct<pubType:array<string>>")
    df = df.selectExpr("*", "null as license", "'eng' as language", "'2000' as pubYear", "'Y' as isOpenAccess", "named_struct('journal', named_struct('title', 'j')) as journalInfo")
    have = {r.id for r in df.where(articles.found_by(asked)).collect()}
    dated = "FIRST_PDATE" in asked
    assert have == {r[0] for r in rows if r[4] == "Y" and r[1] in ("MED", "PMC") and (not dated or (r[5][:4] <= "2025" and r[6] != (["Review"],)))}


def test_dates_take_in_whole_years(spark):
    df = spark.createDataFrame([("1999-12-31",), ("2000-01-01",), ("2025-12-31",), ("2026-01-01",), (None,)], "d string")
    have = lambda q: sorted(r.d for r in df.where(search.condition(q, {"D": F.col("d")}, [F.col("d")], dates=("D",))).collect())
    assert have("D:[2000 TO 2025]") == ["2000-01-01", "2025-12-31"] and have("D:[1999-12 TO 2000-01]") == ["1999-12-31", "2000-01-01"]


def test_lookups_keep_connections_and_tell_failures(spark):
    with serving() as s:
        s.bodies = {f"wait{i}": (200, f"b{i}") for i in range(30)} | {"bad": (500, "x"), "g a": (200, "spaced"), "slow": (200, "late")}
        keys = [f"wait{i}" for i in range(30)] + ["bad", "none", "reset"]
        ids = spark.createDataFrame([(k,) for k in keys], "id string").coalesce(1)
        got = {r.key: (r.status, r.body, r.error) for r in landed.fetch(ids, "id", f"{s.url}/get/{{}}", at_once=4).collect()}
        assert all(got[f"wait{i}"] == (200, f"b{i}", None) for i in range(30))
        assert got["bad"][::2] == (500, "HTTP 500") and got["none"] == (404, None, None)
        assert got["reset"][0] is None and got["reset"][2]
        assert 2 <= s.most_under_way <= 4 and s.connections <= 4 + 3  # a reset costs the kept one, and one more try
        late = landed.fetch(spark.createDataFrame([("slow",)], "id string"), "id", f"{s.url}/get/{{}}", timeout=0.3).first()
        assert late.status is None and "imeout" in late.error.replace("timed out", "Timeout")
        quoted = spark.createDataFrame([("g a",)], "id string")
        assert landed.fetch(quoted, "id", f"{s.url}/get/{{}}").first().status == 404  # the name reaches the service encoded
        assert s.asked[-1][0] == "/get/g%20a"


def test_lookups_keep_their_pace(spark):
    with serving() as s:
        s.bodies = {f"k{i}": (200, "b") for i in range(6)}
        ids = spark.createDataFrame([(f"k{i}",) for i in range(6)], "id string").coalesce(1)
        landed.fetch(ids, "id", f"{s.url}/get/{{}}", base=0.1, jitter=0.05, at_once=3).collect()
        times = sorted(t for *_, t in s.asked)
        assert times[-1] - times[0] >= 0.5 * 0.95


def test_closed_connections_are_replaced(spark):
    with serving(keep_alive=False) as s:
        s.bodies = {f"k{i}": (200, "b") for i in range(5)}
        ids = spark.createDataFrame([(f"k{i}",) for i in range(5)], "id string").coalesce(1)
        assert [r.status for r in landed.fetch(ids, "id", f"{s.url}/get/{{}}").collect()] == [200] * 5
