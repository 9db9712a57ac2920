"""Files, paged sources, resumption and the command line, on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import articles, ids, reports
from foliospark.plans import pipeline
from foliospark.sources import files, landed, paged
from foliospark.streaming import resume


def pages(folder, sizes=(3, 2), last_empty=True):
    folder.mkdir()
    n = 0
    for i, size in enumerate([*sizes, *([0] if last_empty else [])]):
        rows = []
        for _ in range(size):
            rows.append({"id": f"i{n}", "pmid": str(n) if n % 2 else "", "pmcid": f"PMC{n}" if n != 1 else "", "source": "MED" if n % 2 else "PPR", "title": f"t{n}", "license": ["cc by", "CC BY-ND", None, "cc", "CC0"][n % 5], "isOpenAccess": "Y", "citedByCount": "4", "keywordList": {"keyword": ["a", None]}})
            n += 1
        (folder / f"page-{i:04d}.json").write_text(json.dumps({"hitCount": sum(sizes), "nextCursorMark": f"c{i + 1}", "resultList": {"result": rows}}))
    return str(folder)


def test_paged_search_and_cap(spark, tmp_path):
    path = pages(tmp_path / "p")
    assert [r.id for r in paged.read_search(spark, path=path).orderBy("ord").collect()] == ["i0", "i1", "i2", "i3", "i4"]
    assert paged.read_search(spark, path=path, maxrecords=2).count() == 2
    assert paged.landed_hit_count(spark, path) == 5


def test_paged_stream(spark, tmp_path):
    path = pages(tmp_path / "p")
    query = resume.append_versions(paged.stream_search(spark, path=path).select("ord", "id"), str(tmp_path / "out"), str(tmp_path / "ck"), once=False)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["i0", "i1", "i2", "i3", "i4"]


def test_append_new_is_idempotent(spark, tmp_path):
    for part, rows in enumerate([["a", "b"], ["b", "c"]]):
        spark.createDataFrame([(r,) for r in rows], "k string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        resume.append_new(spark.readStream.schema("k string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), "k", str(tmp_path / f"ck{part}")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_status_table_is_ragged(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('g1\tcurated\ng2\t\ng3\ng4\ta\tb\nx"y\tq"z\ng1\tcurated\n')
    rows = [tuple(r) for r in files.read_status(spark, str(tmp_path / "s.tsv")).collect()]
    assert rows == [("g1", "curated"), ("g2", None), ("g3", None), ("g4", "a"), ('x"y', 'q"z'), ("g1", "curated")]


def test_article_folder_with_malformed_files(spark, tmp_path):
    for name, body in {"a.json": json.dumps({"id": "1", "license": "CC BY-ND", "abstract": ""}, indent=2), "b.json": '{"id": ', "c.txt": "{}", "d.json": json.dumps({"id": "2", "text": {"B": ["x"], "A": ["y"]}}, indent=2)}.items():
        (tmp_path / name).write_text(body)
    good, bad = files.read_articles(spark, str(tmp_path))
    assert sorted((r.id, r.license, r.text and list(json.loads(r.text))) for r in good.collect()) == [("1", "CC BY-ND", None), ("2", None, ["B", "A"])]
    assert [r.file_name for r in bad.collect()] == ["b.json"]
    assert [r.id for r in articles.keep_licensed(good).collect()] == ["2"]


def test_batches_of_nulls_append(spark, tmp_path):
    out = str(tmp_path / "n")
    files.append_parquet(spark.createDataFrame([("g1", None)], "gene_id string, curator_notes_html string"), out)
    files.append_parquet(spark.createDataFrame([("g2", "h")], "gene_id string, curator_notes_html string"), out)
    assert spark.read.parquet(out).count() == 2


def test_fetch_pipeline(spark, tmp_path):
    results = paged.read_search(spark, path=pages(tmp_path / "p"))
    out = pipeline.fetch(results)
    assert sorted(r.file_id for r in out.collect()) == ["1", "PMC0", "PMC2", "PMC3", "PMC4"]
    again = pipeline.fetch(results.unionByName(results.withColumn("ord", F.col("ord") + 10).withColumn("title", F.lit("new"))))
    assert {r.title for r in again.collect()} == {"new"} and again.count() == 5
    texts = spark.createDataFrame([("PMC0", 200, json.dumps([{"documents": [{"passages": [{"text": "x"}]}]}]), None)], landed.RESPONSE)
    full = pipeline.fetch(results, texts=pipeline.texts_of(texts, "ncbi"), source="ncbi")
    assert {r.pmcid: r.text_passages and len(r.text_passages) for r in full.collect()}["PMC0"] == 1
    with pytest.raises(ValueError):
        articles.with_text(out, texts, "other")


def test_flat_table(spark, tmp_path):
    rows = articles.flat_table(paged.read_search(spark, path=pages(tmp_path / "p"))).collect()
    assert len(rows) == 2 and {(r.is_open_access, r.cited_by_count, r.keywords) for r in rows} == {(1, 4, "a;")}


def test_pending_limits_before_or_after(spark):
    todo = spark.createDataFrame([(i,) for i in range(6)], "k int")
    done = spark.createDataFrame([(0,), (1,)], "k int")
    assert sorted(r.k for r in ids.pending(todo, done, "k", 3).collect()) == [2]
    assert sorted(r.k for r in ids.pending(todo, done, "k", 3, limit_after_resume=True).collect()) == [2, 3, 4]


def test_null_groups_and_coverage(spark):
    df = spark.createDataFrame([("a",), (None,), ("",), (None,)], "l string")
    assert {(r.l, r.n, r.pct) for r in reports.shares(df, "l").collect()} == {("a", 1, 25.0), (None, 2, 50.0), ("", 1, 25.0)}
    assert tuple(reports.coverage(df, "l").first()) == (4, 50.0)
    assert tuple(reports.coverage(df.limit(0), "l").first()) == (0, None)
    assert ids.universe_count(df).first().n_ids == 3


def test_notes_run(spark, tmp_path):
    body = json.dumps([{"items": [{"content": [{"items": ["t", {"content": [{"items": [{"text": "<i>x</i> y"}]}]}]}]}]}])
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "g1.json").write_text(body)
    genes = spark.createDataFrame([("g1",), ("g2",)], "gene_id string")
    got = {r.gene_id: (r.curator_notes_plain, r.status) for r in pipeline.notes(genes, landed.read_landed(spark, str(tmp_path / "landed"))).collect()}
    assert got == {"g1": ("x y", "ok"), "g2": (None, "error")}


def test_batches_are_a_total_order(spark):
    got = ids.batches(spark.range(1000).toDF("k"), 200, "k").collect()
    assert all(r.batch_no == r.k // 200 for r in got)


def test_batches_of_strings_and_equal_keys(spark):
    keys = [f"g{i:04d}" for i in range(500)] + ["same"] * 300 + [None] * 3
    got = ids.batches(spark.createDataFrame([(k,) for k in keys], "k string"), 100, "k").collect()
    assert sorted(r.batch_no for r in got) == [i // 100 for i in range(len(keys))]
    ordered = sorted(got, key=lambda r: r.batch_no)
    assert all((a.k or "") <= (b.k or "") for a, b in zip(ordered, ordered[1:]) if a.batch_no < b.batch_no)
    assert ids.batches(spark.createDataFrame([], "k string"), 100, "k").count() == 0


def test_landed_pages_are_read_in_parallel(spark, tmp_path):
    path = pages(tmp_path / "p", sizes=(3, 2, 4))
    (tmp_path / "p" / "page-0009.json").write_text(json.dumps({"resultList": {"result": [{"id": "after the end"}]}}))
    got = paged.read_search(spark, path=path).orderBy("ord").collect()
    assert [(r.ord, r.id) for r in got] == [(i, f"i{i}") for i in range(9)] and got[1].license == "CC BY-ND"
    assert [r.id for r in paged.read_search(spark, path=path, maxrecords=4).orderBy("ord").collect()] == ["i0", "i1", "i2", "i3"]
    (tmp_path / "p" / "page-0000.json").write_text("{broken")
    with pytest.raises(Exception):
        paged.read_search(spark, path=path).collect()


def test_landed_results_equal_the_cursor_walk(spark, tmp_path):
    path = pages(tmp_path / "p", sizes=(2, 5, 1))
    by_cursor, mark, walked = {}, paged.FIRST, []
    for p in sorted((tmp_path / "p").iterdir()):  # each page stands under the cursor that the one before gave
        by_cursor[mark] = page = json.loads(p.read_text())
        mark = page["nextCursorMark"]
    mark = paged.FIRST
    while by_cursor.get(mark, {}).get("resultList", {}).get("result"):
        walked += [r["id"] for r in by_cursor[mark]["resultList"]["result"]]
        mark = by_cursor[mark]["nextCursorMark"]
    assert [r.id for r in paged.read_search(spark, path=path).orderBy("ord").collect()] == walked


def test_citations_are_looked_up(spark, tmp_path):
    xml = "<PubmedArticleSet><PubmedArticle><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title></Journal><AuthorList><Author><LastName>Doe</LastName><Initials>J</Initials></Author></AuthorList></Article></PubmedArticle></PubmedArticleSet>"
    responses = spark.createDataFrame([("1", 200, xml, None), ("3", 500, None, "HTTP 500")], landed.RESPONSE)
    out = {r.file_id: r.citation and tuple(r.citation) for r in pipeline.fetch(paged.read_search(spark, path=pages(tmp_path / "p")), citations=pipeline.citations_of(responses)).collect()}
    assert out["1"] == ("Doe, J. (n.d.). T. *J*.", "(Doe, n.d.)") and out["PMC3"] is None and out["PMC0"] is None and len(out) == 5


def test_command_line(spark, tmp_path, capsys):
    out, kept = str(tmp_path / "out"), str(tmp_path / "kept")
    pipeline.main(["fetch", "--path", pages(tmp_path / "p"), "--output_path", out])
    assert sorted(r.id for r in files.read_articles(spark, out)[0].collect()) == ["i0", "i1", "i2", "i3", "i4"]
    pipeline.main(["filter", "--input_path", out, "--output_path", kept])
    assert sorted(r.id for r in files.read_articles(spark, kept)[0].collect()) == ["i0", "i2", "i4"]
    pipeline.main(["analyse", "--input_path", out])
    assert "CC BY-ND" in (said := capsys.readouterr().out) and "0 malformed files" in said
    (tmp_path / "s.tsv").write_text("".join(f"g{i}\tcurated\n" for i in range(5)) + "g9\t\n")
    (tmp_path / "landed").mkdir()
    body = json.dumps([{"items": [{"content": [{"items": ["t", {"content": [{"items": [{"text": "&beta;-actin <a title='a > b'>k</a>"}]}]}]}]}]}])
    for i in range(3):
        (tmp_path / "landed" / f"g{i}.json").write_text(body)
    run = ["notes", "--ids", str(tmp_path / "s.tsv"), "--landed", str(tmp_path / "landed"), "--out", str(tmp_path / "n"), "--limit", "0", "--batch-size", "2"]
    pipeline.main(run)
    (tmp_path / "landed" / "g3.json").write_text(body)
    pipeline.main(run)
    rows = spark.read.parquet(str(tmp_path / "n"))
    assert rows.where("gene_id = 'g3'").count() == 2
    got = {r.gene_id: (r.curator_notes_plain, r.status) for r in pipeline.read_notes(spark, str(tmp_path / "n")).collect()}
    assert got == {f"g{i}": ("β-actin k", "ok") for i in range(4)} | {"g4": (None, "error"), "g9": (None, "error")}


def test_a_search_of_landed_results(spark, tmp_path):
    out = str(tmp_path / "out")
    pipeline.main(["fetch", "--path", pages(tmp_path / "p"), "--output_path", out, "--search", '(SRC:MED OR SRC:PMC) NOT LICENSE:"CC BY-ND"', "--max_records", "5"])
    assert sorted(r.id for r in files.read_articles(spark, out)[0].collect()) == ["i3"]


def test_progress_is_told(spark):
    import io

    from foliospark.streaming.progress import progress

    out = io.StringIO()
    with progress(spark, "count", every=0.05, out=out):
        spark.range(0, 40_000_000, 1, 16).selectExpr("sum(hash(id, id + 1, id + 2))").collect()
    assert out.getvalue().endswith("stages seen\n") and "count: " in out.getvalue()
