"""One file an article over several runs, copies with names and times, keyed upserts, counts from the writing pass."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from foliospark.plans import pipeline
from foliospark.sources import article_files, files
from foliospark.streaming import progress, upsert
from tests.test_sources import pages


def folder(path):
    return {n: json.loads((path / n).read_text()) for n in sorted(os.listdir(path))}


def test_the_last_run_wins(spark, tmp_path):
    out = tmp_path / "out"
    first = spark.createDataFrame([("PMC1", "é a", 1), ("PMC2", None, 2), ("a/b", "c", 3), (None, "no key", 4), ("", "no key", 5)], "file_id string, title string, n int")
    article_files.write_article_files(first, str(out))
    assert folder(out) == {"PMC1.json": {"title": "é a", "n": 1}, "PMC2.json": {"title": None, "n": 2}, "a%2Fb.json": {"title": "c", "n": 3}}
    assert "é" in (out / "PMC1.json").read_text() and "\n    " in (out / "PMC1.json").read_text()
    article_files.write_article_files(spark.createDataFrame([("PMC2", "new", 9), ("PMC3", "x", 1)], first.select("file_id", "title", "n").schema), str(out))
    assert {k: v["n"] for k, v in folder(out).items()} == {"PMC1.json": 1, "PMC2.json": 9, "PMC3.json": 1, "a%2Fb.json": 3}
    good, bad = files.read_articles(spark, str(out), "title string, n int, id string")
    assert sorted(r.n for r in good.collect()) == [1, 1, 3, 9] and bad.collect() == []


def test_a_failing_task_leaves_files_whole(spark, tmp_path):
    out = tmp_path / "out"
    article_files.write_article_files(spark.createDataFrame([("k1", "old")], "file_id string, t string"), str(out))
    fail = F.udf(lambda i: 1 / 0 if i == 37 else "new", "string")
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("k"), "id").alias("file_id"), fail("id").alias("t"))
    with pytest.raises(Exception):
        article_files.write_article_files(rows, str(out))
    assert folder(out) == {"k1.json": {"t": "old"}}
    with pytest.raises(Exception, match="no column"):
        article_files.write_article_files(rows.drop("file_id"), str(out))


def test_empty_tables_write_nothing(spark, tmp_path):
    article_files.write_article_files(spark.createDataFrame([], "file_id string, t string"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_copies_keep_bytes_names_and_times(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(20):
        (source / f"f {i}+%41.json").write_bytes(bytes(range(i + 1)))
        os.utime(source / f"f {i}+%41.json", ns=(10**18 + i * 10**9, 10**18 + i * 1_000_007_000_000))
    chosen = spark.createDataFrame([(f"f {i}+%41.json",) for i in range(0, 20, 2)] * 2 + [("other.json",)], "file_name string")
    rows = article_files.copy_files(chosen, str(source), str(out)).collect()
    assert sorted(os.listdir(out)) == sorted(f"f {i}+%41.json" for i in range(0, 20, 2)) == sorted(r.file_name for r in rows)
    for i in range(0, 20, 2):
        a, b = source / f"f {i}+%41.json", out / f"f {i}+%41.json"
        assert a.read_bytes() == b.read_bytes() and os.stat(a).st_mtime_ns // 1_000_000 == os.stat(b).st_mtime_ns // 1_000_000


def test_filter_copies_survivors(spark, tmp_path, capsys):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name, license in {"a": "CC BY-ND", "b": "cc by", "c": None}.items():
        (source / f"{name}.json").write_text(json.dumps({"id": name, "license": license, "own": [1]}, indent=4))
        os.utime(source / f"{name}.json", (1_600_000_000, 1_600_000_000))
    (source / "d.json").write_text("{broken")
    pipeline.main(["filter", "--input_path", str(source), "--output_path", str(out)])
    assert sorted(os.listdir(out)) == ["b.json", "c.json"] and "2 files copied" in capsys.readouterr().out
    assert (out / "b.json").read_bytes() == (source / "b.json").read_bytes() and os.stat(out / "b.json").st_mtime == 1_600_000_000


def test_fetch_writes_one_file_an_article(spark, tmp_path, capsys):
    out = tmp_path / "out"
    for _ in range(2):
        pipeline.main(["fetch", "--path", pages(tmp_path / f"p{_}"), "--output_path", str(out)])
    assert sorted(os.listdir(out)) == ["1.json", "PMC0.json", "PMC2.json", "PMC3.json", "PMC4.json"]
    assert "5 articles written" in capsys.readouterr().out


def test_fetch_joins_sentences(spark, tmp_path):
    rows = [("PMC0", "B", 2, 4, "later"), ("PMC0", "B", 1, 1, "one"), ("PMC0", "B", 1, 2, "two"), ("PMC0", "A", 1, 3, "a"), ("PMC0", "B", 2, 9, "end")]
    (tmp_path / "s.json").write_text("\n".join(json.dumps(dict(zip(("pmcid", "section", "paragraph", "seq", "text"), r, strict=True))) for r in rows))
    out = tmp_path / "out"
    pipeline.main(["fetch", "--path", pages(tmp_path / "p"), "--output_path", str(out), "--texts", str(tmp_path / "s.json"), "--get_text_from", "epmc"])
    have = folder(out)
    assert have["PMC0.json"]["text_sections"] == [{"ord": 0, "section": "B", "paragraphs": ["one two", "later end"]}, {"ord": 1, "section": "A", "paragraphs": ["a"]}]
    assert have["PMC2.json"]["text_sections"] is None


SCHEMA = "file_id string, title string, tags array<string>, ord long"


def feed(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_only_changed_versions_come_out(spark, tmp_path):
    path, out = str(tmp_path / "in"), []
    run = lambda ck="ck": upsert.upsert_to(spark.readStream.schema(SCHEMA).parquet(path), lambda b, _: out.extend(map(tuple, b.collect())), str(tmp_path / ck)).awaitTermination()

    def step(*rows):
        out.clear()
        feed(spark, path, list(rows))
        run()
        return sorted(out)

    assert step(("a", "1", ["x"], 1), ("b", "1", [], 2), ("a", "2", ["x"], 5), ("a", "1", ["y"], 3), (None, "n", [], 1), ("c", "n", [], None)) == [("a", "2", ["x"], 5), ("b", "1", [], 2)]
    assert step(("a", "2", ["x"], 5), ("b", "1", [], 2)) == []  # replayed
    assert step(("a", "0", ["z"], 4)) == []  # out of order
    assert step(("b", "1", [], 8), ("a", "3", None, 9)) == [("a", "3", None, 9)]  # the same content again, and a change
    assert step(("b", "old", [], 7)) == []  # behind the version that changed nothing
    run("other")  # all at once, from the start
    assert sorted(out) == [("a", "3", None, 9), ("b", "1", [], 8)]


def test_state_has_a_row_a_key(spark, tmp_path):
    path = str(tmp_path / "in")
    feed(spark, path, [(f"k{i % 7}", str(i), [], i) for i in range(500)])
    query = upsert.upsert_to(spark.readStream.schema(SCHEMA).parquet(path), lambda b, _: b.count(), str(tmp_path / "ck"))
    query.awaitTermination()
    assert sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) == 7


def test_new_keys_are_appended_without_reading_the_table_again(spark, tmp_path, monkeypatch):
    from foliospark.streaming import resume

    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("old", "by another run", [], 0)], SCHEMA).write.parquet(out)
    for i in range(4):
        feed(spark, path, [(f"k{i}", "a", [], 1), (f"k{i}", "b", [], 2), ("k0", "c", [], 3), ("old", "d", [], 4), (None, "e", [], 5)])
    reads, parquet = [], type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **o: reads.append(p) or parquet(self, *p, **o))
    run = lambda: resume.append_new(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), out, "file_id", str(tmp_path / "ck"), rows_a_file=1)
    query = run()
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 3 and [p for p in reads if p == (out,)] == [(out,)] * 2  # at the start, and with the first batch
    monkeypatch.undo()
    keys = lambda: sorted(r.file_id for r in spark.read.parquet(out).collect())
    assert keys() == ["k0", "k1", "k2", "k3", "old"]
    feed(spark, path, [("k9", "a", [], 1), ("k3", "a", [], 1)])
    run().awaitTermination()
    assert keys() == ["k0", "k1", "k2", "k3", "k9", "old"]


def test_upserts_land_in_article_files(spark, tmp_path):
    path, out = str(tmp_path / "in"), tmp_path / "out"
    for rows in ([("a", "1", [], 1), ("b", "1", [], 2)], [("a", "2", [], 3)]):
        feed(spark, path, rows)
        upsert.upsert_to(spark.readStream.schema(SCHEMA).parquet(path), lambda b, _: article_files.write_article_files(b, str(out)), str(tmp_path / "ck")).awaitTermination()
    assert {k: v["title"] for k, v in folder(out).items()} == {"a.json": "2", "b.json": "1"}


def test_counts_come_from_the_writing_pass(spark, tmp_path):
    passes = spark.sparkContext.accumulator(0)
    touch = F.udf(lambda i: passes.add(1) or i, "long")
    rows, seen = progress.counted(spark.range(100).select(touch("id").alias("id")), "pass", even=F.col("id") % 2 == 0, low=F.col("id") < 7)
    rows.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 100, "even": 50, "low": 7} and passes.value == 100


def test_a_streams_counts_are_summed(spark, tmp_path):
    path, said = str(tmp_path / "in"), io.StringIO()
    totals = progress.Totals(said)
    spark.streams.addListener(totals)
    try:
        for i in range(3):
            spark.range(10 * i, 10 * i + 10).selectExpr("id", "if(id % 5 = 0, 'error', 'ok') as status").write.mode("append").parquet(path)
        stream, _ = progress.counted(spark.readStream.schema("id long, status string").option("maxFilesPerTrigger", 3).parquet(path), "notes", failed=F.col("status") == "error")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        import time

        for _ in range(50):
            if totals.totals.get("notes", {}).get("rows", 0) >= 30:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(totals)
    assert totals.totals == {"notes": {"rows": 30, "failed": 6}} and "notes: 30 rows, 6 failed" in said.getvalue()
