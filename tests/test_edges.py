"""Sources, sinks and options that no query reads: strict and headed tables, CSV and gzip, abstracts, landed texts, defaults, the run's report."""

import gzip
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.plans import pipeline
from foliospark.sources import files, landed


def test_strict_tables_fail_on_ragged_rows(spark, tmp_path):
    (tmp_path / "good.tsv").write_text("a\tb\nc\td\n")
    (tmp_path / "bad.tsv").write_text("a\tb\nc\n")
    read = lambda name: files.read_tsv(spark, str(tmp_path / name), files.STATUS, strict=True).collect()
    assert list(map(tuple, read("good.tsv"))) == [("a", "b"), ("c", "d")]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read("bad.tsv")


def test_tables_with_a_header(spark, tmp_path):
    (tmp_path / "h.tsv").write_text('id\tgene\nx1\tg"1\nx2\tg2\n')
    rows = files.read_tsv(spark, str(tmp_path / "h.tsv"), "id string, gene string", header=True).collect()
    assert [tuple(r) for r in rows] == [("x1", 'g"1'), ("x2", "g2")]


def test_mapping_is_latest_first(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("g1\tp1\tm1\t2004-01-02\ng2\tp2\tm2\t2010-05-06\ng3\tp3\tm3\t2007-01-01\n")
    rows = files.read_mapping(spark, str(tmp_path / "m.tsv")).collect()
    assert [r.gene_name for r in rows] == ["g2", "g3", "g1"] and str(rows[0].created) == "2010-05-06"


def test_csv_has_a_header_and_no_index(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("a,b", 1), (None, 2)], "t string, n int").coalesce(1), str(tmp_path / "o"))
    (part,) = [p for p in os.listdir(tmp_path / "o") if p.endswith(".csv")]
    assert (tmp_path / "o" / part).read_text().splitlines() == ["t,n", '"a,b",1', ",2"]


def test_gzip_articles_are_json_lines(spark, tmp_path):
    files.write_articles(spark.createDataFrame([("1", None)], "id string, title string").coalesce(1), str(tmp_path / "o"), gzip=True)
    (part,) = [p for p in os.listdir(tmp_path / "o") if p.endswith(".json.gz")]
    assert json.loads(gzip.open(tmp_path / "o" / part).read()) == {"id": "1", "title": None}
    assert files.read_articles(spark, str(tmp_path / "o"))[0].collect() == []  # only .json is an article


def test_abstracts_are_lines(spark, tmp_path):
    files.write_abstracts(spark.createDataFrame([("a\nb",), (None,), ("",)], "abstract string").coalesce(1), str(tmp_path / "o"))
    (part,) = [p for p in os.listdir(tmp_path / "o") if p.endswith(".txt")]
    assert (tmp_path / "o" / part).read_text() == "a b\n\n"


def test_bodies_without_a_record(spark):
    rows = [("a", 200, "[{}]", None), ("b", 200, "No record can be found for the input: b", None), ("c", 200, "x No result can be found y", None), ("d", 200, "[Error] : no", None), ("e", 404, None, None), ("f", None, None, "timeout")]
    responses = spark.createDataFrame(rows, landed.RESPONSE)
    assert [r.key for r in landed.with_record(responses).collect()] == ["a"]
    told = responses.select("key", landed.outcome(F.col("status"), F.col("error")).alias("o")).collect()
    assert {r.key: r.o for r in told} == {"a": "ok", "b": "ok", "c": "ok", "d": "ok", "e": "not_found", "f": "error"}


@pytest.mark.parametrize("source", ["ncbi_my", "epmc_my"])
def test_landed_xml_becomes_sections(spark, tmp_path, source):
    (tmp_path / "PMC1.xml").write_text("<article><body><sec><title>A</title><p>x</p></sec></body></article>")
    (tmp_path / "PMC2.xml").write_text("<article><body><sec><title>A</title><p>x</p></sec><sec>")
    (tmp_path / "PMC3.xml").write_text("<other/>")
    rows = {r.pmcid: r for r in pipeline.texts_of(landed.read_landed(spark, str(tmp_path)), source).collect()}
    assert [(s.section, s.paragraphs) for s in rows["PMC1"].text_sections] == [("A", ["x"])] and rows["PMC1"].text_error is None
    assert rows["PMC2"].text_sections is None and rows["PMC2"].text_error and rows["PMC3"].text_sections is None
    with pytest.raises(ValueError):
        pipeline.texts_of(landed.read_landed(spark, str(tmp_path)), "pdf")


def test_labels_and_default_folder(spark):
    df = spark.createDataFrame([("cc by",), ("",), (None,)], "l string")
    assert [r[0] for r in df.select(text.label_missing(F.col("l"))).collect()] == ["cc by", "None", "None"]
    assert re.fullmatch(r"fetch-\d{8}-\d{6}", pipeline.default_folder())


def test_notes_report_what_they_did(spark, tmp_path, capsys):
    """Ids that were done are skipped, failed ones come again, and the counts are of the same pass."""
    (tmp_path / "s.tsv").write_text("".join(f"g{i}\tx\n" for i in range(6)))
    (tmp_path / "landed").mkdir()
    body = json.dumps([{"items": [{"content": [{"items": ["t", {"content": [{"items": [{"text": "n"}]}]}]}]}]}])
    for i in range(4):
        (tmp_path / "landed" / f"g{i}.json").write_text(body)
    run = ["notes", "--ids", str(tmp_path / "s.tsv"), "--landed", str(tmp_path / "landed"), "--out", str(tmp_path / "n"), "--limit", "5"]
    pipeline.main(run)
    assert "5 processed, 0 skipped, 1 failed, 0 not found" in capsys.readouterr().out
    pipeline.main(run)
    assert "1 processed, 4 skipped, 1 failed, 0 not found" in capsys.readouterr().out
