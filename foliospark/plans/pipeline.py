"""Runs from end to end (acquire, normalise, enrich, filter, report) and their command line.

    python -m foliospark.plans.pipeline fetch --path pages/ --output out/ [--max_records N] [--texts landed/ --get_text_from epmc_my]
    python -m foliospark.plans.pipeline filter --input_path out/ [--output_path kept/]
    python -m foliospark.plans.pipeline analyse --input_path out/
    python -m foliospark.plans.pipeline notes --ids status.tsv --landed notes/ --out notes.parquet [--limit 10]
"""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.citation import apa, pubmed_fields
from foliospark.functions.html import html_parser_text
from foliospark.functions.jats import jats_paragraphs
from foliospark.functions.notes import bioc_passages, notes_html
from foliospark.functions.text import label_missing
from foliospark.operators import articles as A
from foliospark.operators.ids import column_at, first_ids, latest, nonempty, pending, retry
from foliospark.operators.reports import coverage, shares
from foliospark.operators.sections import merge_sections, sentence_sections
from foliospark.sources import article_files, files, landed
from foliospark.sources.paged import read_search
from foliospark.streaming.progress import counted, progress

_SECTIONS = "array<struct<ord:int,section:string,paragraphs:array<string>>>"
_PASSAGES = "array<struct<section_type:string,text:string>>"


def citations_of(responses: DataFrame) -> DataFrame:
    """(pmid, citation) of landed PubMed XML."""
    return responses.where("status = 200").select(F.col("key").alias("pmid"), apa(pubmed_fields("body")).alias("citation"))


def texts_of(responses: DataFrame, source: str) -> DataFrame:
    """(pmcid, text_sections, text_passages, text_error) of landed full texts of a source."""
    if source not in A.TEXT_SOURCES:
        raise ValueError(f"text source {source!r} is none of {', '.join(A.TEXT_SOURCES)}")
    if source == "epmc":
        raise ValueError("epmc has sentences: use texts_of_sentences")
    if source == "ncbi":
        return responses.select(F.col("key").alias("pmcid"), F.lit(None).cast(_SECTIONS).alias("text_sections"), F.when(F.col("status") == 200, bioc_passages(F.col("body"))).alias("text_passages"), F.col("error").alias("text_error"))
    rows = jats_paragraphs(responses.where("status = 200"), "key", "body")
    errors = rows.groupBy("key").agg(F.max("error").alias("e"))
    merged = merge_sections(rows, "key")
    return (
        responses.select("key", "error").join(merged, "key", "left").join(errors, "key", "left")
        .select(F.col("key").alias("pmcid"), F.when(F.col("e").isNull(), F.col("text_sections")).cast(_SECTIONS).alias("text_sections"), F.lit(None).cast(_PASSAGES).alias("text_passages"), F.coalesce("error", "e").alias("text_error"))
    )


def texts_of_sentences(sentences: DataFrame) -> DataFrame:
    """As texts_of, of a table of sentences (pmcid, section, paragraph, seq, text): sentences are joined to paragraphs in
    their order, paragraphs follow their numbers, and sections the places of their first sentences."""
    rows = sentence_sections(sentences, "pmcid")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "section", "paragraphs")))
    numbered = F.transform(ordered, lambda s, i: F.struct(i.alias("ord"), s["section"].alias("section"), s["paragraphs"].alias("paragraphs")))
    return rows.groupBy("pmcid").agg(numbered.cast(_SECTIONS).alias("text_sections")).select("pmcid", "text_sections", F.lit(None).cast(_PASSAGES).alias("text_passages"), F.lit(None).cast("string").alias("text_error"))


def fetch(results: DataFrame, most: int = 0, citations: DataFrame | None = None, texts: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """Article documents of search results (with ord): capped, normalised, enriched, last write wins."""
    out = A.last_written(A.article_records(A.capped(results, most, F.col("ord"))), "ord")
    if citations is not None:
        out = A.with_citations(out, citations)
    if texts is not None:
        out = A.with_text(out, texts, source)
    return out


def notes(ids: DataFrame, responses: DataFrame, done: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """(gene_id, curator_notes_html, curator_notes_plain, status) of ids that aren't done for good."""
    todo = ids if done is None else pending(ids, retry(done), "gene_id", limit)
    html = notes_html(F.col("body"))
    return todo.join(responses, todo.gene_id == responses.key, "left").select(
        "gene_id", html.alias("curator_notes_html"), html_parser_text(html).alias("curator_notes_plain"), landed.outcome(F.col("status"), F.col("error")).alias("status")
    )


def current_notes(notes: DataFrame) -> DataFrame:
    """One row a gene of runs appended one after the other: what is done for good before an error, which a later run retries."""
    done = (F.col("status") != "error").cast("int")
    return latest(notes, "gene_id", done, F.coalesce("curator_notes_html", F.lit("")))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """What the `notes` command left at path, one row a gene: its runs append, and a gene that failed comes again."""
    return current_notes(spark.read.schema(files.NOTES).parquet(path))


def report(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coverage of text and abstract, and license shares with labels for display."""
    licenses = shares(articles, "license")
    return coverage(articles, "text", "abstract"), licenses.withColumn("label", label_missing(F.col("license")))


def default_folder() -> str:
    return f"fetch-{datetime.now():%Y%m%d-%H%M%S}"


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="foliospark")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("fetch")
    f.add_argument("--path")
    f.add_argument("--url")
    f.add_argument("--query", default="")
    f.add_argument("--search", help="keep landed results that this search of the service's language finds")
    f.add_argument("--synonym", choices=["Y", "N"])
    f.add_argument("--max_records", type=int, default=0)
    f.add_argument("--get_text_from", choices=A.TEXT_SOURCES)
    f.add_argument("--texts")
    f.add_argument("--citations")
    f.add_argument("--output_path", default=None)
    k = sub.add_parser("filter")
    k.add_argument("--input_path", required=True)
    k.add_argument("--output_path")
    a = sub.add_parser("analyse")
    a.add_argument("--input_path", required=True)
    n = sub.add_parser("notes")
    n.add_argument("--ids", required=True)
    n.add_argument("--landed")
    n.add_argument("--url")
    n.add_argument("--out", default="output/curator_notes.parquet")
    n.add_argument("--limit", type=int, default=10)
    n.add_argument("--batch-size", type=int, default=200)
    n.add_argument("--timeout", type=float, default=15.0)
    n.add_argument("--sleep-base", type=float, default=0.15)
    n.add_argument("--sleep-jitter", type=float, default=0.10)
    o = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if o.command == "fetch":
        options = {"path": o.path} if o.path else {"url": o.url, "query": A.narrowed(o.query, o.search) if o.search else o.query, "sleepbase": 0.25}
        if o.synonym:
            options["synonym"] = o.synonym
        results = read_search(spark, maxrecords=0 if o.search else o.max_records, **options)
        if o.search:
            results = A.capped(results.where(A.found_by(o.search)), o.max_records, F.col("ord"))
        citations = citations_of(landed.read_landed(spark, o.citations)) if o.citations else None
        texts = None
        if o.texts and o.get_text_from:
            texts = texts_of_sentences(files.read_sentences(spark, o.texts)) if o.get_text_from == "epmc" else texts_of(landed.read_landed(spark, o.texts), o.get_text_from)
        rows, seen = counted(fetch(results, citations=citations, texts=texts, source=o.get_text_from), "fetch", with_abstract=F.col("abstract").isNotNull())
        with progress(spark, "fetch"):
            article_files.write_article_files(rows, o.output_path or default_folder())
        print(f"{seen.get['rows']} articles written, {seen.get['with_abstract']} with an abstract")
    elif o.command == "filter":
        good, _ = files.read_articles(spark, o.input_path)
        kept, to = A.keep_licensed(good), o.output_path or f"{o.input_path.rstrip('/')}_filtered"
        copied, seen = counted(article_files.copy_files(kept.where("file_name not like 'part-%'"), o.input_path, to), "filter")
        copied.write.format("noop").mode("overwrite").save()
        listed = kept.where("file_name like 'part-%'").drop("file_name").withColumn("file_id", A.file_id(F.col("pmcid"), F.col("pmid"), F.col("id")))
        if not listed.isEmpty():  # an article a line, as write_articles leaves them
            article_files.write_article_files(listed, to)
        print(f"{seen.get['rows']} files copied")
    elif o.command == "analyse":
        good, bad = files.read_articles(spark, o.input_path)
        for table in report(good):
            table.show(1000, truncate=False)
        print(f"{bad.agg(F.count(F.lit(1)), F.max('id')).first()[0]} malformed files")  # Spark wants a parsed column to be read
    else:
        ids = column_at(nonempty(files.read_status(spark, o.ids), "column_1"), 0, "gene_id").distinct()
        place = spark._jvm.org.apache.hadoop.fs.Path(o.out)
        exists = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        done = read_notes(spark, o.out) if exists else None
        todo = pending(ids, retry(done), "gene_id", o.limit) if exists else first_ids(ids, "gene_id", o.limit)
        responses = landed.read_landed(spark, o.landed) if o.landed else landed.fetch(todo, "gene_id", o.url, o.timeout, o.sleep_base, o.sleep_jitter)
        everything, offered = counted(first_ids(ids, "gene_id", o.limit), "offered")
        todo = pending(everything, retry(done), "gene_id") if exists else everything
        rows, seen = counted(notes(todo, responses), "notes", failed=F.col("status") == "error", not_found=F.col("status") == "not_found")
        with progress(spark, "notes"):
            files.append_parquet(rows, o.out, o.batch_size)
        n, told = seen.get, offered.get
        print(f"{n['rows']} processed, {told['rows'] - n['rows']} skipped, {n['failed']} failed, {n['not_found']} not found")


if __name__ == "__main__":
    main()
