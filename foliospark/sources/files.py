"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = """id string, pmid string, pmcid string, url string, title string, authors string, journal string, year string,
doi string, license string, citation struct<apa:string,apa_short:string>, abstract string, text string"""
STATUS = "column_1 string, column_2 string"
SENTENCES = "pmcid string, section string, paragraph int, seq long, text string"
MAPPING = "gene_name string, prediction_id string, curated_model_id string, created date"
NOTES = "gene_id string, curator_notes_html string, curator_notes_plain string, status string"


def file_name() -> Column:
    """The name of the file that a row was read from, as the file system has it (Spark gives names as in an address)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False, strict: bool = False) -> DataFrame:
    """Tab-separated rows, quotes being ordinary. Longer rows are cut and shorter ones filled with null,
    or, if strict, fail."""
    return spark.read.csv(path, schema=schema, sep="\t", quote="", header=header, enforceSchema=not header, mode="FAILFAST" if strict else "PERMISSIVE")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, STATUS)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Gene to curated model, the latest first."""
    return read_tsv(spark, path, MAPPING).orderBy(F.desc("created"))


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of full texts, a JSON object a line: pmcid, section, paragraph, seq (the place in its text), text."""
    return spark.read.schema(SENTENCES).json(path)


def read_articles(spark: SparkSession, path: str, schema: str = ARTICLE) -> tuple[DataFrame, DataFrame]:
    """(articles, malformed files) of a folder of indented .json files, each with file_name. The text,
    which has several shapes, stays JSON: null where it is JSON null. The id of a malformed file is what
    could be read of it (Spark wants a parsed column beside the corrupt record)."""
    full = f"{schema}, _corrupt_record string"
    def read(glob: str, whole: bool) -> DataFrame:
        return spark.read.schema(full).json(path, multiLine=whole, pathGlobFilter=glob, mode="PERMISSIVE").select("*", file_name().alias("file_name"))

    # what write_articles left has an article a line, any other file is one article
    rows = read("*.json", True).where("file_name not like 'part-%'").unionByName(read("part-*.json", False))
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("file_name", F.col("_corrupt_record").alias("content"), "id")


def append_parquet(rows: DataFrame, path: str, batch: int = 0, schema: str = NOTES) -> None:
    """Adds rows, at most `batch` a file if that isn't 0; the fixed schema lets a batch of nulls stand beside others."""
    kinds = rows.sparkSession.createDataFrame([], schema).schema
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]).write.mode("append").option("maxRecordsPerFile", batch).parquet(path)


def write_articles(articles: DataFrame, path: str, gzip: bool = False) -> None:
    writer = articles.write.option("ignoreNullFields", "false")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.option("header", True).csv(path)


def write_abstracts(articles: DataFrame, path: str) -> None:
    """A line an article with an abstract, its line breaks as spaces."""
    articles.where("abstract is not null").select(F.regexp_replace("abstract", "[\\r\\n]+", " ").alias("value")).write.text(path)
