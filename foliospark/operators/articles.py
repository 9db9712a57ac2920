"""Article records from search results, with citations and full text looked up by identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import search
from foliospark.functions.text import first_usable, flag, join_list, url_of, usable
from foliospark.operators.ids import latest

RESULT = """id string, pmid string, pmcid string, source string, title string, authorString string, pubYear string,
doi string, license string, abstractText string, isOpenAccess string, citedByCount string, language string,
journalInfo struct<journal:struct<title:string,medlineAbbreviation:string>>,
pubTypeList struct<pubType:array<string>>, keywordList struct<keyword:array<string>>, inEPMC string, firstPublicationDate string"""

TEXT_SOURCES = ("epmc", "epmc_my", "ncbi", "ncbi_my")
#: Licenses without derivatives, in lower case.
DENIED = ("cc", "cc by-nd", "cc by-nc-nd")
#: Sources of the flat table, and the address of a record.
SOURCES = ("MED", "PMC")
ADDRESS = "https://pubmed.ncbi.nlm.nih.gov/"


def file_id(pmcid: Column, pmid: Column, other: Column) -> Column:
    return first_usable(pmcid, pmid, other)


def article_records(results: DataFrame) -> DataFrame:
    """Article rows, and ord where results have one; those without any identifier drop out."""
    order = [c for c in ("ord",) if c in results.columns]
    return results.where(usable(file_id(F.col("pmcid"), F.col("pmid"), F.col("id"))).isNotNull()).select(
        *order, file_id(F.col("pmcid"), F.col("pmid"), F.col("id")).alias("file_id"),
        "id", "pmid", "pmcid", url_of(ADDRESS, F.col("pmid"), "/").alias("url"), "title", F.col("authorString").alias("authors"),
        F.col("journalInfo.journal.title").alias("journal"), F.col("pubYear").alias("year"), "doi", "license", F.col("abstractText").alias("abstract"),
    )


def with_citations(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """citations: (pmid, citation struct<apa, apa_short>), one row a pmid. No usable pmid: null."""
    keyed = articles.withColumn("__pmid", usable(F.col("pmid")))
    found = citations.select(F.col("pmid").alias("__pmid"), "citation")
    return keyed.join(found, "__pmid", "left").drop("__pmid")


def with_text(articles: DataFrame, texts: DataFrame, source: str | None = None) -> DataFrame:
    """texts: (pmcid, text_sections, text_passages, text_error), one row a pmcid. Without a source, nulls."""
    if source is None:
        kinds = {f.name: f.dataType for f in texts.schema.fields}
        return articles.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in texts.columns if c != "pmcid"])
    if source not in TEXT_SOURCES:
        raise ValueError(f"text source {source!r} is none of {', '.join(TEXT_SOURCES)}")
    return articles.join(texts, "pmcid", "left")


def last_written(articles: DataFrame, order: str) -> DataFrame:
    """Of records that share a file id the last."""
    return latest(articles, "file_id", F.col(order))


def flat_table(results: DataFrame) -> DataFrame:
    """The nine-column literature table of the two article sources."""
    journal = F.col("journalInfo.journal")
    return results.where(F.col("source").isin(*SOURCES)).select(
        "pmcid", flag(F.col("isOpenAccess"), "Y").alias("is_open_access"), F.col("citedByCount").try_cast("int").alias("cited_by_count"), "language",
        join_list(F.col("pubTypeList.pubType"), ";").alias("pub_type_list"), F.col("pubYear").alias("pub_year"),
        F.coalesce(journal["medlineAbbreviation"], journal["title"]).alias("journal"), "title", join_list(F.col("keywordList.keyword"), ";").alias("keywords"),
    )


#: Fields of the search language and where results hold them.
FIELDS = {
    "SRC": "source", "LICENSE": "license", "LANG": "language", "PUB_YEAR": "pubYear", "JOURNAL": "journalInfo.journal.title", "PUB_TYPE": "pubTypeList.pubType",
    "OPEN_ACCESS": "isOpenAccess", "HAS_FT": "inEPMC", "FIRST_PDATE": "firstPublicationDate",
}


def found_by(query: str) -> Column:
    """What a search of the service's language finds, on results: their source, license, language, year, journal,
    publication types, first date and whether the service has their text as fields, title and abstract as text."""
    fields = {name: F.col(place) for name, place in FIELDS.items()}
    return search.condition(query, fields, [F.col("title"), F.col("abstractText")], lists=("PUB_TYPE",), dates=("FIRST_PDATE",))


def narrowed(query: str, by: str) -> str:
    """A search of the service that finds no less than what found_by(by) keeps of query's results: the parts of `by` that
    hold in any case and are of fields alone go along, as the service looks for bare words in more than title and abstract."""
    along = search.required(by, FIELDS)
    return " AND ".join(f"({p})" for p in ([query] if query.strip() else []) + along)


def capped(results: DataFrame, most: int, *order: Column) -> DataFrame:
    """At most `most` records, strictly; 0 or less means all."""
    return results.orderBy(*order).limit(most) if most > 0 else results


def keep_licensed(articles: DataFrame, license: str = "license", denied: tuple[str, ...] = DENIED) -> DataFrame:
    """Articles whose license isn't denied; those without one stay."""
    return articles.where(F.col(license).isNull() | ~F.lower(license).isin(*denied))
