"""Ordered sections and paragraphs: merging by title, from sentence tables, from plain text.

Order is carried in columns and restored by sorting arrays of structs; maps don't keep it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import squeeze


def merge_sections(paragraphs: DataFrame, key: str) -> DataFrame:
    """(key, ord, section, para_ord, paragraph) to one row a document: sections of one title become
    one, at the place of the first, with paragraphs in document order."""
    one = paragraphs.where("section is not null").groupBy(key, "section").agg(
        F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "para_ord", "paragraph"))).alias("p")
    )
    whole = one.select(key, F.struct("ord", "section", F.col("p.paragraph").alias("paragraphs")).alias("s"))
    return whole.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("text_sections"))


def sentence_paragraphs(sentences: DataFrame, key: str) -> DataFrame:
    """(key, section, paragraph, seq, text) to (key, section, paragraph, seq, body), sentences joined by spaces in order."""
    return sentences.groupBy(key, "section", "paragraph").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ", "").alias("body"), F.min("seq").alias("seq")
    )


def sentence_sections(sentences: DataFrame, key: str) -> DataFrame:
    """Section rows of a sentence table: (key, section, ord, paragraphs) by paragraph order; ord is the
    first sentence's place."""
    return sentence_paragraphs(sentences, key).groupBy(key, "section").agg(
        F.min("seq").alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "body"))), lambda s: s["body"]).alias("paragraphs")
    )


def paragraphs_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, para): lines with white space squeezed, blank ones left out."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.select(key, F.col("pos").cast("long").alias("pos"), squeeze(F.col("line")).alias("para")).where("para <> ''")
