"""Citations: fields out of PubMed XML by an Arrow UDF, formatting by built-in functions."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import head_of, usable

FIELDS = T.StructType(
    [T.StructField("found", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("title", "journal", "year", "volume", "issue", "pages", "doi")]
    + [T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]
)
#: What stands for a missing article and a missing year.
NOT_FOUND, NO_YEAR = "Article not found.", "n.d."


def _whole(node: ET.Element) -> str:
    return "".join(node.itertext())


#: Fields by the element that holds them.
_PARTS = {
    "Journal": (("journal", "Title"),),
    "PubDate": (("year", "Year"),),
    "JournalIssue": (("volume", "Volume"), ("issue", "Issue")),
    "Pagination": (("pages", "MedlinePgn"),),
}


def fields(xml: str | None, compat: bool = False) -> dict:
    """The fields of a record's first article, by one walk over its elements; of several elements the first that has
    the part counts. compat: a title ends at its first inline element."""
    out = dict.fromkeys(FIELDS.names) | {"found": False, "authors": []}
    if xml is None:
        return out
    try:
        article = ET.fromstring(xml).find(".//PubmedArticle")
    except ET.ParseError as e:
        return out | {"error": str(e)}
    if article is None:
        return out
    out["found"] = True
    for node in article.iter():
        tag = node.tag
        if tag == "Author":
            last, initials = node.findtext("LastName"), node.findtext("Initials")
            if last and initials:
                out["authors"].append(f"{last}, {initials}.")
        elif tag == "ArticleTitle":
            if out["title"] is None:
                out["title"] = node.text or "" if compat else _whole(node)
        elif tag == "ArticleId":
            if out["doi"] is None and node.get("IdType") == "doi":
                out["doi"] = node.text or ""
        else:
            for name, child in _PARTS.get(tag, ()):
                if out[name] is None:
                    out[name] = node.findtext(child)
    out["year"] = out["year"] or NO_YEAR
    return out


_ARROW = pa.struct([(f.name, pa.bool_() if f.name == "found" else pa.list_(pa.string()) if f.name == "authors" else pa.string()) for f in FIELDS])


@F.arrow_udf(FIELDS)
def pubmed_fields(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in batches:
        yield pa.array([fields(x) for x in a.to_pylist()], _ARROW)


@F.arrow_udf(FIELDS)
def pubmed_fields_compat(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in batches:
        yield pa.array([fields(x, True) for x in a.to_pylist()], _ARROW)


def author_list(authors: Column) -> Column:
    """None; one; up to seven with an ampersand before the last; of more the first six, dots and the last."""
    n, last = F.size(authors), F.try_element_at(authors, F.lit(-1))
    return (
        F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(""))
        .when(n == 1, F.get(authors, 0))
        .when(n <= 7, F.concat(F.array_join(F.slice(authors, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), last))
        .otherwise(F.concat(F.array_join(F.slice(authors, 1, 6), ", "), F.lit(", ... "), last))
    )


def short_names(authors: Column) -> Column:
    """The first author's last name, two joined, or et al.; null without authors."""
    n, first = F.size(authors), head_of(F.get(authors, 0))
    return F.when(n == 1, first).when(n == 2, F.concat(first, F.lit(" & "), head_of(F.get(authors, 1)))).when(n > 2, F.concat(first, F.lit(" et al.")))


def apa(f: Column, compat: bool = False) -> Column:
    """struct<apa, apa_short> of a struct of FIELDS. A missing part is left out; compat writes None for
    a missing title, journal or volume."""
    part = (lambda c: F.coalesce(c, F.lit("None"))) if compat else (lambda c: F.coalesce(c, F.lit("")))
    names = author_list(f["authors"])
    volume = F.concat(F.lit(", "), part(f["volume"])) if compat else F.coalesce(F.concat(F.lit(", "), usable(f["volume"])), F.lit(""))
    full = F.concat(
        names, F.lit(" ("), f["year"], F.lit("). "), part(f["title"]), F.lit(". *"), part(f["journal"]), F.lit("*"), volume,
        F.coalesce(F.concat(F.lit("("), usable(f["issue"]), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(", "), usable(f["pages"])), F.lit("")),
        F.coalesce(F.concat(F.lit(". https://doi.org/"), usable(f["doi"])), F.lit(".")),
    )
    short = F.concat(F.lit("("), F.coalesce(short_names(f["authors"]), part(f["journal"])), F.lit(", "), f["year"], F.lit(")"))
    missing = F.lit(NOT_FOUND)
    return F.struct(F.when(f["found"], full).otherwise(missing).alias("apa"), F.when(f["found"], short).otherwise(missing).alias("apa_short"))
