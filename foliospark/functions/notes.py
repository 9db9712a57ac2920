"""Curator notes: the JSON of a gene's summary to HTML, and BioC JSON to passages. All built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import strip, usable

#: Fixed value: where the summary's tokens are.
TOKENS = "$[0].items[0].content[0].items[1].content[0].items"

BIOC = "array<struct<documents:array<struct<passages:array<struct<infons:map<string,string>,text:string>>>>>>"


def kind_of(value: Column) -> Column:
    """What a VARIANT holds: object, array, string, boolean, null or number; null where there is no value."""
    schema = F.schema_of_variant(value)
    named = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string")
    return F.when(schema.isNotNull(), named.when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").otherwise("number"))


def notes_html(json: Column, compat: bool = False) -> Column:
    """Tokens' text, else caption, concatenated and stripped; null for a missing path or nothing.

    Tokens are variants up to here, so what is no object is told apart (a string that looks like one as well) and
    skipped. A null text goes on to the caption; numbers, lists and objects contribute their JSON.
    compat: the key alone counts, so a null contributes the word None; booleans are spelled True and False.
    """
    tokens = F.try_variant_get(F.try_parse_json(json), TOKENS, "array<variant>")

    def spelled(token: Column, path: str) -> Column:
        value = F.try_variant_get(token, path, "variant")
        kind, own = kind_of(value), F.try_variant_get(token, path, "string")
        if compat:
            own = F.when(kind == "boolean", F.initcap(own)).when(kind == "null", "None").otherwise(own)
        return F.when(kind.isin("array", "object"), F.to_json(value)).otherwise(own)

    def text(t: Column) -> Column:
        return F.when(kind_of(t) == "object", F.coalesce(spelled(t, "$.text"), spelled(t, "$.caption")))

    return usable(strip(F.array_join(F.transform(tokens, text), "")))


def bioc_passages(json: Column) -> Column:
    """array<struct<section_type, text>> in document order; null for an error body, empty list or other JSON."""
    body = F.when(~F.startswith(F.ltrim(json), F.lit("[Error]")), json)
    listed = F.when(F.startswith(F.ltrim(body), F.lit("{")), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    documents = F.get(F.from_json(listed, F.lit(BIOC)), 0)["documents"]
    passages = F.flatten(F.transform(documents, lambda d: F.coalesce(d["passages"], F.array().cast("array<struct<infons:map<string,string>,text:string>>"))))
    return F.transform(passages, lambda p: F.struct(p["infons"]["section_type"].alias("section_type"), p["text"].alias("text")))
