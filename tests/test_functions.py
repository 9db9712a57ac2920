"""Functions and parsers on hand-made rows."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from foliospark.functions import citation, html, jats, notes, search, text
from foliospark.operators.sections import merge_sections
from foliospark.session import spread


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_white_space_is_as_python_has_it(spark):
    values = ["  a \u0085b \x1c c\t", "", None, " \n "]
    assert column(spark, values, text.squeeze) == [None if v is None else " ".join(v.split()) for v in values]
    assert column(spark, values, text.strip) == [None if v is None else v.strip() for v in values]


def test_first_usable_passes_over_empty_strings(spark):
    df = spark.createDataFrame([("", "b", "c"), (None, "", "c"), ("a", None, None), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(text.first_usable(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["b", "c", "a", None]


def test_lists_join_nulls_as_empty(spark):
    assert column(spark, [["a", None, "b"], [], None], lambda c: text.join_list(c, ";"), "array<string>") == ["a;;b", "", None]


def test_flag_of_null_is_zero(spark):
    assert column(spark, ["Y", "N", None], lambda c: text.flag(c, "Y")) == [1, 0, 0]


def test_html_chain_and_parser_agree(spark):
    values = ["<p>a &amp;lt; b</p><script>var x='</p>';</script> c", "<style>p{}</style>x<!-- y -->&copy;", "", None]
    assert column(spark, values, html.html_to_text) == ["a &lt; b c", "x ©", "", None]
    assert column(spark, values, html.html_parser_text) == ["a &lt; b c", "x ©", "", None]


def note(tokens):
    return json.dumps([{"items": [{"content": [{"items": ["title", {"content": [{"items": tokens}]}]}]}]}])


def test_notes_json(spark):
    values = [note([{"text": "<i>abc</i> "}, {"caption": "cap"}, {"text": None, "caption": "z"}, {"x": 1}, "bare", {"text": 5}]), "[]", "{", None, note([{"text": "  "}])]
    assert column(spark, values, notes.notes_html) == ["<i>abc</i> capz5", None, None, None, None]
    assert column(spark, values[:1], lambda c: notes.notes_html(c, compat=True)) == ["<i>abc</i> capNone5"]


def test_bioc(spark):
    doc = {"documents": [{"passages": [{"infons": {"section_type": "T"}, "text": "a"}, {"text": "b"}]}, {"passages": [{"infons": {}, "text": "c"}]}]}
    values = [json.dumps([doc]), json.dumps(doc), "[]", "[Error] : no", None]
    one = [("T", "a"), (None, "b"), (None, "c")]
    got = column(spark, values, notes.bioc_passages)
    assert [None if r is None else [tuple(x) for x in r] for r in got] == [one, one, None, None, None]


JATS = """<!DOCTYPE x><pmc><article><front><article-meta><title-group><article-title>H<sub>2</sub>O</article-title></title-group>
<abstract><p>one</p></abstract><abstract><title>Key</title><p>two</p><sec><p>inner</p></sec></abstract></article-meta></front>
<body><p>pre</p><sec><title>A</title><p>x</p><sec><title>B</title><p>y</p></sec></sec><sec><title>A</title><label>1</label><p>z</p></sec><sec><p>u</p></sec><sec><title>E</title></sec></body></article></pmc>"""


def test_jats_sections(spark):
    docs = spark.createDataFrame([(1, JATS), (2, "<broken"), (3, "<other/>"), (4, None)], "k int, x string")
    rows = jats.jats_paragraphs(docs, "k", "x")
    merged = {r.k: [(s.section, s.paragraphs) for s in r.text_sections] for r in merge_sections(rows, "k").collect()}
    assert merged == {1: [("Title", ["H 2 O"]), ("Abstract 1", ["one"]), ("Key", ["two"]), ("Key subsection", ["inner"]), ("Body (untitled)", ["pre"]), ("A", ["x", "z"]), ("B", ["y"]), ("Untitled Section", ["u"])]}
    assert [r.k for r in rows.where("error is not null").collect()] == [2]


def by_tree(xml):
    """(section, paragraphs) read from the whole tree."""
    import xml.etree.ElementTree as ET

    text = lambda n: " ".join(" ".join(n.itertext()).split())
    root = ET.fromstring(xml)
    top = root if root.tag.endswith("article") else root.find(".//article")
    if top is None:
        return []
    out = []
    titles = top.findall("./front/article-meta/title-group/article-title") or top.findall("./front/article-meta/title-group/trans-title-group/trans-title")
    if titles and text(titles[0]):
        out.append(("Title", [text(titles[0])]))
    children = lambda n: [t for t in (text(c) for c in n if not c.tag.endswith(("title", "label", "sec"))) if t]
    title = lambda n: text(n.find("title")) if n.find("title") is not None else ""
    found = top.findall("./front/article-meta/abstract") + top.findall("./front/article-meta/trans-abstract")
    for i, a in enumerate(found, 1):
        key = title(a) or ("Abstract" if len(found) == 1 else f"Abstract {i}")
        out.append((key, children(a)))
        out += [(title(s) or f"{key} subsection", children(s)) for s in a.findall("sec")]

    def walk(sec):
        out.append((title(sec) or "Untitled Section", children(sec)))
        for s in sec.findall("sec"):
            walk(s)

    body = top.find("body")
    if body is not None:
        before = []
        for c in body:
            if c.tag.endswith("sec"):
                break
            before += [text(c)] if not c.tag.endswith("title") and text(c) else []
        out.append(("Body (untitled)", before))
        for s in body.findall("sec"):
            walk(s)
    return [(k, p) for k, p in out if p]


def random_article(draw):
    def words():
        return "".join(draw.choices(["a", "b ", "<i>c</i>", " ", "<sup>2</sup>", "&amp;", "\n", "é"], k=draw.randrange(5)))

    def section(depth):
        parts = []
        for _ in range(draw.randrange(5)):
            kind = draw.choice(["p", "p", "title", "label", "sec", "subtitle", "fig", "boxsec"])
            if kind == "sec":
                parts.append(f"<sec>{section(depth - 1)}</sec>" if depth else "")
            else:
                parts.append(f"<{kind}>{words()}<sec><title>in</title><p>{words()}</p></sec></{kind}>" if draw.random() < 0.15 else f"<{kind}>{words()}</{kind}>tail")
        return "".join(parts)

    title = draw.choice(["", f"<article-title>{words()}</article-title>", f"<trans-title-group><trans-title>{words()}</trans-title></trans-title-group>", f"<article-title> </article-title><trans-title-group><trans-title>{words()}</trans-title></trans-title-group>"])
    abstracts = "".join(f"<{k}>{section(1)}</{k}>" for k in draw.choices(["abstract", "trans-abstract"], k=draw.randrange(4)))
    front = f"<front><journal-meta><p>no</p></journal-meta><article-meta><title-group>{title}</title-group>{abstracts}</article-meta></front>"
    back = "<back><sec><title>R</title><p>no</p></sec></back><sub-article><front><article-meta/></front><body><p>no</p></body></sub-article>"
    article = f"<article>{front}{draw.choice(['', f'<body>{section(3)}</body>'])}{back}</article>"
    return draw.choice([article, f"<pmc-set><other><p>x</p></other>{article}{article}</pmc-set>", article.replace("<article>", "<my-article>", 1).replace("</article>", "</my-article>")])


def test_events_equal_the_tree(monkeypatch):
    import random

    draw = random.Random(7)
    for i in range(1500):
        xml = random_article(draw)
        monkeypatch.setattr(jats, "BLOCK", draw.choice([3, 50, 100_000]))
        assert jats.sections(xml) == by_tree(xml), xml


def test_long_articles_hold_a_section_at_a_time():
    import tracemalloc

    xml = "<article><body>" + "".join(f"<sec><title>S{i % 5}</title>" + "<p>" + "word " * 200 + "</p>" * 1 + "</sec>" for i in range(4000)) + "</body></article>"
    tracemalloc.start()
    n = sum(1 for _ in jats.paragraph_rows(xml))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 and peak < len(xml) / 4


def test_jats_table_function(spark):
    spark.udtf.register("jats_sections", jats.JatsSections)
    spark.createDataFrame([(1, JATS), (2, None)], "k int, x string").createOrReplaceTempView("articles_x")
    rows = spark.sql("select k, s.section, s.paragraph from articles_x, lateral jats_sections(x) s").collect()
    assert {r.section for r in rows} >= {"Title", "Key", "B"} and {r.k for r in rows} == {1}


@pytest.mark.parametrize("compat", [False, True])
def test_notes_tell_kinds_of_tokens(spark, compat):
    import json

    tokens = ['{"text": "a"}', '{"text": null, "caption": "b"}', '{"text": 5}', '{"text": true}', '{"text": ["x", 1]}', '{"text": {"k": 1}}', '"{\\"text\\": \\"no\\"}"', "7", "null", '["text"]', '{"caption": "c", "text": ""}', '{"other": 1}', '{"caption": null}']
    made = [json.dumps([{"items": [{"content": [{"items": ["t", {"content": [{"items": [json.loads(t)]}]}]}]}]}]) for t in tokens]
    got = column(spark, made, lambda c: notes.notes_html(c, compat))
    odd = ["None", "None"] if compat else ["b", None]
    assert got == ["a", odd[0], "5", "True" if compat else "true", '["x",1]', '{"k":1}', None, None, None, None, None, None, odd[1]]
    assert column(spark, tokens[:1] + ["[1", "1.5", '"s"', "[]", "null", "true", None], lambda c: notes.kind_of(F.try_parse_json(c))) == ["object", None, "number", "string", "array", "null", "boolean", None]


@pytest.mark.parametrize(
    "n, full, short",
    [
        (0, "", None), (1, "A0, X.", "A0"), (2, "A0, X., & A1, X.", "A0 & A1"), (3, "A0, X., A1, X., & A2, X.", "A0 et al."),
        (7, "A0, X., A1, X., A2, X., A3, X., A4, X., A5, X., & A6, X.", "A0 et al."), (8, "A0, X., A1, X., A2, X., A3, X., A4, X., A5, X., ... A7, X.", "A0 et al."),
    ],
)
def test_author_lists(spark, n, full, short):
    people = [[f"A{i}, X." for i in range(n)]]
    assert column(spark, people, citation.author_list, "array<string>") == [full]
    assert column(spark, people, citation.short_names, "array<string>") == [short]


def pubmed(**parts):
    return f"""<!DOCTYPE PubmedArticleSet><PubmedArticleSet><PubmedArticle><Article><ArticleTitle>{parts.get('title', 'On <i>D. disc.</i>')}</ArticleTitle><Journal><Title>J</Title><JournalIssue>{parts.get('issue', '')}<PubDate>{parts.get('year', '')}</PubDate></JournalIssue></Journal>
    <AuthorList><Author><LastName>Doe</LastName><Initials>J</Initials></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList></Article><PubmedData><ArticleIdList>{parts.get('ids', '')}</ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"""


def test_citations(spark):
    values = [pubmed(issue="<Volume>4</Volume><Issue>2</Issue>", year="<Year>2001</Year>", ids='<ArticleId IdType="doi">10.1/x</ArticleId>'), pubmed(), "<PubmedArticleSet/>", "<bad", None]
    got = column(spark, values, lambda c: citation.apa(citation.pubmed_fields(c)))
    assert tuple(got[0]) == ("Doe, J. (2001). On D. disc.. *J*, 4(2). https://doi.org/10.1/x", "(Doe, 2001)")
    assert tuple(got[1]) == ("Doe, J. (n.d.). On D. disc.. *J*.", "(Doe, n.d.)")
    assert [tuple(g) for g in got[2:]] == [("Article not found.",) * 2] * 3
    compat = column(spark, values[1:2], lambda c: citation.apa(citation.pubmed_fields_compat(c), compat=True))
    assert compat[0].apa == "Doe, J. (n.d.). On . *J*, None."


@pytest.mark.parametrize(
    "query, want",
    [
        ("amoeba", [1, 2]), ("amoeba yeast", [2]), ("amoeba OR yeast", [1, 2, 3]), ("NOT amoeba", [3, 4]), ("amoeba NOT yeast", [1]), ('"social amoeba"', [1]), ("(SRC:MED OR SRC:pmc) AND amoeba", [1, 2]),
        ("YEAR:[2000 TO 2010]", [1, 3]), ('yeast NOT (TYPES:"Review")', [3]), ("TYPES:review", [2]), ("NOT SRC:MED", [2, 3, 4]), ("SRC:MED OR SRC:PMC amoeba", [1, 2]),
    ],
)
def test_search_language(spark, query, want):
    rows = [(1, "The social Amoeba", "MED", "2001", ["Article"]), (2, "yeast and amoeba", "PMC", "2011", ["Review", "Article"]), (3, "Yeast", "AGR", "2010", None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, t string, src string, year string, types array<string>")
    c = search.condition(query, {"SRC": F.col("src"), "YEAR": F.col("year"), "TYPES": F.col("types")}, [F.col("t")], lists=["TYPES"])
    assert sorted(r.k for r in df.where(c).collect()) == want


@pytest.mark.parametrize("query", ["", "(a", "a)", "a AND", "OR a", "NO:b", "[1 TO 2]", "a : b"])
def test_searches_that_cannot_be_read(spark, query):
    with pytest.raises(ValueError):
        search.condition(query, {"SRC": F.col("src")}, [F.col("t")])


def test_fields_are_of_the_first_element_that_has_them():
    """One walk finds what searches by path find, for elements that come twice, are empty, or stand elsewhere."""
    xml = (
        '<Set><PubmedArticle><Title>not a journal</Title><ArticleId IdType="pubmed">1</ArticleId><Journal><ISOAbbreviation>x</ISOAbbreviation></Journal><Journal><Title>J</Title></Journal><Journal><Title>K</Title></Journal>'
        "<JournalIssue><Issue/></JournalIssue><JournalIssue><Volume>3</Volume><Issue>4</Issue><PubDate><Year/></PubDate><PubDate><Year>2001</Year></PubDate></JournalIssue>"
        "<Year>1999</Year><ArticleTitle><i>A</i> b</ArticleTitle><ArticleTitle>second</ArticleTitle>"
        "<Author><LastName>C</LastName><Initials>D</Initials><LastName>E</LastName></Author><Author><LastName/><Initials>F</Initials></Author>"
        '<ArticleId IdType="doi"/><ArticleId IdType="doi">10.1/2</ArticleId></PubmedArticle><PubmedArticle><Pagination><MedlinePgn>9</MedlinePgn></Pagination></PubmedArticle></Set>'
    )
    article = ET.fromstring(xml).find(".//PubmedArticle")
    paths = {"journal": ".//Journal/Title", "volume": ".//JournalIssue/Volume", "issue": ".//JournalIssue/Issue", "pages": ".//Pagination/MedlinePgn", "doi": ".//ArticleId[@IdType='doi']"}
    got = citation.fields(xml)
    assert {n: got[n] for n in paths} == {n: article.findtext(p) for n, p in paths.items()} == {"journal": "J", "volume": "3", "issue": "", "pages": None, "doi": ""}
    assert (got["year"], got["title"], got["authors"], got["found"]) == ("n.d.", "A b", ["C, D."], True)
    assert citation.fields(xml, compat=True)["title"] == article.findtext(".//ArticleTitle") == ""
    assert citation.fields("<Set><PubmedArticle/></Set>")["title"] is None and not citation.fields("<Set/>")["found"] and citation.fields("<Set>")["error"]


def test_spread_deals_small_tables_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, cores + 3)
    assert spread(few).rdd.getNumPartitions() == cores and sorted(r.id for r in spread(few).collect()) == list(range(100))
    assert spread(many) is many
