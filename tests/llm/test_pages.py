import os
import random
from itertools import combinations

import pytest

from foliospark.llm import pages as P

SCHEMA = "page_id long, url string, html string"


def test_markup():
    html = """<!DOCTYPE html><title>no</title><nav><ul><li>Home</nav><div class="ad">Buy &amp; win</div><header>Head</header>
    <article><header><h1>Title&nbsp;here</h1></header><p>One <b>two</b>
      three<p>Four<br>five &lt;six&gt; &#x41;<script>if (a</p>) b</script><aside>side</aside><form>name <input></form>
      <ul><li>L1<li>L2</ul><!-- gone <p>x</p> --><section id="comments"><p>Nice!</section></article><footer>&copy;</footer>"""
    assert [t for t, _ in P.page_lines(html)] == ["Title here", "One two three", "Four five <six> A", "L1", "L2"]
    assert all(f for _, f in P.page_lines(html))


def test_odd_markup_ends():
    for html in ("<", "<p", "<p a='", "<!-- x", "<script>x", "<p>a</b></i>", "</p>", "a <b", "<div " * 2000, '<a t="' + "x" * 5000, "&" * 5000, "<" * 5000):
        P.page_lines(html)
    assert P.page_lines("1 < 2 and 3 > 2") == [("1 < 2 and 3 > 2", False)]


def brute_lcs(a, b):
    for n in range(min(len(a), len(b)), 0, -1):
        for i in combinations(range(len(a)), n):
            s = [a[k] for k in i]
            it = iter(b)
            if all(v in it for v in s):
                return n
    return 0


def test_shared_lines_are_a_longest_common_subsequence():
    for a, b in [("abcde", "xbydz"), ("abcd", "dcba"), ("", "a"), ("abc", "abc"), ("axbxc", "abc"), ("qwer", "wqre")]:
        pairs = P.shared_lines(list(a), list(b))
        assert len(pairs) == brute_lcs(a, b) and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def site(n, host="h.com"):
    return [(i, f"https://{host}/a/{i}", f"<div>Site</div><div>Text {i} of a page with words of its own</div><p>More {i} words, also its own</p><div>(c) all</div>") for i in range(n)]


def test_shared_lines_go_and_articles_stay(spark):
    rows = site(9) + [(50, None, None), (51, "x", "plain &lt;text&gt;"), (52, "https://h.com/a/4", site(5)[4][2]), (53, "https://o.com/1", "<p>alone</p>"), (54, "", "")]
    got = {r.page_id: r for r in P.extract(spark.createDataFrame([r + ("z",) for r in rows], SCHEMA + ", host string")).collect()}
    assert len(got) == len(rows)
    for i in range(9):
        assert got[i].text == f"Text {i} of a page with words of its own\nMore {i} words, also its own" and got[i].n_chars == len(got[i].text)
    assert got[52].text == got[4].text
    assert [got[k].text for k in (50, 51, 53, 54)] == ["", "plain <text>", "alone", ""]
    # a paragraph that two articles quote isn't frame
    quoted = [(i, f"https://q.com/{i}", f"<article><p>Quote</p><p>Own words of page {i} that fill it</p></article>") for i in range(3)]
    assert all(r.text.startswith("Quote\n") for r in P.extract(spark.createDataFrame(quoted, SCHEMA)).collect())
    assert P.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_across_task_borders(spark):
    """Whatever the partitions, the same neighbours."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = P.extract(spark.createDataFrame(site(60), SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert all(r.text.count("\n") == 1 for r in got)


def test_frames_in_containers_go_and_lower_containers_stay(spark):
    body = ["<div>Menu of the site</div><p>Words of page {i} that are all its own</p>", "<h1>Head {i} of a page</h1><p>Words of page {i} that are all its own</p><article>Card {i}</article>"]
    rows = [(i, f"https://c.com/{i}", f'<div id="main-content">{body[0].format(i=i)}</div>') for i in range(4)]
    rows += [(10 + i, f"https://m.com/{i}", f"<div>out</div><main>{body[1].format(i=i)}</main>") for i in range(4)]
    got = {r.page_id: r.text for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Words of page {i} that are all its own" for i in range(4))
    assert all(got[10 + i] == f"Head {i} of a page\nWords of page {i} that are all its own\nCard {i}" for i in range(4))


def test_long_frames_and_runs_of_copies(spark):
    menu = "".join(f"<div>Entry {k} of a long menu</div>" for k in range(20))
    rows = [(i, f"https://l.com/{i}", f"{menu}<p>Short article number {i}, all its own words</p>") for i in range(4)]
    page = "<div>Site</div><p>{text}</p><p>{date}</p><div>(c) all</div>"
    rows += [(100 + i, f"https://r.com/b{i:02}", page.format(text="The same words on many pages " * 4, date=f"May {i}")) for i in range(30)]
    rows += [(200, "https://r.com/z", page.format(text="Words that are on no other page of the site", date="June"))]
    for parts in ("8", "20"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r.page_id: r.text for r in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert all(got[i] == f"Short article number {i}, all its own words" for i in range(4))
        assert all(got[100 + i] == ("The same words on many pages " * 4).strip() + f"\nMay {i}" for i in range(30))
        assert got[200] == "Words that are on no other page of the site\nJune"


def brute_extract(rows):
    """Whole page sets in plain Python: distinct pages of a host in order, each against the nearest on both sides that is no copy."""
    pages = {}
    for i, url, html in rows:
        lines = P.block_lines(html)
        host, _, path = url.removeprefix("https://").partition("/")
        pages.setdefault((host, str(lines)), [path, lines, []])[2].append(i)
        pages[host, str(lines)][0] = min(pages[host, str(lines)][0], path)
    out = {}
    for host in {h for h, _ in pages}:
        order = sorted((x for (h, _), x in pages.items() if h == host), key=lambda x: x[0])
        as_page = lambda x: {"hashes": [t for t, _ in x[1]], "sizes": [len(t) for t, _ in x[1]], "levels": [v for _, v in x[1]]}
        for k, page in enumerate(order):
            frame = set()
            for side in (reversed(order[:k]), order[k + 1 :]):
                frame |= set(next((f for q in side if (f := P.frame_of(as_page(page), as_page(q))) is not None), ()))
            inside = any(v > 0 for _, v in page[1])
            text = "\n".join(t for j, (t, v) in enumerate(page[1]) if j not in frame and v >= (1 if inside else 0))
            out.update({i: (text, len(frame)) for i in page[2]})
    return out


def test_page_sets_equal_brute_force(spark):
    r = random.Random(2)
    words = "one two three four five six seven".split()
    rows = []
    for i in range(120):
        host = r.choice(["a.com", "b.com", "b.com"])
        own = [" ".join(r.choices(words, k=9)) + f" {i}" for _ in range(r.randint(1, 4))]
        body = "".join(f"<p>{x}</p>" for x in own)
        wrap = r.choice(["{}", "<main>{}</main>", "<article>{}</article>", "<div class=content><div>Often here</div>{}</div>"])
        rows.append((i, f"https://{host}/{i:03}", f"<nav><li>Home</li><li>{host}</li></nav><div>Welcome to {host}</div>{wrap.format(body)}<div class=comments><p>reply {i}</p></div><footer>(c) {host}</footer>"))
    rows += [(500 + k, "https://b.com/050x", rows[50][2]) for k in range(3)]
    got = {x.page_id: (x.text, x.n_frame) for x in P.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_extract(rows) and sum(n for _, n in got.values()) > 300


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_names_of_elements_hardly_matter(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got, bare = ({x.page_id: x.text for x in P.extract(pages, named).collect()} for named in (True, False))
    assert sum(got[i] == bare[i] for i in got) >= 0.95 * len(got)


def test_short_texts_in_long_frames(spark):
    frame = ["A menu of the site that is longer than the text of it", "A foot of the site that is much longer than the text is"]
    rows = [(i, f"https://s.com/{i}", f"<div>{frame[0]}</div><p>Own text {i:03}</p><div>{frame[1]}</div>") for i in range(4)]
    assert all(x.text == f"Own text {x.page_id:03}" and x.n_frame == 2 for x in P.extract(spark.createDataFrame(rows, SCHEMA)).collect())
