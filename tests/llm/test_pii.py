import collections
import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import pii as P

#: The four base patterns as the contract writes them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            bad = k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (12 <= len(d) <= 19 and P.luhn(d)) or k == "phone" and not 9 <= len(d) <= 15
            if not bad:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text("ab@.-1230 +(%5é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_luhn_and_cards():
    assert P.base_spans("a 4539 1488 0343 6467 b") == [(2, 21, "card")]
    assert P.base_spans("4539148803436468") == []


def test_long_texts_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "@a." * 100_000):
        P.base_spans(text)


def test_contexts_find_unseen_identifiers(spark, odd):
    rows = [(i, f"My phone number is +1 (555) 0{i}0-12{i}4 today", 7) for i in range(10, 30)]
    rows += [(100 + i, f"the phone number is 555-77{i}-1234 ok", 7) for i in range(10, 15)] + [(300, "order 555-9999-1234 was sent", 7)]
    rows += [(200, None, 7), (201, "", 7), (201, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = {r.doc_id: r for r in P.find_personal_data(docs).collect()}
    assert all(got[i].spans == "phone:20:33" and got[i].n_phone == 0 and got[i].n_added == 1 for i in range(110, 115))
    assert all(got[i].spans == f"phone:19:{19 + len(f'+1 (555) 0{i}0-12{i}4')}" and got[i].n_phone == 1 for i in range(10, 30))
    assert got[200].base_sha256 == hashlib.sha256(b"").hexdigest() and got[200].spans == "" and got[300].spans == ""
    masked = P.redact(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[10] == "My phone number is [PHONE] today" and texts[110] == "the phone number is [PHONE] ok" and texts[200] is None and texts[300].startswith("order 555")
    assert P.redact(odd).schema.names == odd.schema.names and P.redact(odd).count() == odd.count()
    assert P.find_personal_data(odd).count() == odd.count() and P.find_personal_data(odd.limit(0)).count() == 0


def test_found_identifiers_teach_further_contexts(spark):
    """'call me on _' occurs with no base phone, only with phones that 'phone number is _' finds."""
    rows = [(i, f"My phone number is +1 (555) 0{i}0-12{i}4 today") for i in range(10, 30)]
    rows += [(100 + i, f"the phone number is 555-77{i}-1234 ok") for i in range(10, 16)]
    rows += [(200 + i, f"please call me on 555-77{i}-1234 soon") for i in range(10, 16)]
    rows += [(300, "please call me on 555-881-9876 soon"), (302, "order 555-883-9876 was sent")]
    got = {r.doc_id: r for r in P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[300].spans == "phone:18:30" and got[302].spans == ""
    assert all(got[200 + i].spans == "phone:18:31" for i in range(10, 16))


def test_overlapping_spans_mask_together():
    assert P.masked("ab 12 cd", [(3, 5, "card"), (3, 4, "ip")]) == "ab [IP] cd"


def test_secrets_and_what_their_contexts_find(spark):
    """Random strings are seeds; other values assigned to the same names are found by them, others aren't."""
    rows = [(i, f'then token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and words') for i in range(12)]
    rows += [(100, 'then token = "hunter-two" and words'), (101, "color = blue-green and words"), (102, 'TOKEN: "Open Sesame now" words')]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.find_personal_data(docs).collect()}
    assert all(got[i].spans == "secret:14:54" and got[i].n_spans == got[i].n_secrets == 1 and got[i].n_added == 0 for i in range(12))
    assert got[100].spans == "secret:14:24" and got[101].spans == "" and got[102].spans == "secret:8:23"
    assert {r.doc_id: r.text for r in P.redact(docs).collect()}[100] == 'then token = "[SECRET]" and words'


def test_rounds_equal_brute_force(spark):
    """The graph's rounds in plain Python, over mentions drawn at random."""
    r = random.Random(6)
    mentions = set()
    for i in range(400):
        seed = i < 330
        own = r.choices(["call _", "phone _", "fax _", "id _", "ref _", "no _", "tel _"], weights=[9, 9, 1, 0.2, 0.2, 0.2, 1] if i % 2 else [0.2, 0.2, 1, 6, 6, 6, 0.2], k=r.randint(1, 3))
        kind = ("phone" if i % 2 else "card") if seed else None
        for p in set(own):
            mentions.add((f"x{i}", kind, () if seed else r.choice([("phone",), ("card", "phone"), ("card",)]) if p == sorted(own)[0] else ("phone", "card"), p))
    edges = sorted(mentions, key=repr)
    possible = {}
    for i, k, o, p in edges:
        possible.setdefault(i, set()).update(o)
    rows = [(i, k, sorted(possible[i]), [p]) for i, k, _, p in edges]
    got = {(x.instance, x.kind): x.score for x in P.score_graph(spark.createDataFrame(rows, "instance string, kind string, possible array<string>, patterns array<string>")).collect()}
    of = collections.defaultdict(set)
    for i, _, _, p in edges:
        of[p].add(i)
    of = {p: x for p, x in of.items() if any(k is None for i, k, _, q in edges if q == p)}
    seeds = {(i, k): 1.0 for i, k, _, p in edges if k and p in of}
    open_ = {i for i, k, _, p in edges if k is None}
    accepted, known, left, before = {}, {k: (1.0, 1) for k in seeds}, P.ROUNDS, 0
    while True:
        confidence = {}
        for p, x in of.items():
            for k in ("phone", "card"):
                some = [known[i, k] for i in x if (i, k) in known]
                if sum(n for _, n in some) >= P.LEAST_SEEDS and sum(s for s, _ in some) / (len(x) + 0.5) >= P.CONFIDENT:
                    confidence[p, k] = sum(s for s, _ in some) / (len(x) + 0.5)
        new = {}
        for i in open_:
            for k in ("phone", "card"):
                c = [min(v, 0.999) for (p, q), v in confidence.items() if q == k and i in of[p]]
                if c:
                    new[i, k] = 1 - math.prod(1 - v for v in c)
        for (i, k), v in new.items():
            if v >= P.ACCEPT and k in possible[i]:
                accepted[i, k] = max(v, accepted.get((i, k), 0))
        known = {k: (1.0, 1) for k in seeds} | {k: (v, 1) for k, v in accepted.items()} | {k: (v, 0) for k, v in new.items() if k not in accepted}
        left, before, n = left - 1, len(accepted), before
        if left <= 0 and before == n:
            break
    assert accepted and got.keys() == accepted.keys() and all(abs(got[k] - v) < 1e-9 for k, v in accepted.items())
