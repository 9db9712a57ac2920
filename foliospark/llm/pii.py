"""Operator 3: personal data by base patterns and bootstrapped contextual extraction.

Base patterns find e-mail, IP, card and phone spans in one pass over the whole texts; strings that look drawn at
random (random_strings) are secrets, a fifth kind that the base doesn't have. These are the seeds. The words
around a seed, and the name that it is assigned to, make lexical patterns; other tokens that could be an identifier
(candidates), for secrets any value that is assigned, in the same contexts are the other side of a graph of
patterns and instances. Spark scores it in rounds, ROUNDS at least and until none accepts anything new: a pattern's confidence for a kind is the share of its instances (distinct surfaces) that
are of the kind, an instance's score is the noisy-or of its patterns' confidences. Candidates whose
score reaches ACCEPT and whose shape suits the kind are new spans, and seeds in the next round. They never overlap
a base span or a seed.

The texts are read once; what is shuffled are identifiers and their contexts, keyed by pattern or
instance and aggregated before the shuffle, and nothing goes to the driver.

Defined cases: null text is empty and has no spans; repeated rows, equal doc_ids and null doc_ids give
a row each; spans count code points; n_email to n_phone are of base spans; without seeds nothing is added; an
empty table gives no rows; other columns are ignored or, by redact(), kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import caches
from foliospark.session import materialize, ship_package

KINDS = ("email", "ip", "card", "phone")  # of the base
SECRET = "secret"
ROUNDS = 3
LEAST_SEEDS = 3  # distinct seeds of a kind that a pattern needs
CONFIDENT = 0.7  # of a pattern
ACCEPT = 0.8  # of an instance
CONTEXT = 64  # characters to each side in which context words are looked for

_SPARSE = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RANDOM = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{24,}={0,2}(?![A-Za-z0-9_/+=-])")
_TURN = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
_ASSIGNED = re.compile(r"\b\w+\s*[=:]\s*(?:\"([^\"\n]{4,})\"|'([^'\n]{4,})'|([^\s\"']{4,}))")
_TO = re.compile(r"[=:]\s*[\"']?\Z")
_TOKEN = re.compile(r"(?<!\S)\S*?[0-9@]\S*")
_EDGE = "\"'.,;:!?()[]{}<>|*#$%&="
_WORD_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the whole pattern finds them, from each @ back over its local part: linear in the text."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    if not text or not _SPARSE.search(text):
        return []
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub(r"[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def random_strings(text: str, taken: list[Span]) -> list[Span]:
    """Strings of 24 characters or more, outside spans, in which letters and digits take turns at least six times."""
    out = []
    for m in _RANDOM.finditer(text):
        if len(_TURN.findall(m[0])) >= 6 and not any(a < m.end() and m.start() < b for a, b, _ in taken):
            out.append((m.start(), m.end(), SECRET))
    return out


def possible_kinds(surface: str) -> list[str]:
    """The kinds that a candidate's shape allows."""
    digits = len(_DIGIT.findall(surface))
    out = []
    if re.fullmatch(r"[^@\s]+@[^@\s]+", surface):
        out.append("email")
    if re.fullmatch(r"[0-9A-Fa-f]*(?::[0-9A-Fa-f]*){2,7}", surface) and digits or re.fullmatch(r"[0-9]{1,3}(?:[.,][0-9]{1,3}){3}", surface):
        out.append("ip")
    if re.fullmatch(r"[0-9](?:[.\x20-]?[0-9]){11,18}", surface):
        out.append("card")
    if re.fullmatch(r"\(?[0-9][0-9()./-]*[0-9]", surface) and 7 <= digits <= 15:
        out.append("phone")
    return out


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, int, list[str]]]:
    """Tokens outside base spans that could be identifiers."""
    k = 0
    taken = sorted(taken)
    for m in _TOKEN.finditer(text):
        raw = m[0]
        start = m.start() + len(raw) - len(raw.lstrip(_EDGE.replace("(", "")))
        end = m.end() - (len(raw) - len(raw.rstrip(_EDGE)))
        if start >= end:
            continue
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if any(a < end and start < b for a, b, _ in taken[k : k + 4]):
            continue
        kinds = possible_kinds(text[start:end])
        if kinds:
            yield start, end, kinds
    k = 0
    for m in _ASSIGNED.finditer(text):
        start, end = m.span(m.lastindex)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if not any(a < end and start < b for a, b, _ in taken[k : k + 4]):
            yield start, end, [SECRET]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span."""
    clean = lambda w: _DIGIT.sub("9", _WORD_EDGE.sub("", w.lower()))
    before = text[max(0, start - CONTEXT) : start]
    left = [w for w in map(clean, before.split()[-4:]) if w][-2:]
    right = [w for w in map(clean, text[end : end + CONTEXT].split()[:1]) if w]
    out = []
    if left and _TO.search(before):
        out.append(f"{left[-1]} = _")
    elif left:
        out.append(f"{left[-1]} _")
        if len(left) == 2:
            out.append(f"{left[0]} {left[1]} _")
        if right:
            out.append(f"{left[-1]} _ {right[0]}")
    if right:
        out.append(f"_ {right[0]}")
    return out


_MENTIONS = "array<struct<instance:string,kind:string,possible:array<string>,start:long,end:long,patterns:array<string>>>"
FOUND = f"doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:long,end:long,kind:string>>, secrets array<struct<start:long,end:long,kind:string>>, mentions {_MENTIONS}"


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_base(docs: DataFrame) -> DataFrame:
    """FOUND for every row of docs, in one pass."""
    ship_package(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    mention = pa.list_(pa.struct([("instance", pa.string()), ("kind", pa.string()), ("possible", pa.list_(pa.string())), ("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only()
        for b in batches:
            spans, secrets, mentions = [], [], []
            for text in b.column("text").to_pylist():
                found = base_spans(text)
                spans.append(found)
                some = text and _SPARSE.search(text)
                secrets.append(random_strings(text, found) if some else [])
                found = sorted(found + secrets[-1])
                some = [dict(instance=text[a:e].lower(), kind=k, possible=[], start=a, end=e, patterns=contexts(text, a, e)) for a, e, k in found]
                if text and (_SPARSE.search(text) or "=" in text or ":" in text):
                    some += [dict(instance=text[a:e].lower(), kind=None, possible=p, start=a, end=e, patterns=contexts(text, a, e)) for a, e, p in candidates(text, found)]
                mentions.append(some)
            counts = [pa.array([sum(s[2] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in spans])
            listed = [pa.array([[dict(start=a, end=e, kind=k) for a, e, k in x] for x in y], span) for y in (spans, secrets)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *counts, sha, *listed, pa.array(mentions, mention)], names=["doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "secrets", "mentions"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, FOUND)


def score_graph(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """mentions: (instance, kind or null, possible, patterns) to accepted instances (instance, kind, score)."""
    edges = materialize(mentions.select("instance", "kind", "possible", F.explode("patterns").alias("pattern")).distinct())
    sizes = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"), F.count_if(F.col("kind").isNull()).alias("open"))
    # only patterns with a candidate matter; which have enough seeds changes with each round
    live = materialize(edges.join(sizes.where("open > 0"), "pattern").select("pattern", "instance", "kind", "possible", "n"))
    seeds = live.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score"), F.lit(1).alias("seed")).distinct()
    accepted = seeds.limit(0).select("instance", "kind", "score")
    known, n_accepted = seeds, 0
    while True:
        patterns = (
            live.select("pattern", "instance", "n").distinct().join(known, "instance")
            .groupBy("pattern", "kind").agg((F.sum("score") / (F.first("n") + 0.5)).alias("confidence"), F.sum("seed").alias("seeds"))
            .where((F.col("seeds") >= LEAST_SEEDS) & (F.col("confidence") >= CONFIDENT))
        )
        new = materialize(
            live.where("kind is null").select("pattern", "instance", "possible").join(patterns, "pattern")
            .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"), F.first("possible").alias("possible"))
            .withColumn("passes", (F.col("score") >= ACCEPT) & F.array_contains("possible", F.col("kind")))
        )
        # what was accepted stays, so the rounds end
        accepted = materialize(accepted.unionByName(new.where("passes").select("instance", "kind", "score")).groupBy("instance", "kind").agg(F.max("score").alias("score")))
        rest = new.select("instance", "kind", "score").join(accepted.select("instance", "kind"), ["instance", "kind"], "left_anti")
        known = seeds.unionByName(accepted.withColumn("seed", F.lit(1))).unionByName(rest.withColumn("seed", F.lit(0)))
        rounds, before, n_accepted = rounds - 1, n_accepted, accepted.count()
        if rounds <= 0 and n_accepted == before:
            return accepted


def discover(found: DataFrame) -> DataFrame:
    """found: FOUND and row, a table. Spans that the method adds: row, added array<(start, end, kind)>."""
    accepted = score_graph(found.select(F.explode("mentions").alias("m")).select("m.instance", "m.kind", "m.possible", "m.patterns"))
    open_ = found.select("row", F.explode("mentions").alias("m")).where("m.kind is null").select("row", "m.instance", "m.possible", "m.start", "m.end")
    return (
        open_.join(accepted, "instance").where(F.array_contains("possible", F.col("kind")))
        .groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("added"))
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text), n_spans, n_secrets (random strings, which
    are seeds), n_added (spans that the graph adds), found (spans as rows)."""
    found = materialize(find_base(docs).withColumn("row", F.monotonically_increasing_id()))
    order = F.array(*[F.lit(k) for k in (*KINDS, SECRET)])
    spans = F.concat("base", "secrets", F.coalesce("added", F.array().cast("array<struct<start:long,end:long,kind:string>>")))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return (
        found.drop("mentions").join(discover(found), "row", "left")
        .withColumn("found", ranked)
        .select(
            "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
            F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
            F.size("found").cast("long").alias("n_spans"), F.size("secrets").cast("long").alias("n_secrets"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"), "found",
        )
    )


def masked(text: str, spans: list[Span]) -> str:
    """text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, k in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with base and added spans of `text` masked; all rows and columns stay. Base spans are found
    again where the text is; only rows of texts with added spans meet something by join."""
    ship_package(docs.sparkSession)
    names = docs.columns
    found = materialize(find_base(docs).select("doc_id", "text_hash", "mentions").withColumn("row", F.monotonically_increasing_id()))
    added = materialize(found.select("row", "doc_id", "text_hash").join(discover(found), "row").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.first("added").alias("added")))

    def mask(texts: pa.Array, added: pa.Array) -> pa.Array:
        out = []
        for text, more in zip(texts.to_pylist(), added.to_pylist()):
            spans = base_spans(text)
            spans += random_strings(text, spans) if text else []
            spans += [(s["start"], s["end"], s["kind"]) for s in more or ()]
            out.append(masked(text, spans) if spans else text)
        return pa.array(out, pa.string())

    mask_udf = F.arrow_udf(mask, "string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select(*[(mask_udf(F.col("r.text").cast("string"), F.col("added")) if c == "text" else F.col("r")[c]).alias(c) for c in names])


def op3_bootstrapped_pii(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
