"""The search language of the literature service, evaluated here as conditions on columns.

    query  = either { OR either }
    either = both { [AND | NOT] both }        two parts side by side mean AND, "a NOT b" means a without b
    both   = NOT both | ( query ) | part
    part   = [FIELD:] (word | "phrase" | [low TO high])

A bare word or phrase is looked for in the text columns, a field's value must equal the field, or one
element of it where it is a list, all in upper or lower case. A range of dates takes in all days of its ends, which may
be years or months. Null matches nothing, so NOT keeps it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(r'\s*(?:(?P<mark>[()])|(?:(?P<field>\w+):)?(?:"(?P<phrase>[^"]*)"|\[(?P<low>[^\]]*?)\s+TO\s+(?P<high>[^\]]*?)\]|(?P<word>[^\s()":\[\]]+)))')


def _parts(query: str) -> list[dict]:
    out, at = [], 0
    while query[at:].strip():
        m = _PART.match(query, at)
        if not m:
            raise ValueError(f"can't read the search from {query[at:].strip()[:40]!r}")
        out.append(m.groupdict())
        at = m.end()
    return out


class _Reader:
    def __init__(self, query: str, fields: Mapping[str, Column], lists: Sequence[str], text: Sequence[Column], dates: Sequence[str] = ()):
        self.parts, self.at = _parts(query), 0
        self.dates = {k.upper() for k in dates}
        self.fields, self.lists, self.text = {k.upper(): v for k, v in fields.items()}, {k.upper() for k in lists}, text

    def _word(self) -> str | None:
        """The next part if it is a bare word or a bracket."""
        p = self.parts[self.at] if self.at < len(self.parts) else {}
        return p.get("mark") or (p.get("word") if not p.get("field") else None)

    def query(self) -> Column:
        out = self.either()
        while self._word() == "OR":
            self.at += 1
            out = out | self.either()
        return out

    def either(self) -> Column:
        out = self.both()
        while self.at < len(self.parts) and self._word() not in ("OR", ")"):
            if self._word() == "AND":
                self.at += 1
            out = out & self.both()
        return out

    def both(self) -> Column:
        if self.at >= len(self.parts):
            raise ValueError("the search ends where a part is due")
        word, p = self._word(), self.parts[self.at]
        self.at += 1
        if word == "NOT":
            return ~self.both()
        if word == "(":
            out = self.query()
            if self._word() != ")":
                raise ValueError("a bracket isn't closed")
            self.at += 1
            return out
        if word in (")", "AND", "OR"):
            raise ValueError(f"{word!r} stands where a part is due")
        return F.coalesce(self.part(p), F.lit(False))

    def part(self, p: dict) -> Column:
        value = p["phrase"] if p["phrase"] is not None else p["word"]
        if not p["field"]:
            if value is None:
                raise ValueError("a range needs a field")
            return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(value.lower())), F.lit(False)) for c in self.text])
        name = p["field"].upper()
        if name not in self.fields:
            raise ValueError(f"field {name!r} is none of {', '.join(self.fields)}")
        c = self.fields[name]
        if value is None:
            low, high = p["low"].strip(), p["high"].strip()
            if name in self.dates:
                return (F.substring(c, 1, len(low)) >= low) & (F.substring(c, 1, len(high)) <= high)
            if re.fullmatch(r"-?[0-9.]+", low) and re.fullmatch(r"-?[0-9.]+", high):
                return c.cast("string").try_cast("double").between(float(low), float(high))
            return c.cast("string").between(low, high)
        if name in self.lists:
            return F.exists(c, lambda x: F.lower(x) == value.lower())
        return F.lower(c.cast("string")) == value.lower()


def condition(query: str, fields: Mapping[str, Column], text: Sequence[Column], lists: Sequence[str] = (), dates: Sequence[str] = ()) -> Column:
    """The query as a boolean column, never null; fields by name, of which lists are arrays and dates texts like 2024-01-31."""
    reader = _Reader(query, fields, lists, text, dates)
    out = reader.query()
    if reader.at < len(reader.parts):
        raise ValueError("a bracket closes that wasn't opened")
    return out


def required(query: str, fields: Iterable[str]) -> list[str]:
    """The parts of a query that everything it finds must satisfy and that ask for these fields alone, as queries."""
    known, out, at, depth, parts = {f.upper() for f in fields}, [], 0, 0, _parts(query)
    while len(parts) > 1 and parts[0]["mark"] == "(" and _closing(parts, 0) == len(parts) - 1:
        parts = parts[1:-1]
    words = [p["word"] if not p["field"] else None for p in parts]
    for i, p in enumerate(parts):
        depth += {"(": 1, ")": -1}.get(p["mark"], 0)
        if depth == 0 and words[i] in ("OR", "NOT"):  # an alternative holds nothing for all, and NOT isn't looked into
            return []
    while at < len(parts):
        end = _closing(parts, at) if parts[at]["mark"] == "(" else at
        piece = parts[at : end + 1]
        if words[at] == "AND":
            pass
        elif len(piece) > 1 and not any(words[i] in ("OR", "NOT") for i in range(at, end + 1)):
            out += required(_text(piece), fields)
        elif all(q["mark"] or (q["field"] or "").upper() in known or (not q["field"] and q["word"] in ("AND", "OR", "NOT")) for q in piece):
            out.append(_text(piece))
        elif len(piece) > 1:
            out += required(_text(piece), fields)
        at = end + 1
    return out


def _closing(parts: list[dict], at: int) -> int:
    depth = 0
    for i in range(at, len(parts)):
        depth += {"(": 1, ")": -1}.get(parts[i]["mark"], 0)
        if depth == 0:
            return i
    raise ValueError("a bracket isn't closed")


def _text(parts: list[dict]) -> str:
    def one(p: dict) -> str:
        if p["mark"]:
            return p["mark"]
        value = f'"{p["phrase"]}"' if p["phrase"] is not None else p["word"] if p["word"] is not None else f"[{p['low'].strip()} TO {p['high'].strip()}]"
        return f"{p['field']}:{value}" if p["field"] else value

    return " ".join(map(one, parts)).replace("( ", "(").replace(" )", ")")
