"""Prose of German reports, one text at a time: sentences, clauses, items named, roles of amounts."""

from __future__ import annotations

from typing import NamedTuple

import regex

from . import spans as sp
from .lineitems import ITEMS

# Abbreviations that end in a point within a sentence, and the words that give an amount its role.
ABBREVIATIONS = frozenset("abs art bzw ca d.h etc gem ggf i.d.r i.h.v i.v.m inkl insb lit lt mio mrd nr rd s sog tsd tz u.a usw v.a vgl vj z.b z.t ziff".split())
ROLES = {"von": "from", "um": "by", "auf": "to"}
LEVEL_WORDS = r"(?:beträgt|betrug|betragen|betrugen|mit|in Höhe von|bei)"
# Fixed values end here.

_stop = regex.compile(r"[.!?]+(?=\s|$)")
# what leads to an amount ends where the amount begins: read from there backwards
_role = regex.compile(r"(?ir)\b(von|um|auf)\s+(?:(?:rund|ca\.|knapp|etwa|insgesamt)\s+)?(?:(?:TEUR|EUR|€|T€|Mio\.\s?EUR)\s*)?$")
_level = regex.compile(rf"(?ir)\b{LEVEL_WORDS}\s+(?:(?:rund|ca\.|knapp)\s+)?(?:(?:TEUR|EUR|€|T€)\s*)?$")
_items = tuple((key, regex.compile(rf"(?i)(?<!\p{{L}})(?:{text})(?!\p{{L}})")) for key, _, _, text in ITEMS)
_item_starts = regex.compile(rf"(?i)(?<!\p{{L}})(?=(?:{'|'.join(text for *_, text in ITEMS)})(?!\p{{L}}))")
_last_word, _inner_word, _brackets, _numbers = regex.compile(r"(?r)[\p{L}\d.]+$"), regex.compile(r"\p{L}|\d{1,2}"), regex.compile(r"[()]|;| sowie "), regex.compile(r"\d+(?:[.,]\d+)*")
_month = regex.compile(sp.LONG_MONTHS)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences. A point after an abbreviation, a single letter or a number before a lower-case word or month ends none."""
    out, at = [], 0
    for m in _stop.finditer(text):
        before = _last_word.search(text[at : m.start()])
        word, after = (before[0] if before else "").lower(), text[m.end() :].lstrip()
        inner = m[0] == "." and (word in ABBREVIATIONS or _inner_word.fullmatch(word) and (after[:1].islower() or _month.match(after) or word.isalpha()))
        if after and inner:
            continue
        out.append((at, m.end()))
        at = m.end() + len(text[m.end() :]) - len(after)
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def clauses(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Parts of a sentence between semicolons and ``sowie`` outside brackets."""
    out, at, depth = [], start, 0
    for m in _brackets.finditer(text[:end], start):
        if m[0] in "()":
            depth = max(0, depth + (1 if m[0] == "(" else -1))
        elif depth == 0:
            out.append((at, m.start()))
            at = m.end()
    out.append((at, end))
    return [(a, b) for a, b in out if text[a:b].strip()]


def mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, item) of line items named; of overlapping ones the longest, equal spans all."""
    found, reach = [], dict.fromkeys((key for key, _ in _items), 0)
    for at in [m.start() for m in _item_starts.finditer(text)]:
        for key, p in _items:
            if at >= reach[key] and (m := p.match(text, at)):
                found.append((at, m.end(), key))
                reach[key] = m.end()
    order = {key: n for n, (key, _) in enumerate(_items)}
    found.sort(key=lambda x: (x[0] - x[1], x[0], order[x[2]]))
    kept: list[tuple[int, int, str]] = []
    for s, e, key in found:
        if all(e <= a or b <= s or (a, b) == (s, e) for a, b, _ in kept):
            kept.append((s, e, key))
    return sorted(kept)


class Change(NamedTuple):
    """What a clause says of one item: up to three amounts with their roles, a percentage, a direction."""

    clause: int
    item: str | None
    candidates: int
    direction: str | None
    before: sp.Figure | None
    by: sp.Figure | None
    after: sp.Figure | None
    percent: sp.Figure | None


def changes(text: str, kind: str = "paragraph", report_year: int | None = None) -> list[Change]:
    """One Change for each clause with an amount in a role; prior-year amounts in brackets take no part."""
    figures, out = sp.figures(text, kind, report_year), []
    if not figures:  # no amount in a role, no percentage
        return out
    named, words = mentions(text), sp.statements(text, kind)
    for n, (lo, hi) in enumerate(c for s in sentences(text) for c in clauses(text, *s)):
        roles: dict[str, sp.Figure] = {}
        percent = None
        for f in figures:
            if not lo <= f.start < hi or f.micro is None or f.period == "prior":
                continue
            if f.unit == "percent":
                percent = percent or f
                continue
            lead = text[lo : f.start]
            m = _role.search(lead)
            role = ROLES[m[1].lower()] if m else "to" if _level.search(lead) else None
            if role:
                roles.setdefault(role, f)
        inside = [x for x in named if lo <= x[0] < hi]
        spans = {x[:2] for x in inside}
        direction = next((w[3] for w in words if lo <= w[0] < hi), None)
        if roles or percent and direction:
            first = min(spans, default=None)
            items = [x[2] for x in inside if x[:2] == first]
            out.append(Change(n, items[0] if items else None, len(items), direction, roles.get("from"), roles.get("by"), roles.get("to"), percent))
    return out


def template(text: str) -> str:
    """A paragraph with its numbers masked and its years kept."""
    plain = " ".join(text.split())
    kept = {(s, e) for s, e, _, _ in sp.years(plain)}
    return _numbers.sub(lambda m: m[0] if m.span() in kept else "#", plain)


def counted(blocks):
    """(doc_id, n_sentences, n_clauses) of blocks (doc_id, text)."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_clauses", pa.int64())])

    def run(batches):
        for b in batches:
            parts = [[clauses(t, *s) for s in sentences(t)] for t in (x or "" for x in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) for p in parts], pa.int64()), pa.array([sum(map(len, p)) for p in parts], pa.int64())], schema=schema)

    return blocks.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, "doc_id long, n_sentences long, n_clauses long")
