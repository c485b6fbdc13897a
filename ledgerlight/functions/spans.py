"""Spans in German report text: numbers, dates, years and direction words, for one text at a time.

A text is read once into typed tokens (``tokens``). What a number means follows from the
tokens beside it: a reference, a date or a mark of enumeration makes it no amount, a unit
next to it scales it, a dash may be its sign, a word for the year before dates it.
"""

from __future__ import annotations

import calendar
from functools import lru_cache
from typing import NamedTuple

import regex

# Fixed values from here: word lists and units.
MONTHS = {
    "januar": 1, "jänner": 1, "jan": 1, "februar": 2, "feb": 2, "märz": 3, "mär": 3, "april": 4, "apr": 4, "mai": 5, "juni": 6, "jun": 6, "juli": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "oktober": 10, "okt": 10, "november": 11, "nov": 11, "dezember": 12, "dez": 12,
}
LONG_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
#: Words after which a number names a place in a rule, a document or a register, not an amount.
REFERENCE_WORDS = (
    "§§", "§", "Abs", "Absatz", "Absätze", "Absatzes", "Nr", "Art", "Artikel", "Satz", "S", "Ziffer", "Ziff", "Z", "Tz", "Rz", "lit", "AFRAC", "KFS", "Teil", "Titel", "Kapitel", "Punkt", "Abschnitt",
    "Abschnitte", "Anlage", "Beilage", "Seite", "Seiten", "Posten", "Aktivposten", "Passivposten", "HRB", "HRA", "UR-Nr", "PS", "ISA", "IFRS", "IAS", "IDW", "CRR", "Verordnung", "Richtlinie", "EU",
    "Mandant", "Buchungskreis", "Stufe", "Tel", "Telefon", "Fax", "Mobil", "Phone",
)
#: Words that may stand between the numbers of one reference.
REFERENCE_LINKS = ("und", "bis", "sowie", "oder", "ff", "f", "iVm", "i", "V", "m")
STREETS = ("straße", "strasse", "str", "gasse", "weg", "platz", "allee")
#: Words after which a dash before a number is its sign.
SIGN_WORDS = ("von", "auf", "um", "mit", "bei", "beträgt", "betrug", "betragen", "betrugen", "Höhe", "ca", "rund", "knapp", "Vorjahr", "Vj")
#: Unit as written -> (unit, scale).
UNITS = {
    "TEUR": ("EUR", 1_000), "T€": ("EUR", 1_000), "T €": ("EUR", 1_000), "Tsd. €": ("EUR", 1_000), "Tsd. EUR": ("EUR", 1_000), "Mio. EUR": ("EUR", 1_000_000), "Mio. €": ("EUR", 1_000_000), "Mio.": ("EUR", 1_000_000),
    "Mio": ("EUR", 1_000_000), "Millionen": ("EUR", 1_000_000), "Mrd.": ("EUR", 1_000_000), "Mrd": ("EUR", 1_000_000), "Millionen EUR": ("EUR", 1_000_000), "Mrd. EUR": ("EUR", 1_000_000), "EUR": ("EUR", 1),
    "€": ("EUR", 1), "%": ("percent", 1), "Prozent": ("percent", 1), "%-Punkte": ("percent", 1), "Prozentpunkte": ("percent", 1),
}
PRIOR_WORDS = ("Vorjahreswert", "Vorjahres", "Vorjahr", "i.Vj.", "i. Vj.", "Vj.", "Vj", "VJ")
UP = (
    "gestiegen", "stiegen", "stieg", "steigt", "steigen", "erhöhten sich", "erhöhte sich", "erhöht sich", "erhöhten", "erhöhte", "erhöht", "Erhöhung", "Anstieg", "verbesserte sich",
    "verbessert", "zunahm", "nahm zu", "zugenommen", "Zunahme", "Zuwachs",
)
DOWN = (
    "gesunken", "sanken", "sank", "sinkt", "sinken", "verringerten sich", "verringerte sich", "verringert sich", "verringerte", "verringert", "Verringerung", "verminderte sich",
    "verminderten sich", "vermindert", "Verminderung", "reduzierte sich", "reduzierten sich", "reduziert", "Reduzierung", "fielen", "fiel", "gefallen", "rückläufig", "rückläufiger",
    "rückläufige", "zurückgegangen", "zurückging", "Rückgang", "verschlechterte sich", "verschlechtert", "abgenommen", "Abnahme",
)
FLAT = ("unverändert", "Vorjahresniveau", "auf Vorjahreshöhe")
CITING = ("Nr", "No", "Richtlinie", "Verordnung")
# Fixed values end here.

MICRO = 1_000_000
_DIRECTION = {w.lower(): d for d, words in (("up", UP), ("down", DOWN), ("flat", FLAT)) for w in words}


def _any(words, tail: str = r"(?!\p{L})") -> str:
    """One of the words, the longest that fits: a tree by letters, each letter is looked at once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in (r"\s+" if c == " " else regex.escape(c, special_only=True) for c in w):
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [c + written(below) for c, below in node.items() if c]
        if not branches:
            return ""
        one = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return one + "?" * ("" in node)

    return written(tree) + tail


_KINDS = (
    ("clock", r"(?<![\d.,])\d{1,2}(?:[.:]\d{2})?\s*Uhr\b"),
    ("date", rf"(?<![\p{{L}}\d.,/])\d{{1,2}}\s?\.\s?(?:\d{{1,2}}\s?\.(?:\s?(?:\d{{4}}|\d{{2}}))?|(?i:{'|'.join(sorted(MONTHS, key=len, reverse=True))})\b\.?(?:\s+\d{{4}})?)(?![\d.,]\d|\d)"),
    ("number", r"\d+(?:\s?['.,]\s?\d{3}(?!\d)|[.,]\.?\d+)*"),
    ("change", rf"(?<![\p{{L}}-])(?i:{_any(_DIRECTION)})"),
    ("prior", rf"(?<!\p{{L}}){_any(PRIOR_WORDS)}"),
    ("unit", rf"(?<!\p{{L}}){_any(UNITS)}"),
    ("reference", rf"(?<!\p{{L}}){_any(REFERENCE_WORDS)}\.?:?"),
    ("month", rf"(?<!\p{{L}})(?:{LONG_MONTHS})\b"),
    ("word", r"\p{L}[\p{L}\p{M}]*"),
    ("open", r"[(\[]"),
    ("close", r"[)\]]"),
    ("dash", "[-–−]"),
    ("slash", "/"),
    ("stop", r"[.;!?](?=\s|$)"),
    ("mark", r"[.,;:!?+]"),
    ("other", r"\S"),
)
#: Where a kind can begin at all: digits, letters or signs; spares the rest of its pattern elsewhere.
_BEGINS = {"clock": r"\d", "date": r"\d", "number": r"\d", "change": r"\p{L}", "prior": "[Vi]", "unit": "[TMEP€%]", "reference": "[\\p{Lu}§l]", "month": "[JFMASOND]"}
_lexer = regex.compile("|".join(f"(?P<{kind}>{f'(?={_BEGINS[kind]})' if kind in _BEGINS else ''}{p})" for kind, p in _KINDS))
#: What a text must hold to have a figure or date, a year, a word of change.
_digit, _yearlike, _change = regex.compile(r"\d"), regex.compile(r"(?:19|20)\d{2}"), regex.compile(dict(_KINDS)["change"])
_blank, _mark, _part, _year = regex.compile(r"[\s']"), regex.compile(r"([.,])"), regex.compile(r"\d+|\p{L}+"), regex.compile(r"(?:19|20)\d{2}$")
_letter = regex.compile(r"\p{L}")


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    text: str

    def is_word(self, words) -> bool:
        return self.kind in ("word", "reference", "prior") and self.text.rstrip(".:") in words


NOTHING = Token("nothing", -9, -9, "")


@lru_cache(maxsize=2)  # figures and words of one text are asked for one after the other
def tokens(text: str) -> list[Token]:
    """Typed tokens in order; longest words first, dates and times as a whole."""
    return [Token(m.lastgroup, m.start(), m.end(), m[0]) for m in _lexer.finditer(text)]


class Figure(NamedTuple):
    start: int
    end: int
    raw: str
    micro: int | None
    display_unit: int
    unit: str
    scale: int
    decimals: int
    period: str | None
    parenthesized: bool
    issue: str | None


def parse_number(raw: str) -> tuple[int, int] | None:
    """(digits, decimals) of a number in German or English notation, or null where it stays ambiguous.

    The last separator opens the decimals if it is the only comma, the only point after
    commas, or a point that cannot end a group; every group before it but the first has
    three digits.
    """
    parts = _mark.split(_blank.sub("", raw))
    groups, marks = parts[::2], parts[1::2]
    if not all(g.isascii() and g.isdigit() for g in groups):
        return None
    fraction = ""
    if marks:
        commas, points, last = marks.count(","), marks.count("."), marks[-1]
        if last == "," and commas > 1:
            return None
        decimal = last == "," or (points == 1 and commas > 0) or (not commas and (len(groups[-1]) == 2 if points > 1 else len(groups[-1]) != 3))
        if decimal:
            fraction = groups.pop()
        if any(len(g) != 3 for g in groups[1:]):
            return None
    return int("".join(groups) + fraction), len(fraction)


class _Line:
    """The tokens of one text, and what stands beside each."""

    def __init__(self, text: str, kind: str):
        self.text, self.kind, self.toks = text, kind, tokens(text)
        self._units: dict[int, tuple[str, int] | None] = {}
        self.referred = self._references()

    def at(self, k: int) -> Token:
        return self.toks[k] if 0 <= k < len(self.toks) else NOTHING

    def glued(self, k: int) -> bool:
        """Whether nothing stands between tokens k and k + 1."""
        return self.at(k).end == self.at(k + 1).start

    def _references(self) -> set[int]:
        """Numbers of references: a reference word opens a chain that numbers, links, brackets and single letters continue."""
        out, chain = set(), False
        for k, t in enumerate(self.toks):
            if t.kind == "reference":
                chain = True
            elif chain and t.kind == "number":
                if self.unit(k):
                    chain = False
                else:
                    out.add(k)
            else:
                chain = chain and (t.kind in ("open", "close", "slash", "dash") or t.text in (",", ".", "+") or t.is_word(REFERENCE_LINKS) or (t.kind == "word" and len(t.text) == 1))
        return out

    def sign(self, k: int) -> bool:
        """Whether the token before number k is a dash that negates it: not between numbers, and close to it or after a word that leads to an amount."""
        dash, before = self.at(k - 1), self.at(k - 2)
        if dash.kind != "dash" or self.at(k).start - dash.end > 1 or before.kind in ("number", "date"):
            return False
        leads = before.is_word(SIGN_WORDS) or before.kind in ("open", "unit", "prior", "nothing") or before.text == ":"
        return leads or (self.glued(k - 1) and before.end < dash.start)

    def unit(self, k: int) -> tuple[str, int] | None:
        """The unit after number k, else the one before it or before its sign."""
        if k not in self._units:
            self._units[k] = self._unit(k)
        return self._units[k]

    def _unit(self, k: int) -> tuple[str, int] | None:
        after, before = self.at(k + 1), self.at(k - 1)
        if after.kind == "unit" and after.start - self.at(k).end <= 2:
            return self._scale(after)
        if before.kind == "dash":
            before = self.at(k - 2)
        return self._scale(before) if before.kind == "unit" and UNITS[" ".join(before.text.split())][0] == "EUR" else None

    @staticmethod
    def _scale(t: Token) -> tuple[str, int]:
        return UNITS[" ".join(t.text.split())]

    def counts_nothing(self, k: int) -> bool:
        """Whether number k is no amount, by what it is and by its neighbours."""
        t, before, after, first = self.at(k), self.at(k - 1), self.at(k + 1), k == 0
        if self.unit(k):
            return False
        prose = self.kind != "table_cell"
        short, bare = len(t.text) <= 2, t.text.isdigit()
        in_brackets = before.kind == "open" and after.kind == "close"
        return (
            k in self.referred
            or "slash" in (before.kind, after.kind)
            or before.kind == "month"
            or after.kind == "month"
            or (after.text == "." and self.at(k + 2).kind == "month")
            or (bare and len(t.text) == 4 and t.text[:2] in ("19", "20"))  # a year
            or (before.kind == "word" and before.text.lower().endswith(STREETS) and bare and len(t.text) <= 4)
            or (bare and 4 <= len(t.text) <= 5 and after.kind == "word" and after.text[:1].isupper() and after.start > t.end)  # a postcode and its town
            or (after.kind == "dash" and self.glued(k) and self.at(k + 2).kind == "word" and self.glued(k + 1))  # a part of a compound word
            or (in_brackets and short and (prose and k == 1 or self._enumerates(k)))
            or (first and bare and len(t.text) <= 3 and (after.kind in ("word", "change") or after.text == "." and self.at(k + 2).kind in ("word", "change")))  # numbered text
            or (self.kind == "heading" and (first or k == 1))
            or (prose and self._page(k))
            or (before.kind == "dash" and after.kind == "dash" and k + 2 == len(self.toks))  # a page number between dashes
        )

    def _enumerates(self, k: int) -> bool:
        """Whether bracketed number k is one of several, as in ``(1) bis (3)``."""
        joins = lambda t: t.kind == "dash" or t.text == "," or t.is_word(("und", "bis", "oder"))
        return (joins(self.at(k + 2)) and self.at(k + 3).kind == "open") or (joins(self.at(k - 2)) and self.at(k - 3).kind == "close")

    def _page(self, k: int) -> bool:
        """Whether number k ends a line of a table of contents: a title without a sentence's end, then a page or a range of pages."""
        last = len(self.toks) - 1
        ranged = self.at(last - 1).kind == "dash" and self.glued(last - 1) and self.glued(last - 2) and self.at(last - 2).kind == "number"
        head = last - 2 if ranged else last
        if k not in (head, last) or self.at(last).kind != "number" or head == 0 or len(self.text) > 120:
            return False
        pages = all(self.at(j).text.isdigit() and len(self.at(j).text) <= 3 for j in (head, last))
        return pages and self.at(head - 1).kind in ("word", "close") and not any(t.kind == "stop" for t in self.toks)

    def period(self, k: int, report_year: int | None) -> str | None:
        """The period that a word or a year before number k names, with at most units, marks and one noun between them."""
        noun = False
        for j in range(k - 1, max(-1, k - 7), -1):
            t = self.at(j)
            if t.kind == "prior":
                return "prior"
            if t.text == ":" and self.at(j - 1).kind == "number" and self.at(j - 2).kind == "open" and report_year:
                year = self.at(j - 1).text
                return {str(report_year): "current", str(report_year - 1): "prior"}.get(year, "other") if len(year) == 4 else None
            if t.kind == "word" and not noun and not t.is_word(("um", "auf", "von", "nach", "gegenüber", "mit", "bei")):
                noun = True
            elif t.kind not in ("unit", "dash") and t.text != ":":
                return None
        return None

    def bracketed(self, k: int) -> bool:
        """Whether a bracket holds number k and nothing but what dates or measures it."""
        j, n = k - 1, k + 1
        while self.at(j).kind in ("unit", "dash", "prior", "number", "word") or self.at(j).text == ":":
            j -= 1
        return self.at(j).kind == "open" and k - j <= 5 and self.at(n + (self.at(n).kind == "unit")).kind == "close"


def figures(text: str, kind: str = "paragraph", report_year: int | None = None, column_unit: tuple[str, int] | None = None, column_period: str | None = None) -> list[Figure]:
    """All amounts and counts of a text, in order; a running head ``PDF-Seite n`` has none."""
    if not _digit.search(text):
        return []
    line, cell, out, where = _Line(text, kind), kind == "table_cell", [], []
    if [t.text for t in line.toks[:3]] == ["PDF", "-", "Seite"] and len(line.toks) == 4:
        return []
    for k, t in enumerate(line.toks):
        if t.kind != "number" or line.counts_nothing(k) or t.start and text[t.start - 1].isalpha():
            continue
        minus, parsed = line.sign(k), parse_number(t.text)
        unit, scale = line.unit(k) or (column_unit if cell and column_unit else ("unknown" if cell else "count", 1))
        start = line.at(k - 1).start if minus else t.start
        one = 0 if parsed is None else MICRO * scale // 10 ** parsed[1]
        micro = None if parsed is None else parsed[0] * MICRO * scale // 10 ** parsed[1] * (-1 if minus else 1)
        period = column_period if cell else line.period(k - minus, report_year)
        out.append(Figure(start, t.end, text[start : t.end], micro, one, unit, scale, 0 if parsed is None else parsed[1], period, line.bracketed(k), None if parsed else "unreadable_format"))
        where.append(k)
    return [_measured(line, out, where, n) for n in range(len(out))]


def _measured(line: _Line, found: list[Figure], where: list[int], n: int) -> Figure:
    """A bare count takes the unit of an amount within a few tokens of its sentence: of the next one, else of the last one."""
    f = found[n]
    for other in (n + 1, n - 1) if f.unit == "count" else ():
        if 0 <= other < len(found) and found[other].unit == "EUR":
            a, b = sorted((where[n], where[other]))
            if b - a <= 7 and not any(t.kind == "stop" for t in line.toks[a:b]):
                scale = found[other].scale
                return f._replace(unit="EUR", scale=scale, micro=None if f.micro is None else f.micro * scale, display_unit=f.display_unit * scale)
    return f


def dates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, raw, ISO date) of valid dates from 1900 to 2100; two digits mean 20xx."""
    out = []
    for t in tokens(text) if _digit.search(text) else ():
        parts = _part.findall(t.text) if t.kind == "date" else ()
        if len(parts) != 3:
            continue
        day, month, year = int(parts[0]), MONTHS.get(parts[1].lower()) or (int(parts[1]) if parts[1].isdigit() else 0), int(parts[2]) + (2000 if len(parts[2]) == 2 else 0)
        if 1900 <= year <= 2100 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]:
            out.append((t.start, t.end, t.text, f"{year:04}-{month:02}-{day:02}"))
    return out


def years(text: str, kind: str = "paragraph") -> list[tuple[int, int, str, int]]:
    """(start, end, raw, year) in prose: also the year of a date with its month's name; years of cited rules are none."""
    if kind == "table_cell" or not _yearlike.search(text):
        return []
    toks, out = tokens(text), []
    for k, t in enumerate(toks):
        m = _year.search(t.text) if t.kind == "date" and _letter.search(t.text) else _yearlike.fullmatch(t.text) if t.kind == "number" else None
        if m is None:
            continue
        start, before, after = t.start + m.start(), toks[k - 1] if k else NOTHING, toks[k + 1] if k + 1 < len(toks) else NOTHING
        joined = start == t.start and start > 0 and text[start - 1] in "/-,." or text[t.end : t.end + 1] == "/"
        cited = t.kind == "number" and (before.is_word(CITING) or (before.kind == "close" and k > 1 and toks[k - 2].text in ("EU", "EG", "EWG")) or "slash" in (before.kind, after.kind))
        if not joined and not cited:
            out.append((start, t.end, m[0], int(m[0])))
    return out


def statements(text: str, kind: str = "paragraph") -> list[tuple[int, int, str, str]]:
    """(start, end, raw, direction) of words that state a change; of a line item's paired forms, ``Erhöhung (i.Vj. Verminderung)``, none counts."""
    toks = [] if kind in ("table_cell", "heading") or not _change.search(text) else tokens(text)
    out = []
    for k, t in enumerate(toks):
        if t.kind == "change":
            ahead, behind = [x.kind for x in toks[k + 1 : k + 3]], [x.kind for x in toks[max(0, k - 2) : k]]
            if ["open", "prior"] not in (ahead, behind):
                out.append((t.start, t.end, t.text, _DIRECTION[" ".join(t.text.lower().split())]))
    return out
