"""Text semantics as column expressions: white space, tokens, phrases, quotes, excerpts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space in the wide sense (no-break and ideographic spaces, byte-order mark). Fixed values.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: Words that carry no content. Fixed values.
STOP_WORDS = (
    "aber", "alle", "also", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "durch", "ein", "eine", "einer", "eines", "für", "hat",
    "ist", "mit", "nach", "oder", "sich", "sie", "sind", "und", "von", "werden", "wird", "zur", "the", "and", "for", "from", "into", "that", "this", "with",
)
TOKEN = "[\\p{L}\\p{N}][\\p{L}\\p{N}-]+"


@F.pandas_udf(StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition (NFKC), which Spark has no function for."""
    for s in parts:
        yield s.str.normalize("NFKC")


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def lexical_tokens(c: Column) -> Column:
    """Content words of a text in order: lower case, one hyphen off each end, three letters at least, no stop words. Null: none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    plain = F.transform(found, lambda t: F.regexp_replace(t, "^-|-$", ""))
    return F.filter(plain, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def phrase(c: Column) -> Column:
    """Lower-case text with collapsed white space, for containment tests."""
    return collapse(F.lower(c))


def _first_letter(c: Column, upper: bool) -> Column:
    first = F.substring(c, 1, 1)
    return F.concat(F.upper(first) if upper else F.lower(first), F.substring(c, 2, 1 << 30))


def bare_quote(c: Column) -> Column:
    """A quote without the punctuation at its end."""
    return F.rtrim(F.regexp_replace(c, "[.:;,!?]+$", ""))


def quote_variants(quote: Column) -> list[Column]:
    """A collapsed quote's wordings in the order they are looked for; some may be empty."""
    return [v for base in (quote, bare_quote(quote)) for v in (base, _first_letter(base, True), _first_letter(base, False))]


def locate_quote(block: Column, quote: Column) -> Column:
    """The document's own wording of a quote, or null.

    The quote may differ in its first letter's case and in punctuation at its end only.
    """
    text, q = collapse(block), collapse(quote)
    return F.coalesce(*(F.when((F.length(v) > 0) & F.contains(text, v), v) for v in quote_variants(q)))


def excerpt(c: Column, most: int = 600) -> Column:
    """The text if it is short, else its beginning up to the last sentence or clause end in it, else to the last space."""
    text = collapse(c)
    head = F.substring(text, 1, most)
    last = lambda sep: F.length(head) - F.instr(F.reverse(head), sep[::-1]) - len(sep) + 2  # noqa: E731  place of its first character, from 1
    cut = F.greatest(*(F.when(F.instr(head, sep) > 0, last(sep)).otherwise(0) for sep in (". ", "; ", ": ")))
    space = F.when(F.instr(head, " ") > 0, last(" ")).otherwise(most + 1)
    return F.when(F.length(text) <= most, text).when((cut - 1) * 3 >= most, head.substr(F.lit(1), cut)).otherwise(F.rtrim(head.substr(F.lit(1), space - 1)))


def tokens_estimate(c: Column) -> Column:
    """Language-model tokens of a text, estimated as a token for every 3.5 characters."""
    return F.ceil(F.length(c) / 3.5).cast("long")


def clip(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet neither cuts nor runs as a formula; what a cell cannot hold ends in a mark."""
    held = lambda x: F.when(F.length(x) > 32_767, F.concat(clip(x, 32_767 - 14), F.lit(" … [gekürzt]"))).otherwise(x)
    return once(held(c), lambda x: held(F.when(x.rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), x)).otherwise(x)))


def cited_numbers(c: Column) -> Column:
    """Numbers in square brackets, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("\\[(\\d+)\\]"), F.lit(1)), lambda x: x.try_cast("int"))


def digits(c: Column) -> Column:
    """The digits of a text alone."""
    return F.regexp_replace(c, "\\D", "")


def slug(c: Column) -> Column:
    """Lower-case letters and digits of a text for a file name, one dash between, accents dropped."""
    plain = F.regexp_replace(F.translate(c, "ÄÖÜäöüÀÁÂÈÉÊÌÍÎÒÓÔÙÚÛàáâèéêìíîòóôùúûÇçÑñ", "AOUaouAAAEEEIIIOOOUUUaaaeeeiiiooouuuCcNn"), "[^a-zA-Z0-9]+", "-")
    return F.lower(F.regexp_replace(plain, "^-|-$", ""))


def cutoff_date(c: Column, report_year: Column) -> Column:
    """ISO date of the first cut-off date that a text states, unless it is the end of the reported year or of the one before."""
    shape = "(?iu)(?:per|zum|am|Stand)\\s+(\\d{1,2})\\.\\s?(Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|\\d{1,2}\\.)\\s?(\\d{4})"
    part = lambda k: F.regexp_extract(c, shape, k)
    name = F.lower(F.regexp_replace(part(2), "\\.", ""))
    names = {n: m for m, ns in enumerate(("januar jänner", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"), 1) for n in ns.split()}
    month = F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[name], name.try_cast("int"))
    day, year = part(1).try_cast("int"), part(3).try_cast("int")
    own = (day == 31) & (month == 12) & year.isin(report_year, report_year - 1)
    return F.when(part(1) != "", F.when(~F.coalesce(own, F.lit(False)), F.format_string("%d-%02d-%02d", year, month, day)))
