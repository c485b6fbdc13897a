"""The line-item catalogue: which item of a balance sheet or income statement a label or a text names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: Items in order of precedence: (key, kind, pattern of a whole row label, pattern in prose). Fixed values.
ITEMS = (
    ("bilanzsumme", "balance", "Summe der (?:Aktiva|Passiva)|Bilanzsumme|Summe Aktiva|Summe Passiva", "Bilanzsumme|Gesamtkapitals?"),
    ("anlagevermoegen", "balance", "Anlagevermögen(?: insgesamt)?", "Anlagevermögens?"),
    ("umlaufvermoegen", "balance", "Umlaufvermögen(?: insgesamt)?", "Umlaufvermögens?"),
    ("sachanlagen", "balance", "Sachanlagen", "Sachanlagen"),
    ("vorraete", "balance", "Vorräte", "Vorräte"),
    ("forderungen_ll", "balance", "Forderungen aus Lieferungen und Leistungen", "Forderungen aus Lieferungen und Leistungen|Forderungen aus L\\+L"),
    ("sonstige_vermoegensgegenstaende", "balance", "Sonstige Vermögensgegenstände", "sonstigen? Vermögensgegenstände"),
    ("liquide_mittel", "balance", "Liquide Mittel|Guthaben bei Kreditinstituten", "liquiden? Mittel(?:n)?"),
    ("forderungen_kunden", "balance", "Forderungen an Kunden", "Forderungen an Kunden"),
    ("forderungen_kreditinstitute", "balance", "Forderungen an Kreditinstitute:?", "Forderungen an Kreditinstitute"),
    ("eigenkapital", "balance", "Eigenkapital(?: insgesamt)?", "Eigenkapitals?|Eigenkapital"),
    ("pensionsrueckstellungen", "balance", "Pensionsrückstellungen|Rückstellungen für Pensionen(?: und ähnliche Verpflichtungen)?", "Pensionsrückstellungen"),
    ("rueckstellungen", "balance", "Rückstellungen", "(?-i:Rückstellungen(?! für))"),
    ("verbindlichkeiten", "balance", "Verbindlichkeiten", "(?-i:(?<!sonstigen |Sonstigen )Verbindlichkeiten(?! (?:aus|gegenüber)))"),
    ("verbindlichkeiten_ll", "balance", "Verbindlichkeiten aus Lieferungen und Leistungen", "Verbindlichkeiten aus Lieferungen und Leistungen"),
    ("fremdkapital", "balance", "Fremdkapital", "Fremdkapital(?:s)?(?!quote|struktur)"),
    ("eigenkapitalquote", "ratio", "Eigenkapitalquote", "Eigenkapitalquote"),
    ("fremdkapitalquote", "ratio", "Fremdkapitalquote", "Fremdkapitalquote"),
    ("umsatzerloese", "income", "Umsatzerlöse", "Umsatzerlöse"),
    ("materialaufwand", "expense", "Materialaufwand", "Materialaufwand|Materialaufwands"),
    ("personalaufwand", "expense", "Personalaufwand", "Personalaufwand|Personalaufwands|Personalaufwendungen"),
    ("abschreibungen", "expense", "Abschreibungen", "(?-i:Abschreibungen(?! auf))"),
    ("sonstige_betriebliche_aufwendungen", "expense", "Sonstige betriebliche Aufwendungen", "sonstigen? betrieblichen? Aufwendungen|sonstige betriebliche Aufwand"),
    ("sonstige_betriebliche_ertraege", "income", "Sonstige betriebliche Erträge", "sonstigen? betrieblichen? Erträge"),
    ("betriebsergebnis", "result", "Betriebsergebnis", "Betriebsergebnis|Betriebsergebnisses"),
    ("zinsergebnis", "result", "Zinsergebnis", "Zinsergebnis|Zinsergebnisses"),
    ("steuern_einkommen", "expense", "Steuern vom Einkommen und (?:vom )?Ertrag|Steuererstattungen \\(i\\. ?Vj\\. Steuern\\) vom Einkommen und vom Ertrag",
     "(?-i:Steuern vom Einkommen und vom Ertrag|Ertragsteuern|(?<!vor |aus |[Ss]onstige |[Ss]onstigen )Steuern)"),
    ("jahresergebnis", "result", "Jahresüberschuss|Jahresergebnis|Jahresfehlbetrag", "Jahresüberschuss|Jahresüberschusses|Jahresfehlbetrag|Jahresfehlbetrags|Jahresergebnis|Jahresergebnisses|Fehlbetrag"),
    ("zinsertraege", "income", "Zinsen und ähnliche Erträge", "Zinserträge|Zinsen und ähnliche Erträge"),
    ("zinsaufwendungen", "expense", "Zinsen und ähnliche Aufwendungen", "Zinsaufwendungen|Zinsen und ähnliche Aufwendungen"),
    ("nettozinsertrag", "result", "Nettozinsertrag", "Nettozinsertrag|Nettozinsertrags"),
    ("provisionsertraege", "income", "Provisionserträge", "Provisionserträge"),
    ("provisionsaufwendungen", "expense", "Provisionsaufwendungen", "Provisionsaufwendungen"),
    ("provisionsergebnis", "result", "Provisionsergebnis", "Provisionsergebnis|Provisionsergebnisses"),
    ("allgemeine_verwaltungsaufwendungen", "expense", "Allgemeine Verwaltungsaufwendungen", "allgemeinen? Verwaltungs(?:kosten|aufwendungen)|Verwaltungsaufwand"),
    ("sachaufwand", "expense", "sonstige Verwaltungsaufwendungen(?: \\(Sachaufwand\\))?", "sonstigen? Verwaltungsaufwendungen|Sachaufwand|Verwaltungsaufwand"),
    ("betriebsaufwendungen", "expense", "Betriebsaufwendungen", "Betriebsaufwendungen|Betriebsaufwands"),
    ("betriebsertraege", "income", "Betriebserträge", "Betriebserträge"),
    ("bilanzverlust", "result", "Bilanzverlust|Bilanzgewinn|Bilanzverlust \\(i\\. ?Vj\\. Bilanzgewinn\\)|Bilanzgewinn/-verlust", "Bilanzverlust|Bilanzgewinn"),
)
#: Items that an account never stands for as a whole.
TOTALS = ("bilanzsumme", "anlagevermoegen", "umlaufvermoegen", "eigenkapital", "fremdkapital", "rueckstellungen", "verbindlichkeiten")
NUMBERING = "^(?:[A-H]\\.|[IVX]{1,4}\\.|\\d{1,2}[a-z]?\\.|[a-z]{1,2}\\)|\\([a-z]\\)|-)\\s*"
LEVELS = (("^[A-H]\\.", 1), ("^[IVX]{1,4}\\.", 2), ("^\\d{1,2}[a-z]?\\.", 3), ("^[a-z]\\)", 4), ("^[a-z]{2}\\)", 5))
# Fixed values end here.


def bare_label(c: Column) -> Column:
    """A row label without its numbering and a colon at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, NUMBERING, ""), ":\\s*$", ""), "\\s+", " "))


def enumeration_level(c: Column) -> Column:
    """Depth of a label's numbering, letters before roman numbers; null without one."""
    return F.coalesce(*(F.when(c.rlike(p), F.lit(n)) for p, n in LEVELS))


def _row(plain: Column) -> Column:
    return F.coalesce(*(F.when(plain.rlike(f"(?iu)^(?:{row})$"), F.lit(key)) for key, _, row, _ in ITEMS))


def _named(plain: Column) -> Column:
    single = [(key, text) for key, kind, _, text in ITEMS if key not in TOTALS and kind not in ("ratio", "result")]
    return F.coalesce(*(F.when(plain.rlike(f"(?iu)(?<!\\p{{L}})(?:{text})(?!\\p{{L}})"), F.lit(key)) for key, text in single))


def item_of_label(c: Column) -> Column:
    """Key of the first item whose row pattern is the whole label."""
    return once(bare_label(c), _row)


def _mentioned(plain: Column) -> Column:
    return F.coalesce(*(F.when(plain.rlike(f"(?iu)(?<!\\p{{L}})(?:{text})(?!\\p{{L}})"), F.lit(key)) for key, _, _, text in ITEMS))


def item_of_caption(c: Column) -> Column:
    """Key of the item a table's caption is about: its label as a row, else the first item in the catalogue that it mentions."""
    return once(bare_label(c), lambda plain: F.coalesce(_row(plain), _mentioned(plain)))


def item_of_account(c: Column) -> Column:
    """Key of the item an account counts towards: its label as a row, but no total; else the first single item that it names."""
    return once(bare_label(c), lambda plain: F.when(_row(plain).isNotNull(), F.when(~_row(plain).isin(*TOTALS), _row(plain))).otherwise(_named(plain)))


def kind_of_item(key: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, kind, _, _ in ITEMS for x in (k, kind)))[key]
