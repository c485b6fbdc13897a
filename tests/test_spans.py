import pytest

from ledgerlight.functions import spans as sp

NUMBERS = [("12.345,6", (123456, 1)), ("9.876.543", (9876543, 0)), ("12,345.67", (1234567, 2)), ("3 .250", (3250, 0)), ("0,75", (75, 2)), ("88.5", (885, 1)), ("4.000", (4000, 0)), ("1,2,3", None), ("7.65.432", None), ("2.468.135,.9", None), ("5.004.321.77", (500432177, 2))]


@pytest.mark.parametrize("raw,want", NUMBERS)
def test_numbers(raw, want):
    assert sp.parse_number(raw) == want


FIGURES = [
    ("Der Gewinn stieg um TEUR 2.310 auf TEUR 8.050.", [("2.310", 2310000), ("8.050", 8050000)]),
    ("Die Vorräte sind von 912 TEUR auf 845 TEUR gefallen.", [("912", 912000), ("845", 845000)]),
    ("Das Ergebnis ging um EUR -77,5 zurück, das sind -3,2 %.", [("-77,5", -77.5), ("-3,2", -3.2)]),
    ("nach § 12 Abs. 3 und 4 UGB betrug die Rücklage EUR 1.500,00", [("1.500,00", 1500)]),
    ("am 3.4.2019 um 14.30 Uhr in der Hauptstraße 12", []),
    ("Laufzeiten von 2 - 6 Jahren", [("2", 2), ("6", 6)]),
    ("ein Verlust von - 1,4 Mio. EUR", [("- 1,4", -1400000)]),
    ("Es gibt 14 Filialen und 220 Beschäftigte (Vorjahr: 215).", [("14", 14), ("220", 220), ("215", 215)]),
    ("Anhang 12-19", []),
    ("(3) wird wie folgt ergänzt", []),
    ("ein 6-Monats-Vertrag", []),
    ("7 Weitere Angaben", []),
    ("Umsatz von 640 (Vorjahr: 655 TEUR)", [("640", 640000), ("655", 655000)]),
    ("gemäß (1) bis (3) sowie Verordnung (EU) Nr. 575", []),
    ("zum 31. Dezember 2020 und im Jahr 2019", []),
    ("1010 Wien, Tel. 01/555 12 34", []),
    ("Wert: 5 kg – 7 kg", [("5", 5), ("7", 7)]),
]


@pytest.mark.parametrize("text,want", FIGURES)
def test_figures(text, want):
    assert [(f.raw, f.micro / sp.MICRO) for f in sp.figures(text, "paragraph", 2020)] == want


def test_periods_units_and_cells():
    f = sp.figures("um TEUR 15 (2019: TEUR 40)", "paragraph", 2020)
    assert [x.period for x in f] == [None, "prior"] and f[1].parenthesized and not f[0].parenthesized
    assert [x.period for x in sp.figures("Personal 40 (Vorjahr Personal 38), nach dem Vorjahr um 5.", "paragraph", 2020)] == [None, "prior", None]
    c = sp.figures("1.203,4", "table_cell", 2020, ("EUR", 1000), "current")[0]
    assert (c.micro, c.display_unit, c.period, c.unit) == (1203400 * sp.MICRO, 100 * sp.MICRO, "current", "EUR")
    assert sp.figures("2.468.135,.9 EUR")[0].issue == "unreadable_format"
    assert sp.figures("PDF-Seite 12") == [] and sp.figures("2 Ertragslage 40 EUR", "heading")[0].raw == "40"
    assert [x.micro for x in sp.figures("7", "table_cell")] == [7 * sp.MICRO] and sp.figures("") == []


def test_dates_years_statements():
    assert [d[3] for d in sp.dates("vom 5. Mai 2018, 9.11.20, 30.2.2019 und 2. Feb. 1850")] == ["2018-05-05", "2020-11-09"]
    assert [y[3] for y in sp.years("Im Jahr 2018 galt Nr. 2013/34 und (EU) 2019/876, seit 1995, am 5. Mai 2017.")] == [2018, 1995, 2017]
    assert [s[3] for s in sp.statements("Die Kosten sanken, der Ertrag erhöhte sich; Zunahme (i.Vj. Abnahme) blieb unverändert.")] == ["down", "up", "flat"]
    assert sp.years("2018", "table_cell") == [] and sp.statements("Rückgang", "heading") == []


def test_words_of_several_parts_are_one_token():
    from ledgerlight.functions import spans

    for words, kind in ((spans.UNITS, "unit"), (spans.PRIOR_WORDS, "prior"), ((*spans.UP, *spans.DOWN, *spans.FLAT), "change"), (spans.REFERENCE_WORDS, "reference")):
        for w in words:
            written = w.replace(" ", " \n").upper() if kind == "change" else w.replace(" ", "  ")
            t = spans.tokens(f"x {written} y")[1]
            assert (t.kind, t.text) == (kind, written), w
    f = spans.figures("Der Umsatz betrug 5 Tsd. EUR", "paragraph", None, None, None)[0]
    assert (f.micro, f.unit, f.scale) == (5_000_000_000, "EUR", 1_000)
    assert [t.kind for t in spans.tokens("Erhöhungen Vorjahreswerte EURO Seitenzahl")] == ["word"] * 4
