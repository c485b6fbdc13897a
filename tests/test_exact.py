from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlight.functions import exact, lineitems, text
from ledgerlight.operators import checks


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def d(n):
    return F.lit(Decimal(n)).cast("decimal(38,0)")


def test_tolerance(spark):
    k = 10**9
    for a, au, b, bu, terms, want in ((736 * k, k, 736 * k, k // 10, 1, ("match", False)), (5198 * k, k, 51974 * k // 10, k // 10, 1, ("match", True)), (113 * k, k, 115 * k, k, 1, ("mismatch", False)), (113 * k, k, 115 * k, k, 2, ("match", True))):
        got = one(spark, exact.compared(d(a), d(au), d(b), d(bu), terms))
        assert (got.status, got.rounded) == want


def test_rounding_and_ratios(spark):
    for v, u, want in ((1499, 1000, 1000), (1500, 1000, 2000), (-1500, 1000, -2000), (7, 0, 7), (9_200_000_000_000_000_000_000, 1, 9_200_000_000_000_000_000_000)):
        assert one(spark, exact.round_to(d(v), d(u))) == want
    for a, b, want in ((1, 3, 33333333), (2, 3, 66666667), (-1, 3, -33333333), (1, 0, None), (-5, -10, 50_000_000), (9 * 10**18, 7, (9 * 10**18 * 10**8 * 2 + 7) // 14)):
        assert one(spark, exact.ratio_percent(d(a), d(b))) == want
    assert one(spark, exact.formatted(d(1234567890123), 2)) == "1.234.567,89"
    assert one(spark, exact.formatted(d(-500000), 0, " EUR")) == "-1 EUR"
    assert one(spark, exact.direction(d(2), d(1))) == "down"


def test_text(spark):
    assert one(spark, text.collapse(F.lit(" a \n b "))) == "a b"
    assert one(spark, text.lexical_tokens(F.lit("Die -Zweite Linie- und e2-Geräte!"))) == ["zweite", "linie", "e2-geräte"]
    block = F.lit("Die erste Linie ist so organisiert: Dann folgt die zweite Linie das CISO-Office.")
    for q, want in (("Linie ist so organisiert.", "Linie ist so organisiert"), ("Die zweite Linie das CISO-Office.", "die zweite Linie das CISO-Office."), ("Die zweite Linie bildet das CISO-Office.", None), ("erfunden", None)):
        assert one(spark, text.locate_quote(block, F.lit(q))) == want
    assert one(spark, text.excerpt(F.lit("Ein Satz. " * 5 + "noch einer"), 30)) == "Ein Satz. Ein Satz. Ein Satz."
    assert one(spark, text.excerpt(F.lit("wort " * 20), 12)) == "wort wort"
    assert one(spark, text.safe_cell(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, text.nfkc(F.lit("ﬁnal"))) == "final"


def test_line_items(spark):
    rows = spark.createDataFrame([("A. Eigenkapital:", "eigenkapital"), ("I. Sachanlagen", "sachanlagen"), ("Summe der Passiva", "bilanzsumme"), ("Zinsen", None)], "label string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", lineitems.item_of_label(F.col("label"))).collect())
    accounts = spark.createDataFrame([("Eigenkapital", None), ("Umsatzerlöse 19 %", "umsatzerloese"), ("Personalaufwand Leitung", "personalaufwand"), ("Bank", None)], "label string, want string")
    assert all(r.got == r.want for r in accounts.withColumn("got", lineitems.item_of_account(F.col("label"))).collect())


CELLS = "doc_id long, table_no int, row_no int, column_no int, label string, period string, kind string, micro decimal(38,0), display_unit decimal(38,0)"


def cells(spark, rows):
    return spark.createDataFrame([(1, t, r, c, label, p, "amount", Decimal(v), Decimal(1)) for t, r, c, label, p, v in rows], CELLS)


def test_table_sums(spark):
    rows = [(1, k, 1, label, "current", v) for k, (label, v) in enumerate([("a", 10), ("b", 20), ("Zwischen", 30), ("c", 5), ("d", 6), ("Summe", 41), ("e", 1), ("Gesamt", 50)])]
    got = {r.row_no: (r.status, int(r.expected)) for r in checks.table_sums(cells(spark, rows)).collect()}
    assert got == {2: ("match", 30), 5: ("match", 41), 7: ("mismatch", 42)}


def test_references_and_formulas(spark):
    rows = [(1, 1, 1, "Rückstellungen", "current", 60), (1, 2, 1, "Verbindlichkeiten", "current", 40), (1, 3, 1, "Bilanzsumme", "current", 200), (1, 4, 1, "Eigenkapital", "current", 100), (2, 1, 1, "Bilanzsumme", "current", 205), (2, 2, 1, "Fremdkapital", "current", 101), (2, 3, 1, "Materialaufwand", "prior", -7), (3, 1, 1, "Materialaufwand", "prior", 7)]
    c = cells(spark, rows)
    refs = {(r.table_no, r.row_no): (r.check, r.status) for r in checks.cross_references(c).collect()}
    assert refs == {(2, 1): ("cross_reference", "mismatch"), (3, 1): ("prior_year", "match")}
    made = {r.item: int(r.micro) for r in checks.derived(checks.resolved(checks.facts(c))).collect()}
    assert made == {"fremdkapital": 100, "eigenkapitalquote": 50_000_000, "fremdkapitalquote": 50_000_000}
    assert [(r.row_no, r.status, r.rounded) for r in checks.derived_checks(c).collect()] == [(2, "match", True)]
