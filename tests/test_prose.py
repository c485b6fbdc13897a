from decimal import Decimal

from ledgerlight.functions import prose
from ledgerlight.operators import prose as op

TEXTS = [
    "Die Forderungen sind von TEUR 790 um TEUR 161 auf TEUR 951 gestiegen.",
    "Das Fremdkapital sinkt von 5.198 TEUR auf 5.187 TEUR.",
    "Die Umsatzerlöse stiegen von TEUR 100 auf TEUR 90; der Materialaufwand verringerte sich um TEUR 5 auf TEUR 10.",
    "Die Umsatzerlöse erhöhten sich von TEUR 200 um 10,0 % auf TEUR 220.",
    "Die Vorräte sanken von TEUR 500 um TEUR 100 auf TEUR 300.",
    "Das Eigenkapital ist von TEUR 100 auf TEUR 104 unverändert.",
]


def test_sentences_and_clauses():
    t = "Am 31. Dezember 2021 waren es ca. 5 Mio. EUR (vgl. Nr. 3; Teil a). Danach fiel es; der Rest blieb sowie anderes. Ende"
    s = prose.sentences(t)
    assert [t[a:b] for a, b in s] == ["Am 31. Dezember 2021 waren es ca. 5 Mio. EUR (vgl. Nr. 3; Teil a).", "Danach fiel es; der Rest blieb sowie anderes.", "Ende"]
    assert [t[a:b].strip() for a, b in prose.clauses(t, *s[0])] == [t[: s[0][1]]]
    assert [t[a:b].strip() for a, b in prose.clauses(t, *s[1])] == ["Danach fiel es", "der Rest blieb", "anderes."]


def test_mentions_keep_the_longest():
    assert [m[2] for m in prose.mentions("Pensionsrückstellungen und Rückstellungen")] == ["pensionsrueckstellungen", "rueckstellungen"]
    assert {m[2] for m in prose.mentions("der Verwaltungsaufwand")} == {"allgemeine_verwaltungsaufwendungen", "sachaufwand"}


def test_template_keeps_years():
    assert prose.template("Im Jahr 2024  waren es 1.234,5 TEUR und 7 Fälle") == "Im Jahr 2024 waren es # TEUR und # Fälle"


def test_checks(spark):
    blocks = spark.createDataFrame([(1, k, t) for k, t in enumerate(TEXTS)], "doc_id long, ordinal long, text string")
    found = op.changes(blocks).cache()
    assert {(r.ordinal, r.status, r.rounded) for r in op.sentence_arithmetic(found).collect()} == {(0, "match", False), (4, "mismatch", False)}
    assert {r.ordinal: r.status for r in op.directions(found).collect()} == {0: "match", 1: "match", 2: "mismatch", 3: "match", 4: "match", 5: "match"}
    assert [(r.ordinal, r.status) for r in op.change_ratio(found).collect()] == [(3, "match")]
    values = spark.createDataFrame([(1, "fremdkapital", Decimal(5187400 * 10**6), Decimal(10**8)), (1, "umsatzerloese", Decimal(90000 * 10**6), Decimal(10**6))], "doc_id long, item string, micro decimal(38,0), display_unit decimal(38,0)")
    assert {r.ordinal: (r.status, r.rounded) for r in op.stated_values(found, values).collect()} == {1: ("match", True), 2: ("match", False), 3: ("mismatch", False)}


def test_prior_reports(spark):
    now = spark.createDataFrame([(1, 1, "Im Jahr 2020 zahlten wir 5 EUR."), (1, 2, "Neu in 2020 waren 7 Dinge."), (1, 3, "2021 und 2020 im Vergleich")], "doc_id long, ordinal long, text string")
    prior = spark.createDataFrame([(1, 9, "Im Jahr 2020 zahlten wir 99 EUR.")], "doc_id long, ordinal long, text string")
    assert {r.ordinal: r.status for r in op.stale_years(now, prior, 2021).collect()} == {1: "mismatch", 2: "uncertain"}
    assert {r.status for r in op.stale_years(now, prior.selectExpr("doc_id + 1 AS doc_id", "ordinal", "text"), 2021).collect()} == {"uncertain"}
    schema = "doc_id long, table_no int, row_no int, column_no int, label string, period string, kind string, micro decimal(38,0), display_unit decimal(38,0)"
    cell = lambda row, label, period, v: (1, 1, row, 1, label, period, "amount", Decimal(v), Decimal(1))
    a = spark.createDataFrame([cell(1, "A. Kasse", "prior", 5), cell(2, "Bank:", "prior", -7), cell(3, "Rest", "prior", 1)], schema)
    b = spark.createDataFrame([cell(1, "Kasse", "current", 5), cell(2, "Bank", "current", 7), cell(3, "Rest", "current", 1), cell(4, "Rest", "current", 2)], schema)
    assert {r.row_no: r.status for r in op.prior_report(a, b).collect()} == {1: "match", 2: "mismatch"}


def test_dated_amounts(spark):
    from pyspark.sql import functions as F

    from ledgerlight.operators import prose

    rows = [(1, "Umsatz 30.06.", "EUR", n, 0, v) for n, v in enumerate((500, 700, 500, -500, 500, 501))] + [(1, "Umsatz 30.06.", "percent", 9, 0, 5), (1, "einmal", "EUR", 1, 0, 5), (1, "zwei", "EUR", 3, 2, 5), (1, "zwei", "EUR", 3, 7, 9), (1, None, "EUR", 1, 1, 1), (1, "zwei", "EUR", 3, 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, key string, unit string, ordinal long, start long, v long")
    got = {(r.key, r.ordinal, r.start): (r.code, r.rounded, int(r.difference), r.other_ordinal, r.other_start) for r in prose.dated_amounts(df.withColumn("micro", F.col("v").cast("decimal(38,0)")).withColumn("display_unit", F.lit(1).cast("decimal(38,0)")).drop("v")).collect()}
    u = "Umsatz 30.06."
    assert got == {
        (u, 0, 0): ("reference_matches", False, 0, 4, 0), (u, 1, 0): ("reference_differs", False, 200, 0, 0), (u, 2, 0): ("reference_matches", False, 0, 0, 0), (u, 3, 0): ("reference_sign", False, -1000, 0, 0),
        (u, 4, 0): ("reference_matches", False, 0, 0, 0), (u, 5, 0): ("reference_matches", True, 1, 0, 0), ("zwei", 3, 2): ("reference_differs", False, -4, 3, 7), ("zwei", 3, 7): ("reference_differs", False, 4, 3, 2),
    }
