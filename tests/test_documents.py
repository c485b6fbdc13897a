from pyspark.sql import functions as F

from ledgerlight.functions import comments
from ledgerlight.operators import documents


def blocks(spark, texts):
    return spark.createDataFrame([(1, k, "heading" if t.startswith("#") else "paragraph", t) for k, t in enumerate(texts)], "doc_id long, ordinal int, kind string, text string")


def test_context(spark):
    got = documents.context(blocks(spark, ["PDF-Seite 1", "# A", "x", "PDF-Seite 2", "Anlage 1", "y"])).orderBy("ordinal").collect()
    assert [r.page for r in got] == [1, 1, 1, 2, 2, 2] and [r.section_mark for r in got] == [None, "# A", "# A", "# A", None, None] and got[5].heading == "# A"


def test_contents(spark):
    texts = ["Inhaltsverzeichnis", "Seite", "Lage 1", "Bilanz ..... 4", "PDF-Seite 2", "Prosa ohne Zahl.", "Lage 5", "Rest 6", "Eins 1\nZwei 2\nDrei 3\nVier 3", "Umsatz EUR 12", "a 1", "b 2", "c 3", "d 4", "e 2"]
    assert sorted(r.ordinal for r in documents.contents_blocks(blocks(spark, texts)).collect()) == [0, 2, 3, 8, 10, 11, 12, 13]


def test_table_columns(spark):
    rows = [(1, 0, 0, 1, True, "31.12.2021"), (1, 0, 0, 2, True, "31.12.2020"), (1, 0, 1, 1, True, "TEUR"), (1, 0, 1, 2, True, "%"), (1, 0, 2, 0, False, "Kasse"), (1, 0, 2, 1, False, "1")]
    got = {r.column_no: (r.unit, r.scale, r.year) for r in documents.table_columns(spark.createDataFrame(rows, "doc_id long, table_no int, row_no int, column_no int, header boolean, text string")).collect()}
    assert got == {0: ("EUR", 1000, None), 1: ("EUR", 1000, 2021), 2: ("percent", None, 2020)}


def test_page_tables_and_margins(spark):
    item = lambda t, x, y, w: (1, 1, t, float(x), float(y), float(w), 10.0)
    items = [item("Kopf", 10, 700, 40), item("Langes", 10, 680, 40), item("Kasse", 10, 660, 40), item("1.234", 200, 660, 30), item("99", 300, 660, 10), item("Bank", 10, 640, 30), item("5", 225, 640, 5), item("(7)", 298, 640, 12), item("Ende", 10, 600, 30)]
    df = spark.createDataFrame(items, "doc_id long, page int, text string, x double, y double, width double, height double")
    got = {(r.row_no, r.column_no): r.text for r in documents.page_tables(df).collect()}
    assert got == {(0, 0): "Langes Kasse", (0, 1): "1.234", (0, 2): "99", (1, 0): "Bank", (1, 1): "5", (1, 2): "(7)"}
    lines = spark.createDataFrame([(1, p, n, t) for p in range(1, 5) for n, t in ((1, f"Seite {p}"), (2, f"x{'abcd'[p - 1]}"), (3, "y"), (4, "z" * p))], "doc_id long, page int, line int, text string")
    assert {r.text for r in documents.margins(lines).collect()} == {"Seite #", "y"}


def test_comments(spark):
    row = spark.range(1)
    one = lambda c: row.select(c.alias("x")).first().x
    assert one(comments.comment(F.lit("Soll {a}, ist {b}"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))) == "Soll 1, ist 2"
    assert one(comments.clipped(F.lit("abcdef"), 4)) == "abc…"
    r = comments.rationale("en", F.lit("Scope"), F.lit("yes"), F.lit(9250), F.array(F.lit(3), F.lit(1)))
    assert one(r) == "Scope: yes. Probability 92.5 %. Evidence: [1], [3]."
    none = F.array().cast("array<int>")
    assert one(comments.rationale("de", F.lit("A"), F.lit("nein"), F.lit(9000), none)) == "A: nein. Wahrscheinlichkeit 90 %. Kein Beleg gefunden."
    f = F.array(F.lit("f1"), F.lit("f2"))
    assert one(comments.calculation(F.lit("table_sum"), f, F.array(F.lit(1), F.lit(-1)), F.lit(None).cast("string"))) == ["f1", "− f2"]
    assert one(comments.calculation(F.lit("ratio"), f, none, F.lit("change"))) == ["f2", "− f1", "÷ f1", "× 100"]


def test_page_tables_in_one_pass(spark):
    item = lambda d, page, t, x, y: (d, page, t, float(x), float(y), 20.0, 10.0)
    pages = [(d, page) for d in range(40) for page in range(1, 4)]
    items = [item(d, p, t, x, y) for d, p in pages for t, x, y in ((f"Posten {d}", 10, 660), ("1", 200, 660), ("b", 10, 640), ("a", 10, 640), (str(p), 200, 640), (None, 90, 640))]
    df = documents.page_tables(spark.createDataFrame(items, "doc_id long, page int, text string, x double, y double, width double, height double"))
    assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()  # a frame for each page took longer than its cells
    want = {(d, p, 0, r, c, t) for d, p in pages for r, c, t in ((0, 0, f"Posten {d}"), (0, 1, "1"), (1, 0, "a b"), (1, 1, str(p)))}
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)
