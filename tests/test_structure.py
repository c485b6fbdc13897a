from ledgerlight.operators import structure
from ledgerlight.operators.structure import page_blocks

HTML = """<h1 class="title">Richtlinie</h1><h1>1. Zweck</h1><p><strong>2.1 Aufgabentrennung</strong></p><ul><li>eins &amp; zwei<br />drei</li></ul>
<table><thead><tr><th>Jahr</th></tr></thead><tbody><tr><td colspan="2">a</td><td>b<table><tr><td>innen</td></tr></table></td></tr></tbody></table><p>Ende &#228;&bogus;</p><h1>3. Neu</h1>"""


def test_html_blocks():
    got = page_blocks(HTML)
    assert [(r[1], r[2], r[3]) for r in got] == [
        ("heading", "Richtlinie", 0), ("heading", "1. Zweck", 1), ("heading", "2.1 Aufgabentrennung", 2), ("list_item", "eins & zwei drei", None),
        ("table_cell", "Jahr", None), ("table_cell", "a", None), ("table_cell", "b", None), ("table_cell", "innen", None), ("paragraph", "Ende ä&bogus;", None), ("heading", "3. Neu", 1),
    ]
    cells = [r[4:] for r in got if r[1] == "table_cell"]
    assert cells == [(0, 0, 0, True), (0, 1, 0, False), (0, 1, 2, False), (1, 0, 0, False)]


def test_heading_paths(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "plain")], "page_id long, html string")
    got = {(r.doc_id, r.ordinal): r.heading_path for r in structure.outlined(structure.html_blocks(pages, "page_id", "html")).collect()}
    assert got[1, 1] == [] and got[1, 2] == ["Richtlinie"] and got[1, 3] == ["Richtlinie", "1. Zweck"]
    assert got[1, 4] == ["Richtlinie", "1. Zweck", "2.1 Aufgabentrennung"] and got[1, 10] == ["Richtlinie"] and got[3, 1] == []
    assert not any(k[0] == 2 for k in got)


def test_positioned_text(spark):
    items = [(1, 1, 0, "Er", 10.0, 700.0, 10.0, 10.0, False), (1, 1, 1, "ste", 20.0, 700.0, 12.0, 10.0, False), (1, 1, 2, "Zeile", 40.0, 700.0, 20.0, 10.0, True), (1, 1, 3, "Zweite", 10.0, 686.0, 30.0, 10.0, True), (1, 1, 4, "Fern", 10.0, 600.0, 30.0, 10.0, True)]
    lines = structure.page_lines(spark.createDataFrame(items, "doc_id long, page int, pos int, text string, x double, y double, width double, height double, end_of_line boolean"))
    assert [(r.text, r.y) for r in lines.orderBy("line").collect()] == [("Erste Zeile", 700.0), ("Zweite", 686.0), ("Fern", 600.0)]
    assert [(r.kind, r.text) for r in structure.line_blocks(lines).orderBy("ordinal").collect()] == [("paragraph", "Erste Zeile Zweite"), ("paragraph", "Fern")]
