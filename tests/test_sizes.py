"""What plans shuffle: with nothing small enough to be broadcast by size, rows are dealt once by document."""

import contextlib
import re

from ledgerlight.operators import documents, facts, recognition, retrieval, structure


@contextlib.contextmanager
def large(spark):
    """Every table counts as too large to be broadcast, as on larger inputs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt(df) -> list[str]:
    """Keys by which the plan shuffles rows of documents."""
    return re.findall(r"Exchange hashpartitioning\((doc_id#[^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_evidence_deals_blocks_once(spark):
    blocks = spark.createDataFrame([(1, 1, "apple pear plum apple", None), (1, 2, "pear tree", "apple"), (2, 1, "sweet red apple cake", None)], "doc_id long, ordinal int, text string, heading string")
    req = spark.createDataFrame([(7, "title", "sweet red apple"), (8, "aspect", "pear")], "req_id long, part string, text string")
    with large(spark):
        df = retrieval.packets(blocks, req)
        assert len(dealt(df)) == 1
        got = {(r.doc_id, r.req_id, r.ordinal): (r.role, r.matched_terms) for r in df.collect()}
    assert got[2, 7, 1] == ("match", "apple red sweet")


def test_facts_deal_rows_once(spark):
    figure = "doc_id long, table_no int, row_no int, column_no int, label string, alternate boolean, level int, period string, column_period string, micro decimal(38,0), display_unit decimal(38,0), unit string, issue boolean, amount boolean, change boolean, percent boolean, davon boolean"
    row = lambda r, c, label, v: (1, 1, r, c, label, False, None, "current", "current", v, 1, "EUR", False, True, False, False, False)
    rows = [row(0, 1, "Bilanzsumme", 90), row(0, 2, "Bilanzsumme", 100), row(1, 1, "Eigenkapital", 30), row(1, 2, "Eigenkapital", 40), row(2, 2, "Summe", 40)]
    deal = lambda data, schema: spark.createDataFrame(data, schema)
    figures = deal(rows, figure.replace("decimal(38,0)", "long"))
    figures = figures.withColumns({c: figures[c].cast("decimal(38,0)") for c in ("micro", "display_unit")})
    groups = deal([(1, 1, 1, "Inland"), (1, 1, 2, "Gesamt")], "doc_id long, table_no int, column_no int, `group` string")
    captions = deal([(1, 1, "Entwicklung des Eigenkapitals")], "doc_id long, table_no int, caption string")
    sums = deal([(1, 1, 2, 2, "match", "+0+1", "Summe", False)], "doc_id long, table_no int, row_no int, column_no int, status string, parts string, label string, relabelled boolean")
    built = facts.build(figures, captions, groups, sums)
    with large(spark):
        keys = dealt(facts.build(figures, captions, groups, sums))
    assert len(keys) == 1 and re.fullmatch(r"doc_id#\d+L?, \d+", keys[0])
    got = {(r.row_no, r.column_no): (r.key, r.via_caption, r.confirmed, r.terms) for r in built.collect()}
    assert got == {(0, 2): ("bilanzsumme", False, False, 1), (1, 2): ("eigenkapital", False, False, 1), (2, 2): ("eigenkapital", True, True, 2)}



def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_margins_order_lines_once(spark):
    lines = [(1, p, n, t) for p in range(1, 6) for n, t in ((1, f"Seite {p}"), (2, "Seite  9"), (3, "x" * p), (4, "y" if p < 3 else "z" * p))]
    lines += [(2, p, 1, "Seite 1") for p in (1, 1, 2)] + [(3, None, 1, "a")] * 3 + [(None, p, 1, "b") for p in range(1, 5)]
    df = documents.margins(spark.createDataFrame(lines, "doc_id long, page int, line int, text string").repartition(3, "doc_id"))
    with large(spark):
        assert plan(df).count("Sort [") == 1 and "Join" not in plan(df)
        assert [tuple(r) for r in df.collect()] == [(1, "Seite #")]  # on five pages, twice on each


def test_line_blocks_look_at_lines_once(spark):
    rows = [(d, 1, n, t, 700.0 - 12 * n, h) for d in (1, 2, None) for n, t, h in ((1, "Titel", 20.0), (2, "Eins", 10.0), (3, "- zwei", 10.0))]
    df = structure.line_blocks(spark.createDataFrame(rows, "doc_id long, page int, line int, text string, y double, height double"))
    with large(spark):
        assert len(dealt(df)) == 1 and "Join" not in plan(df)
        assert sorted((r.doc_id, r.kind, r.text) for r in df.collect()) == [(d, k, t) for d in (1, 2) for k, t in (("heading", "Titel"), ("list_item", "- zwei"), ("paragraph", "Eins"))]


def test_years_are_read_once(spark):
    rows = [(1, 1, "Im Jahr 2020 und 2021"), (1, 2, "2021"), (1, 500, "2019, 2019, 2019"), (2, 401, "2018"), (3, 1, "nichts")]
    df = recognition.report_year(spark.createDataFrame(rows, "doc_id long, ordinal long, text string"))
    assert plan(df).count("MapInArrow") == 1
    assert [tuple(r) for r in df.collect()] == [(1, 2021, 6)]


def test_tasks_grow_in_number_not_in_size(spark, monkeypatch):
    from ledgerlight.plans import common

    monkeypatch.setattr(common, "ROWS", 10)
    assert common.dealt(spark.range(95), "id").rdd.getNumPartitions() == 10 and common.dealt(spark.range(5), "id").rdd.getNumPartitions() == 4


def test_references_and_prior_reports_stay_dealt(spark):
    from ledgerlight.operators import checks, prose

    schema = "doc_id long, table_no int, row_no int, column_no int, label string, period string, kind string, micro long, display_unit long"
    at = lambda t, r, label, v, p="current", d=1: (d, t, r, 1, label, p, "amount", v, 1)
    cells = spark.createDataFrame([at(1, 1, "Eigenkapital", 10), at(2, 1, "Eigenkapital", 15), at(2, 2, "Eigenkapital", 10, "prior"), at(3, 1, "Eigenkapital", 10, "prior", None)], schema).repartition(3, "doc_id")
    found, said = checks.cross_references(cells), prose.prior_report(cells, cells.where("table_no = 1"))
    assert "Join" not in plan(said) and plan(found).count("SortMergeJoin") + plan(found).count("BroadcastHashJoin") == 1  # of labels and the catalogue
    assert [(r.table_no, r.check, r.status, int(r.expected)) for r in found.where("doc_id IS NOT NULL").collect()] == [(2, "cross_reference", "mismatch", 10)]
    assert [(r.table_no, r.status) for r in said.collect()] == [(2, "match")]


def test_tables_in_between_keep_no_shuffle_files(spark):
    import time

    from ledgerlight.operators import rounds

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept() -> set[str]:
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = kept()
    got = rounds.settled(spark.range(1000).repartition(3, "id"))
    until = time.time() + 20
    while kept() - before and time.time() < until and not time.sleep(0.2):
        pass
    assert not kept() - before and spark.conf.get(rounds.CLEANUP) == "false"
    assert got.count() == 1000


def test_cells_of_tables_are_dealt_by_document(spark):
    from ledgerlight.operators import tables

    schema = "doc_id long, ordinal long, page int, table_no int, row_no int, column_no int, header boolean, column_label string, text string, micro decimal(38,0), display_unit decimal(38,0), decimals int, unit string, period string, parenthesized boolean, issue boolean"
    with large(spark):
        keys = dealt(tables.parts(spark.createDataFrame([], schema)))
        assert len(keys) == 1 and "," not in keys[0].split(", ")[0]
