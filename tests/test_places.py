"""Queries over line items that the generated tables hold only in large copies; and how rows of small files are dealt."""

import os

import pytest
from oracle import compare

from ledgerlight.operators import checks
from ledgerlight.plans import registry, reports

SF = "/root/testdata/sf0.001"


def items(spark, place, rows):
    """A folder with line items (order, line, part, quantity)."""
    made = [(k, p, 5, n, float(q)) for k, n, p, q in rows]
    spark.createDataFrame(made, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{place}/lineitem.parquet")
    return str(place)


def test_a_second_column_less_another_is_a_change(spark, tmp_path):
    sf = items(spark, tmp_path, [(3, n, 50 * n + n % 2, 10 + n) for n in range(1, 8)] + [(6, n, 50 * n, 20) for n in range(1, 8)] + [(9, n, 7 * n, 30) for n in range(1, 8)])
    compare(registry.QUERIES["d9_table_model"](spark, sf), registry.ORACLES["d9_table_model"], sf)


def test_orders_with_a_line_number_twice(spark, tmp_path):
    sf = items(spark, tmp_path, [(1, 1, 10 + k, 1) for k in range(4)] + [(1, 2, 20, 4), (2, 1, 30, 7), (2, 3, 31, 8), (2, 3, 32, 9)] + [(5, 1 + n // 4, n, 3) for n in range(17)])
    assert compare(registry.QUERIES["d10_table_sums"](spark, sf), registry.ORACLES["d10_table_sums"], sf) == 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sentences_of_a_small_file_are_dealt_over_all_tasks(spark):
    assert reports.sentences(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sums_of_tables_over_several_batches(spark):
    rows = [(d, 1, r, c, "Summe" if r == 9 else None, "amount", 100 * (d + c) * 4**r if r < 9 else 100 * (d + c) * sum(4**x for x in range(9)) + d % 2 * 99, 1) for d in range(30) for c in (1, 2) for r in range(10)]
    cells = spark.createDataFrame(rows, "doc_id long, table_no int, row_no int, column_no int, label string, kind string, micro long, display_unit long")
    cells = cells.selectExpr("* EXCEPT (micro, display_unit)", "CAST(micro AS DECIMAL(38,0)) AS micro", "CAST(display_unit AS DECIMAL(38,0)) AS display_unit")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        sums = checks.table_sums(cells)
        assert "InPandas" not in sums._jdf.queryExecution().toString()  # no frame of its own for each table
        got = {(r.doc_id, r.row_no, r.column_no): (r.status, int(r.actual - r.expected), int(r.tolerance)) for r in sums.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(d, 9, c): ("mismatch" if d % 2 else "match", d % 2 * 99, 9) for d in range(30) for c in (1, 2)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["d16_cross_references", "d17_derived_checks", "d23_prior_report"])
def test_rows_of_all_documents_are_not_sent_through_the_driver(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in joins if "doc_id" in line], joins


@pytest.mark.parametrize("lines", [19, 51, 130])
def test_totals_of_orders_of_any_length(spark, tmp_path, lines):
    sf = items(spark, tmp_path, [(k, n % 7, n, 2) for k in (1, 4, 9) for n in range(lines)])
    total = 100 * (4 ** (lines + 1) - 4) // 3 + 2 * lines
    want = {(k, "match" if off <= lines else "mismatch", str((total + off) * 10**6), str(total * 10**6), f"{lines}000000", 0 < off <= lines) for k, off in ((1, 0), (4, 1), (9, 50))}
    got = {(r.doc_id, r.status, r.actual, r.expected, r.tolerance, r.rounded) for r in registry.QUERIES["d10_table_sums"](spark, sf).collect()}
    assert got == want


def test_all_checks_of_a_long_order(spark, tmp_path):
    sf = items(spark, tmp_path, [(k, n % 7, n, 2) for k in (1, 9) for n in range(40)])
    spark.createDataFrame([(1, 5), (9, 6)], "o_orderkey long, o_custkey long").write.parquet(f"{sf}/orders.parquet")
    got = sorted((r.doc_id, r.check, r.status) for r in registry.QUERIES["d24_all_checks"](spark, sf).where("check = 'table_sum'").collect())
    assert got == [(1, "table_sum", "match"), (9, "table_sum", "mismatch")]
