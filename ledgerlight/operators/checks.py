"""Plausibility checks over report tables in long form.

``cells``: doc_id, table_no, row_no, column_no, label, period, kind (amount, change,
percent or total), micro, display_unit. Every check gives doc_id, table_no, row_no,
column_no, check, status, actual, expected, tolerance, rounded, all amounts exact.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import compared, ratio_percent, whole
from ..functions.lineitems import item_of_label, kind_of_item

PLACE = ("doc_id", "table_no", "row_no", "column_no")
_SUMS = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int32()) for c in PLACE[1:]), ("check", pa.string()), ("status", pa.string()), *((c, pa.string()) for c in ("actual", "expected", "tolerance")), ("rounded", pa.bool_())]
)
#: Words of a column that counts or measures something else than money. Fixed values.
NO_MONEY = "Nutzungsdauer|in Jahren|\\bJahre\\b|Anzahl|Stück|Mitarbeiter|Personen|Laufzeit in"
#: Checks that are not told while they are uncertain. Fixed values.
SILENT_KINDS, SILENT_CODES = ("table_sum", "horizontal_sum"), ("direction_unclear",)


def amount_column(percent: Column, label: Column) -> Column:
    """Whether a column holds amounts of money."""
    return ~F.coalesce(percent, F.lit(False)) & ~F.coalesce(label.rlike(f"(?iu){NO_MONEY}"), F.lit(False))


def silent(status: Column, check: Column, code: Column) -> Column:
    """Whether a check makes no finding: an uncertain sum, whose parts are not sure, or an unclear direction."""
    return (status == "uncertain") & (check.isin(*SILENT_KINDS) | F.coalesce(code.isin(*SILENT_CODES), F.lit(False)))


def judged(rows: DataFrame, check: str | Column, actual: Column, unit: Column, expected: Column, expected_unit: Column, terms: Column | int = 1, certain: Column | None = None) -> DataFrame:
    """Rows as checks; a mismatch that is not certain is only uncertain."""
    c = rows.withColumn("_c", compared(actual, unit, expected, expected_unit, terms))
    status = F.col("_c.status") if certain is None else F.when((F.col("_c.status") == "mismatch") & ~certain, "uncertain").otherwise(F.col("_c.status"))
    return c.select(*PLACE, (F.lit(check) if isinstance(check, str) else check).alias("check"), status.alias("status"), whole(actual).alias("actual"), whole(expected).alias("expected"), F.col("_c.tolerance").alias("tolerance"), F.col("_c.rounded").alias("rounded"))


def horizontal_sums(cells: DataFrame) -> DataFrame:
    """A row's total against its parts of the same period; with parts missing a mismatch is uncertain."""
    parts = cells.where("kind = 'amount'").groupBy("doc_id", "table_no", "row_no").agg(
        F.sum("micro").alias("expected"), F.max(F.when(F.col("micro") != 0, F.col("display_unit")).otherwise(0)).alias("unit"), F.count_if(F.col("micro") != 0).alias("terms"), F.count("micro").alias("n")
    )
    width = parts.groupBy("doc_id", "table_no").agg(F.max("n").alias("width"))
    totals = cells.where("kind = 'total'").join(parts, ["doc_id", "table_no", "row_no"]).join(width, ["doc_id", "table_no"])
    return judged(totals, "horizontal_sum", F.col("micro"), F.col("display_unit"), F.col("expected"), F.col("unit"), F.col("terms"), F.col("n") == F.col("width"))


def change_columns(cells: DataFrame) -> DataFrame:
    """Change columns against current less prior; a column counts as one only if most of its rows agree."""
    amounts = lambda p, name: cells.where((F.col("kind") == "amount") & (F.col("period") == p)).select("doc_id", "table_no", "row_no", F.col("micro").alias(name), F.col("display_unit").alias(f"{name}_unit"))
    both = cells.where("kind = 'change'").join(amounts("current", "now"), ["doc_id", "table_no", "row_no"]).join(amounts("prior", "past"), ["doc_id", "table_no", "row_no"])
    found = judged(both, "change_column", F.col("micro"), F.col("display_unit"), F.col("now") - F.col("past"), F.greatest("now_unit", "past_unit"), 2)
    column = Window.partitionBy("doc_id", "table_no", "column_no")
    return found.withColumn("_most", 2 * F.count_if(F.col("status") == "match").over(column) > F.count("*").over(column)).where("_most").drop("_most")


def balances(totals: DataFrame) -> DataFrame:
    """The total of the liabilities against the last total of the assets before it, of one document and period.

    ``totals``: PLACE, period, side (assets or liabilities), micro, display_unit.
    """
    w = Window.partitionBy("doc_id", "period").orderBy("table_no", "row_no", "column_no").rowsBetween(Window.unboundedPreceding, -1)
    assets = F.last(F.when(F.col("side") == "assets", F.struct("micro", "display_unit")), ignorenulls=True).over(w)
    both = totals.withColumn("_a", assets).where((F.col("side") == "liabilities") & F.col("_a").isNotNull())
    return judged(both, "balance", F.col("micro"), F.col("display_unit"), F.col("_a.micro"), F.col("_a.display_unit"))


def facts(cells: DataFrame) -> DataFrame:
    """Amounts whose row label names a line item: PLACE, item, item_kind, period, micro, display_unit."""
    labels = cells.select("label").distinct().withColumn("item", item_of_label(F.col("label"))).where("item IS NOT NULL")
    return cells.where("kind = 'amount'").join(labels, "label").select(*PLACE, "item", kind_of_item(F.col("item")).alias("item_kind"), "period", "micro", "display_unit")


def resolved(found: DataFrame) -> DataFrame:
    """One value for each item and period of a document: the finest unit, then the first place; with whether all agree."""
    order = F.struct("display_unit", "table_no", "row_no", "column_no")
    best = found.groupBy("doc_id", "item", "item_kind", "period").agg(F.min_by(F.struct(*PLACE[1:], "micro", "display_unit"), order).alias("b"), F.count("*").alias("n"))
    return best.select("doc_id", "item", "item_kind", "period", F.col("b.table_no").alias("ref_table"), F.col("b.row_no").alias("ref_row"), F.col("b.column_no").alias("ref_column"), F.col("b.micro").alias("ref_micro"), F.col("b.display_unit").alias("ref_unit"), "n")


def cross_references(cells: DataFrame) -> DataFrame:
    """Every further mention of an item against its reference; expenses by magnitude.

    The reference comes from a window: rows stay as they are dealt by document.
    """
    best = F.min(F.struct("display_unit", *PLACE[1:], "micro")).over(Window.partitionBy("doc_id", "item", "item_kind", "period"))
    both = facts(cells).withColumn("r", best).where("NOT (table_no = r.table_no AND row_no = r.row_no AND column_no = r.column_no)")
    size = lambda c: F.when(F.col("item_kind") == "expense", F.abs(F.col(c))).otherwise(F.col(c))
    kind = F.when(F.col("period") == "prior", "prior_year").otherwise("cross_reference")
    return judged(both, kind, size("micro"), F.col("display_unit"), size("r.micro"), F.col("r.display_unit"))


def derived(values: DataFrame) -> DataFrame:
    """Values of formulas over resolved items: doc_id, period, item, micro, display_unit.

    Liabilities are the sum of provisions and liabilities; ratios are shares of the total in
    micro per cent; net interest is income less expense; so is commission.
    """
    at = lambda item: F.max(F.when(F.col("item") == item, F.col("ref_micro")))
    unit = F.max("ref_unit")
    wide = values.groupBy("doc_id", "period").agg(
        at("rueckstellungen").alias("r"), at("verbindlichkeiten").alias("v"), at("bilanzsumme").alias("b"), at("eigenkapital").alias("e"), at("zinsertraege").alias("zi"),
        at("zinsaufwendungen").alias("za"), at("provisionsertraege").alias("pi"), at("provisionsaufwendungen").alias("pa"), unit.alias("unit"),
    )
    debt = F.col("r") + F.col("v")
    u, none = F.col("unit"), F.lit(0)
    made = (
        ("fremdkapital", debt, u), ("eigenkapitalquote", ratio_percent(F.col("e"), F.col("b")), none), ("fremdkapitalquote", ratio_percent(debt, F.col("b")), none),
        ("nettozinsertrag", F.col("zi") - F.abs("za"), u), ("provisionsergebnis", F.col("pi") - F.abs("pa"), u),
    )
    rows = F.array(*(F.struct(F.lit(k).alias("item"), whole(v).alias("micro"), whole(n).alias("display_unit")) for k, v, n in made))
    return wide.select("doc_id", "period", F.explode(rows).alias("x")).select("doc_id", "period", "x.*").where("micro IS NOT NULL")


def derived_checks(cells: DataFrame) -> DataFrame:
    """Rows of items that a formula gives against the formula, with tolerance for two terms.

    Both sides have rows for each document: they are merged, since a plan takes them for as
    small as the file that they are made from and would send one side through the driver.
    """
    f = facts(cells)
    made = derived(resolved(f)).select("doc_id", "period", "item", F.col("micro").alias("expected"), F.col("display_unit").alias("unit"))
    return judged(f.join(made.hint("merge"), ["doc_id", "period", "item"]), "derived", F.col("micro"), F.col("display_unit"), F.col("expected"), F.col("unit"), 2)


def evidence(cells: DataFrame, accounts: DataFrame) -> DataFrame:
    """Current amounts of an item against the sum of its accounts (doc_id, item, closing), by magnitude and cents."""
    sums = accounts.groupBy("doc_id", "item").agg(F.sum("closing").alias("total"))
    both = facts(cells.where("period = 'current'")).join(sums, ["doc_id", "item"])
    signed = F.abs("total") * F.when(F.col("micro") < 0, -1).otherwise(1)
    return judged(both, "evidence", F.col("micro"), F.col("display_unit"), signed, F.lit(10_000))


def table_sums(cells: DataFrame, total: str = r"(?i)^(?:summe|gesamt|total|insgesamt)") -> DataFrame:
    """Totals within a column against the rows before them, one table at a time.

    Rows go on a stack; a labelled total takes the shortest run of 2 to 12 rows on top that
    gives it, else all of them and is a mismatch; other rows that equal such a run within
    their own unit are subtotals found. A total stands for the rows that it took. The
    whole rules, with the tolerance of all terms, are those of ``tables.list_sums``.
    ``micro`` and ``display_unit`` may be texts of whole numbers, for amounts that no
    DECIMAL holds; the checks' amounts are texts then too.
    """
    import re

    is_total = re.compile(total)
    as_text = dict(cells.dtypes)["micro"] == "string"

    def taken(stack: list[tuple[int, int]], value: int, unit: int, labelled: bool):
        """(rows, their sum, tolerance) of the run on top that gives the value, else of all for a total; null for none."""
        run, top, terms = 0, unit, 0
        for n, (v, u) in enumerate(reversed(stack[-12:]), 1):
            run += v
            if v:
                top, terms = max(top, u), terms + 1
            if n > 1 and abs(value - run) <= (top * max(1, terms) if labelled else 0):
                return n, run, top * max(1, terms)
        if labelled and stack:
            return len(stack), sum(v for v, _ in stack), max([unit, *(u for _, u in stack)]) * len(stack)
        return None

    def run(batches):
        last, stack = None, []  # of the column that goes on
        for b in batches:
            out = []
            for doc, table, column, row, label, micro, display_unit in zip(*(c.to_pylist() for c in b.columns)):
                if last != (doc, table, column):
                    last, stack = (doc, table, column), []
                value, unit = int(micro), int(display_unit)
                hit = taken(stack, value, unit, bool(is_total.search(label or "")))
                if hit:
                    n, expected, most = hit
                    match = abs(value - expected) <= most
                    out.append((doc, table, row, column, "table_sum", "match" if match else "mismatch", str(value), str(expected), str(most), match and value != expected))
                    del stack[-n:]
                stack.append((value, unit))
            columns = list(zip(*out)) or [[] for _ in _SUMS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMS)], schema=_SUMS)

    kept = cells.where("kind = 'amount' AND micro IS NOT NULL AND column_no IS NOT NULL").selectExpr(
        "CAST(doc_id AS LONG) AS doc_id", "CAST(table_no AS INT) AS table_no", "CAST(column_no AS INT) AS column_no", "CAST(row_no AS INT) AS row_no", "label", *(c if as_text else f"CAST(CAST({c} AS DECIMAL(38,0)) AS STRING) AS {c}" for c in ("micro", "display_unit"))
    )
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small tables stay spread: the work is Python's, not the bytes'
    ordered = kept.repartition(parts, "doc_id", "table_no").sortWithinPartitions("doc_id", "table_no", "column_no", "row_no")
    found = ordered.mapInArrow(run, "doc_id long, table_no int, row_no int, column_no int, check string, status string, actual string, expected string, tolerance string, rounded boolean")
    return found if as_text else found.withColumns({c: whole(F.col(c)) for c in ("actual", "expected", "tolerance")})


def composed(families: list[DataFrame], subject: list[str]) -> DataFrame:
    """Checks of all families (``subject``, check, status, ...) with ``seq``, the family's place; of one subject and check the first family's."""
    parts = [f.withColumn("seq", F.lit(n)) for n, f in enumerate(families, 1)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    first = Window.partitionBy(*subject, "check").orderBy("seq")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def findings(checks: DataFrame) -> DataFrame:
    """One numbered finding for each place whose worst check is no match; of equally bad checks the first in ``seq``."""
    rank = F.when(F.col("status") == "mismatch", 2).when(F.col("status") == "uncertain", 1).otherwise(0)
    worst = checks.groupBy(*PLACE).agg(F.max_by(F.struct("check", "status", "actual", "expected"), F.struct(rank, -F.col("seq"))).alias("w")).where("w.status <> 'match'")
    order = Window.partitionBy("doc_id").orderBy("table_no", "row_no", "column_no")
    return worst.select(*PLACE, "w.*").withColumn("finding", F.row_number().over(order))
