"""Sheets in long form (file_id, row_no, column_no, value) to trial balances and checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles of header cells: (role, pattern over lower-case text with single spaces), first match wins. Fixed values.
TRIAL_BALANCE = (
    ("account", "^(?:konto|kontonummer|konto nr|kontonr|sachkonto|account|account number)$"), ("label", "^(?:beschriftung|bezeichnung|kontobezeichnung|kontoname|name|text|label|description)$"),
    ("opening", "^(?:eb wert|eb|eröffnungsbilanz|anfangsbestand|opening)$"), ("closing_debit", "^(?:saldo soll|soll saldo|endsaldo soll)$"), ("closing_credit", "^(?:saldo haben|haben saldo|endsaldo haben)$"),
    ("closing", "^(?:saldo|endsaldo|schlusssaldo|closing|balance)$"), ("debit", "^(?:soll|jvz soll|umsatz soll|debit)$"), ("credit", "^(?:haben|jvz haben|umsatz haben|credit)$"), ("side", "^(?:s h|sh|soll haben|kennzeichen)$"),
)
CHECKLIST = (
    ("key", "^(?:schlüssel|key|nr|nummer|id)$"), ("reference", "^(?:fundstelle|referenz|norm|reference)$"), ("title", "^(?:titel|title|bezeichnung)$"), ("requirement", "^(?:anforderung|requirement|text)$"),
    ("aspects", "^(?:aspekte|prüfaspekte|aspects)$"), ("parent", "^(?:übergeordnet|eltern|parent|parent key)$"), ("order", "^(?:reihenfolge|sortierung|order)$"),
)
HEADER_ROWS = 20


def header_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[./:_\\-–]+", " "), "\\s+", " "))


def roles(cells: DataFrame, patterns, needed: Column) -> DataFrame:
    """(file_id, header_row, columns map) of the first of the top rows whose roles satisfy ``needed`` (over column ``roles``)."""
    key = header_text(F.col("value"))
    role = F.coalesce(*(F.when(key.rlike(p), F.lit(r)) for r, p in patterns))
    named = cells.where(F.col("row_no") <= HEADER_ROWS).withColumn("role", role).where("role IS NOT NULL")
    one = named.groupBy("file_id", "row_no", "role").agg(F.min("column_no").alias("column_no"))
    rows = one.groupBy("file_id", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("role", "column_no"))).alias("columns")).withColumn("roles", F.map_keys("columns"))
    return rows.where(needed).groupBy("file_id").agg(F.min_by("columns", "row_no").alias("columns"), F.min("row_no").alias("header_row"))


def _rows(cells: DataFrame, head: DataFrame, patterns) -> DataFrame:
    """Rows below the header with one column for each role."""
    below = cells.join(head, "file_id").where("row_no > header_row")
    at = lambda r: F.first(F.when(F.col("column_no") == F.try_element_at("columns", F.lit(r)), F.col("value")), ignorenulls=True).alias(r)
    return below.groupBy("file_id", "header_row", "row_no").agg(*(at(r) for r, _ in patterns), F.bool_or(F.coalesce(F.trim("value"), F.lit("")) != "").alias("filled"))


def sheet_amount(c: Column) -> Column:
    """Struct(micro, side) of a cell: German text such as ``1.234,56 H``, or a plain decimal number rounded to cents; null if it is neither."""
    t = F.trim(F.regexp_replace(c, "\\s+", " "))
    german = "^([-–]?) ?(\\d{1,3}(?:\\.\\d{3})+|\\d+)(?:,(\\d{1,2}))? ?([SH])?$"
    plain = "^-?\\d+\\.\\d+$"
    part = lambda k: F.regexp_extract(t, german, k)
    cents = F.regexp_replace(part(2), "\\.", "").cast("decimal(30,0)") * 100 + F.coalesce(F.rpad(part(3), 2, "0").try_cast("int"), F.lit(0))
    text = F.struct((cents * 10_000 * F.when(part(1) == "", 1).otherwise(-1)).cast("decimal(38,0)").alias("micro"), F.nullif(part(4), F.lit("")).alias("side"))
    number = F.struct((F.round(t.try_cast("decimal(30,10)"), 2) * 1_000_000).cast("decimal(38,0)").alias("micro"), F.lit(None).cast("string").alias("side"))
    return F.when(t.rlike(plain) & ~t.rlike("^\\d{1,3}(?:\\.\\d{3})+$"), number).when(t.rlike(german), text)


def trial_balance(cells: DataFrame) -> DataFrame:
    """(file_id, row_no, account, label, opening, debit, credit, closing): rows with an account number of 3 to 9 digits.

    The closing balance is the balance column with its side, else its debit less its credit
    column, else opening plus debit less credit.
    """
    has = lambda *r: F.forall(F.array(*map(F.lit, r)), lambda x: F.array_contains(F.col("roles"), x))
    head = roles(cells, TRIAL_BALANCE, has("account", "label") & (has("closing") | has("closing_debit", "closing_credit") | has("debit", "credit")))
    rows = _rows(cells, head, TRIAL_BALANCE).where(F.trim("account").rlike("^\\d{3,9}$"))
    names = ("opening", "debit", "credit", "closing", "closing_debit", "closing_credit")
    parsed = rows.withColumns({f"_{n}": sheet_amount(F.col(n)) for n in names})

    def signed(n: str) -> Column:
        a = F.col(f"_{n}")
        credit = F.coalesce(a["side"], F.when(F.upper(F.trim("side")).startswith("H"), "H")) == "H"
        return F.when(F.coalesce(credit, F.lit(False)) & (a["micro"] > 0), -a["micro"]).otherwise(a["micro"])

    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,0)"))
    micro = lambda n: F.col(f"_{n}.micro")
    split = F.when(micro("closing_debit").isNotNull() | micro("closing_credit").isNotNull(), zero(micro("closing_debit")) - zero(micro("closing_credit")))
    moved = F.when(micro("debit").isNotNull() | micro("credit").isNotNull() | micro("opening").isNotNull(), zero(signed("opening")) + zero(micro("debit")) - zero(micro("credit")))
    closing = F.coalesce(signed("closing"), split, moved).cast("decimal(38,0)")
    return parsed.select("file_id", "row_no", F.trim("account").alias("account"), F.trim("label").alias("label"), signed("opening").alias("opening"), micro("debit").alias("debit"), micro("credit").alias("credit"), closing.alias("closing"))


def skipped_rows(cells: DataFrame) -> DataFrame:
    """(file_id, skipped): filled rows below the header without an account number."""
    has = lambda *r: F.forall(F.array(*map(F.lit, r)), lambda x: F.array_contains(F.col("roles"), x))
    head = roles(cells, TRIAL_BALANCE, has("account", "label") & (has("closing") | has("closing_debit", "closing_credit") | has("debit", "credit")))
    rows = _rows(cells, head, TRIAL_BALANCE)
    return rows.groupBy("file_id").agg(F.count_if(F.col("filled") & ~F.coalesce(F.trim("account").rlike("^\\d{3,9}$"), F.lit(False))).alias("skipped"))


def checklist(cells: DataFrame) -> DataFrame:
    """(file_id, row_no, key, reference, title, requirement, aspects, parent, order) of a checklist sheet without its blank rows."""
    has = lambda *r: F.forall(F.array(*map(F.lit, r)), lambda x: F.array_contains(F.col("roles"), x))
    rows = _rows(cells, roles(cells, CHECKLIST, has("key", "title", "requirement")), CHECKLIST).where("filled")
    aspects = F.filter(F.transform(F.split(F.coalesce("aspects", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("file_id", "row_no", *(F.trim(c).alias(c) for c in ("key", "reference", "title", "requirement")), aspects.alias("aspects"), F.nullif(F.trim("parent"), F.lit("")).alias("parent"), F.trim("order").try_cast("int").alias("order"))
