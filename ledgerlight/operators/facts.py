"""What tables say about line items: facts, one value for each item, formulas over values, references between tables.

``figures`` is the long table of ``tables.model``. All grouping is partial before it is
shuffled: a group keeps its best fact and the bounds of its values, never a list of its facts,
so that a document or an item with very many facts costs no more than its rows. What a plan reads
more than once is written once (``settled``), which keeps plans small and survives lost executors.

Null captions, groups, periods and figures are as if they were not there; empty tables give no rows.
"""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import compared, ratio_percent, whole
from ..functions.lineitems import item_of_caption, item_of_label, kind_of_item
from .checks import PLACE
from .rounds import settled

TABLE, VALUE = ("doc_id", "table_no"), ("doc_id", "key", "period")
#: Labels of rows that sum up a whole table, column groups that hold the total, column groups that name a unit or a date only. Fixed values.
SUM_ROW, TOTAL_GROUP = "(?iu)^(?:Summe|Gesamt|Insgesamt)$", "(?iu)^(?:Gesamt|Summe|Insgesamt|Total)$"
UNIT_GROUP = "(?iu)^(?:in\\s+)?(?:T?EUR|€|T\\s?€|Tsd\\.?\\s?(?:EUR|€)|Mio\\.?\\s?(?:EUR|€)|%)$|^(?:\\d{1,2}\\.\\s?\\d{1,2}\\.\\s?)?\\d{4}$"
#: Formulas: item, how it comes from its two operands, first and second operand. Fixed values.
FORMULAS = (
    ("fremdkapital", "difference", "bilanzsumme", "eigenkapital"),
    ("eigenkapitalquote", "share", "eigenkapital", "bilanzsumme"),
    ("fremdkapitalquote", "share", "fremdkapital", "bilanzsumme"),
    ("nettozinsertrag", "magnitudes", "zinsertraege", "zinsaufwendungen"),
    ("provisionsergebnis", "magnitudes", "provisionsertraege", "provisionsaufwendungen"),
)
#: A share of two rounded amounts is exact to its last place.
SHARE_UNIT, WHOLE = 10_000, "bilanzsumme"
# Fixed values end here.
#: Partitions for each of the session's, so that each is sorted in memory.
SPREAD = 4

_COLUMNS = "doc_id", "table_no", "column_no"


def _counting(rows: DataFrame) -> DataFrame:
    """``rows`` without the columns that do not show an item: parts of a breakdown such as regions, all but its total.

    A table is broken down if two columns of one period belong to different groups that are
    more than a unit or a date; without a total group none of its columns counts. ``_group``
    stands in rows of ``groups``, ``_figure`` is true in those of figures.
    """
    column, period, table = Window.partitionBy(*_COLUMNS), Window.partitionBy(*TABLE, "_period"), Window.partitionBy(*TABLE)
    rows = rows.withColumns({"_period": F.min("column_period").over(column), "_other": F.bool_or(F.col("change") | F.col("percent")).over(column), "_some": F.bool_or("_figure").over(column), "_group": F.max("_group").over(column)})
    group = F.coalesce(F.col("_group"), F.lit(""))
    part = F.when((group != "") & ~group.rlike(UNIT_GROUP) & F.col("_period").isNotNull() & ~F.col("_other"), group)
    rows = rows.withColumn("_part", part).withColumn("_several", F.min("_part").over(period) != F.max("_part").over(period))
    total = F.min(F.when(F.col("_some") & group.rlike(TOTAL_GROUP), F.struct("column_no", group.alias("g")))).over(table)
    rows = rows.withColumns({"_broken": F.coalesce(F.bool_or("_several").over(table), F.lit(False)), "_total": total["g"]})
    return rows.where(~F.col("_broken") | ~F.coalesce(F.col("_figure"), F.lit(False)) | group.eqNullSafe(F.col("_total"))).drop("_period", "_other", "_some", "_part", "_several", "_broken", "_total")


def build(figures: DataFrame, captions: DataFrame | None = None, groups: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Amounts and per cents of tables with the item that they show.

    ``captions`` (doc_id, table_no, caption), ``groups`` (doc_id, table_no, column_no, group):
    one row a table or column. ``sums``: what ``tables.staircase_sums`` or ``list_sums`` found
    (PLACE, status, parts, label, relabelled); a sum that matches confirms its total, with as
    many terms as it has parts, and a total that it names is known by that name.

    Columns: PLACE, key (the item, else ``label:`` and the label in lower case), item, item_kind,
    label, via_caption (a sum row that shows the item of its table's caption), relabelled,
    confirmed, terms, alternate, level, period, figure_period, micro, display_unit, unit.

    All four tables go together as rows of one, dealt by document once, and find each other by
    windows; the result stays dealt so. Only labels and captions are joined
    to the catalogue's table of wordings, which is written before, so that its size is known.
    ``figures`` and ``sums`` are read for their labels, too.
    """
    fact = F.expr("micro IS NOT NULL AND NOT coalesce(issue, false) AND amount AND NOT change AND NOT davon AND unit IN ('EUR', 'percent') AND coalesce(period, column_period) IN ('current', 'prior')")
    keep = fact if groups is None else fact | F.col("column_no").isNotNull()
    rows = figures.where(keep).select(*PLACE, "label", "alternate", "level", F.coalesce("period", "column_period").alias("period"), F.col("period").alias("figure_period"), "column_period", "change", "percent", "micro", "display_unit", "unit", F.coalesce(fact, F.lit(False)).alias("_fact"), F.lit(True).alias("_figure"))
    labels = rows.where("_fact").select("label")
    if groups is not None:
        rows = rows.unionByName(groups.dropna(subset=list(_COLUMNS)).select(*_COLUMNS, F.trim("group").alias("_group")), allowMissingColumns=True)
    if sums is not None:
        terms = F.greatest(F.lit(1), F.length(F.regexp_replace("parts", "[^+-]", "")))
        rows = rows.unionByName(sums.dropna(subset=list(PLACE)).select(*PLACE, F.when(F.col("status") == "match", terms).alias("_terms"), F.when(F.col("relabelled"), F.col("label")).alias("_label"), F.col("relabelled").alias("_re")), allowMissingColumns=True)
        labels = labels.unionByName(sums.where("relabelled").select("label"))
    if captions is not None:
        about = settled(captions.select("caption").distinct().withColumn("_caption", item_of_caption(F.col("caption"))).where("_caption IS NOT NULL"))
        rows = rows.unionByName(captions.dropna(subset=list(TABLE)).join(about, "caption", "left").select(*TABLE, "_caption"), allowMissingColumns=True)
    none = {"_group": "string", "_terms": "int", "_label": "string", "_re": "boolean", "_caption": "string"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in rows.columns})
    rows = rows.repartition(SPREAD * int(figures.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    if groups is not None:
        rows = _counting(rows)
    if captions is not None:
        rows = rows.withColumn("_caption", F.max("_caption").over(Window.partitionBy(*TABLE)))
    rows = rows.where("_fact OR _re IS NOT NULL OR _terms IS NOT NULL")
    if sums is not None:
        place = Window.partitionBy(*PLACE)
        rows = rows.withColumns({"_terms": F.max("_terms").over(place), "_label": F.max("_label").over(place), "_re": F.bool_or("_re").over(place)})
    rows = rows.where("_fact").withColumns({"label": F.when(F.col("_re"), F.col("_label")).otherwise(F.col("label")), "relabelled": F.coalesce("_re", F.lit(False)), "confirmed": F.col("_terms").isNotNull(), "terms": F.coalesce("_terms", F.lit(1))})
    kinds = settled(labels.distinct().withColumn("_item", item_of_label(F.col("label"))))  # the catalogue looks at each wording once, of captions too
    total = F.coalesce(F.col("label").rlike(SUM_ROW), F.lit(False))
    item = F.when(total, F.col("_caption")).otherwise(F.col("_item"))
    return rows.join(kinds, "label", "left").select(
        *PLACE, F.coalesce(item, F.concat(F.lit("label:"), F.lower(F.coalesce("label", F.lit(""))))).alias("key"), item.alias("item"), kind_of_item(item).alias("item_kind"), "label", (total & F.col("_caption").isNotNull()).alias("via_caption"),
        "relabelled", "confirmed", "terms", "alternate", "level", "period", "figure_period", "micro", "display_unit", "unit",
    )


def _size(micro: str | Column, kind: str = "item_kind") -> Column:
    """Expenses count by magnitude: some tables show them with a minus, some without."""
    c = F.col(micro) if isinstance(micro, str) else micro
    return F.when(F.col(kind) == "expense", F.abs(c)).otherwise(c)


def resolved(facts: DataFrame) -> DataFrame:
    """One value for each key and period of a document, in amounts of money.

    Tables of the usual structure go before alternate ones, labels before captions, then labels
    as they stand, the finer unit, confirmed sums, the first place. ``consistent``: all facts of
    the same rank (structure and caption) agree with the value within the coarser unit.

    Facts are first merged by rank and unit to their best, lowest and highest: what a key's
    merge then takes together is a handful of rows, however many facts it has.
    """
    order = F.struct("relabelled", "display_unit", (~F.col("confirmed")).alias("unsure"), "table_no", "row_no", "column_no")
    rank = ("alternate", "via_caption", "display_unit")
    best = F.struct(*PLACE[1:], "label", "relabelled", "confirmed", "micro", "display_unit")
    classes = facts.where("unit = 'EUR'").groupBy(*VALUE, "item_kind", *rank).agg(F.min(order).alias("o"), F.min_by(best, order).alias("b"), F.min(_size("micro")).alias("lo"), F.max(_size("micro")).alias("hi"), F.count("*").alias("n"))
    one = F.struct("alternate", "via_caption", "o")
    ranges = F.collect_list(F.struct("alternate", "via_caption", "display_unit", "lo", "hi", "n"))
    got = classes.groupBy(*VALUE, "item_kind").agg(F.min_by(F.struct("b", "alternate", "via_caption"), one).alias("x"), ranges.alias("r"))
    same = F.filter("r", lambda c: (c["alternate"] == F.col("x.alternate")) & (c["via_caption"] == F.col("x.via_caption")))
    value, unit = _size(F.col("x.b.micro")), F.col("x.b.display_unit")
    fits = F.forall(same, lambda c: F.greatest(whole(c["hi"] - value), whole(value - c["lo"])) <= F.greatest(c["display_unit"], unit))
    return got.select(
        *VALUE, "item_kind", "x.b.*", F.col("x.alternate").alias("alternate_only"), F.col("x.via_caption").alias("via_caption"), fits.alias("consistent"), F.aggregate(same, F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("candidates")
    )


def formula_order(formulas=FORMULAS) -> list[tuple]:
    """The formulas such that each follows those that give its operands; ``ValueError`` for a circle."""
    named = {f[0]: f for f in formulas}
    return [named[k] for k in TopologicalSorter({k: [x for x in f[2:] if x in named] for k, f in named.items()}).static_order()]


def _computed(how: str, a: Column, b: Column) -> Column:
    """Struct of micro and display_unit from two operands of that kind; null without one of them, or for a share of nothing."""
    coarser = F.greatest(a["display_unit"], b["display_unit"])
    if how == "share":
        ratio = ratio_percent(a["micro"], b["micro"])
        return F.when(ratio.isNotNull(), F.struct(ratio.alias("micro"), whole(F.lit(SHARE_UNIT)).alias("display_unit")))
    difference = whole(a["micro"] - b["micro"]) if how == "difference" else whole(F.abs(a["micro"]) - F.abs(b["micro"]))
    return F.when(difference.isNotNull(), F.struct(difference.alias("micro"), coarser.alias("display_unit")))


def evaluated(values: DataFrame, formulas=FORMULAS) -> DataFrame:
    """What the formulas give for each document and period: doc_id, period, key, micro, display_unit, from_tables, round.

    An operand is its value in the tables, else what its own formula gives; values of alternate
    tables only are no operands. The graph of formulas becomes columns, each after its operands:
    one shuffle for formulas over formulas of any depth. ``from_tables``: the tables have a
    value of their own, which counts before the formula's; ``round``: the formula's depth.
    """
    order = formula_order(formulas)
    operands = sorted({x for f in order for x in f[2:]} | {f[0] for f in order})
    at = lambda k, test: F.max(F.when((F.col("key") == k) & test, F.struct("micro", "display_unit")))
    wide = values.where(F.col("key").isin(operands)).groupBy("doc_id", "period").agg(
        *(at(k, ~F.col("alternate_only")).alias(f"v_{k}") for k in operands), *(F.bool_or(F.col("key") == f[0]).alias(f"has_{f[0]}") for f in order)
    )
    depth: dict[str, int] = {}
    for key, how, a, b in order:
        depth[key] = 1 + max(depth.get(a, 0), depth.get(b, 0))
        wide = wide.withColumn(f"f_{key}", _computed(how, F.col(f"v_{a}"), F.col(f"v_{b}")))
        wide = wide.withColumn(f"v_{key}", F.when(F.col(f"has_{key}"), F.col(f"v_{key}")).otherwise(F.col(f"f_{key}")))
    made = F.array(*(F.struct(F.lit(f[0]).alias("key"), F.col(f"f_{f[0]}.micro").alias("micro"), F.col(f"f_{f[0]}.display_unit").alias("display_unit"), F.col(f"has_{f[0]}").alias("from_tables"), F.lit(depth[f[0]]).alias("round")) for f in order))
    return wide.select("doc_id", "period", F.explode(made).alias("x")).select("doc_id", "period", "x.*").where("micro IS NOT NULL")


def shares(values: DataFrame, formulas=FORMULAS) -> DataFrame:
    """Every item's share in the balance sheet total: doc_id, period, key (``share:`` and the item), micro (micro per cent), display_unit."""
    whole_amount = F.max(F.when((F.col("key") == WHOLE) & ~F.col("alternate_only"), F.col("micro"))).over(Window.partitionBy("doc_id", "period"))
    values = values.withColumn("_total", whole_amount).where("item_kind IS NOT NULL AND _total IS NOT NULL")
    values = settled(values.select("doc_id", "period", "key", "micro", "display_unit", "alternate_only", "_total"))
    total = values.where((F.col("key") == WHOLE) & ~F.col("alternate_only")).select("doc_id", "period", "_total")
    tables = values.where("NOT alternate_only").select("doc_id", "period", "key", "micro", "_total")
    made = evaluated(values, [f for f in formulas if f[1] != "share"]).where("NOT from_tables").select("doc_id", "period", "key", "micro")
    ratio = ratio_percent(F.col("micro"), F.col("_total"))
    return tables.unionByName(made.join(total, ["doc_id", "period"])).select("doc_id", "period", F.concat(F.lit("share:"), "key").alias("key"), ratio.alias("micro"), whole(F.lit(SHARE_UNIT)).alias("display_unit")).where("micro IS NOT NULL")


def derived_rows(facts: DataFrame, formulas=FORMULAS) -> DataFrame:
    """Rows of items that a formula gives against the formula: PLACE, check, status, actual, expected, tolerance, rounded."""
    money = [f[0] for f in formulas if f[1] != "share"]
    operands = {x for f in formulas for x in (f[0], *f[2:])}
    facts = settled(facts.where(F.col("key").isin(sorted(operands)) & (F.col("unit") == "EUR")))
    made = evaluated(resolved(facts), formulas).where(F.col("key").isin(money)).select("doc_id", "period", "key", F.col("micro").alias("_expected"), F.col("display_unit").alias("_unit"))
    both = facts.where(F.col("key").isin(money)).join(made, list(VALUE)).withColumn("_c", compared(F.col("micro"), F.col("display_unit"), F.col("_expected"), F.col("_unit"), 2))
    return both.select(*PLACE, F.lit("derived").alias("check"), F.col("_c.status").alias("status"), F.col("micro").alias("actual"), F.col("_expected").alias("expected"), F.col("_c.tolerance").alias("tolerance"), F.col("_c.rounded").alias("rounded"))


def _extents(figures: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, until) of rows with a level: the next row that is no part of it, null if none is.

    The parts of a row are the rows below it of a deeper level, up to the first that has none
    or one as high. For each level the next such row is one window over the rows; levels are five.
    """
    rows = figures.groupBy(*TABLE, "row_no").agg(F.first("level").alias("level"))
    after = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(1, Window.unboundedFollowing)
    ends = F.create_map(*(x for n in range(1, 6) for x in (F.lit(n), F.min(F.when(F.coalesce(F.col("level") <= n, F.lit(True)), F.col("row_no"))).over(after))))
    return rows.withColumn("_ends", ends).where("level IS NOT NULL").select(*TABLE, "row_no", F.col("_ends")[F.col("level")].alias("until"))


def _shown_by_part(pairs: DataFrame, figures: DataFrame) -> DataFrame:
    """``pairs`` whose part equals a figure below its whole: (_id and the part's figure_period, micro and unit, the whole's place) as ``_id``.

    A caption's sum that shows only a part of the row with the caption's name differs from it for
    a reason. Parts of the same amount are looked for once.
    """
    asked = ("doc_id", "whole_table", "whole_row", "part_period", "part_micro", "part_unit")
    want = pairs.select(*asked).distinct()
    until = _extents(figures).select("doc_id", F.col("table_no").alias("whole_table"), F.col("row_no").alias("whole_row"), "until")
    below = figures.where("micro IS NOT NULL").select("doc_id", F.col("table_no").alias("whole_table"), "row_no", F.col("period").alias("part_period"), F.col("micro").alias("_m"), F.col("display_unit").alias("_u"))
    near = F.abs(whole(F.col("_m") - F.col("part_micro"))) <= F.greatest("_u", "part_unit")
    w, b = want.join(until, ["doc_id", "whole_table", "whole_row"]).alias("w"), below.alias("b")
    on = (F.col("w.doc_id") == F.col("b.doc_id")) & (F.col("w.whole_table") == F.col("b.whole_table")) & F.col("w.part_period").eqNullSafe(F.col("b.part_period")) & (F.col("b.row_no") > F.col("w.whole_row")) & F.coalesce(F.col("b.row_no") < F.col("w.until"), F.lit(True)) & near
    found = w.join(b, on, "left_semi").select(*asked)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in asked]
    return pairs.alias("p").join(found.alias("f"), same, "left_semi").select("p._id")


def references(facts: DataFrame, figures: DataFrame) -> DataFrame:
    """Every fact of an item against the item's best fact in another table.

    The reference is the first by usual structure, label as it stands, confirmed sum, finer unit,
    place. Facts of its own table are not compared. The tolerance is the coarser unit for each
    term of the longer confirmed sum; expenses count by magnitude.

    ``code``: reference_matches, reference_sign (only the sign differs), reference_differs;
    reference_structure (uncertain: one side is of an alternate structure; told for results only),
    reference_candidates (uncertain: a label is inferred). A sum under a caption that equals a
    row below the item in the other table shows that part only and makes no check.

    Columns: PLACE, check (prior_year or cross_reference), status, code, actual, expected,
    tolerance, rounded, ref_table, ref_row, ref_column.
    """
    group = ["doc_id", "item", "period"]
    f = facts.where("item IS NOT NULL AND unit = 'EUR'")
    order = F.struct("alternate", "relabelled", (~F.col("confirmed")).alias("unsure"), "display_unit", "table_no", "row_no", "column_no")
    kept = ("table_no", "row_no", "column_no", "micro", "display_unit", "terms", "alternate", "relabelled", "via_caption", "figure_period")
    best = F.min_by(F.struct(*kept), order).over(Window.partitionBy(*group))
    left, right = _size("micro"), _size(F.col("r.micro"))
    both = f.withColumn("r", best).where("table_no <> r.table_no").withColumn("_c", compared(left, F.col("display_unit"), right, F.col("r.display_unit"), F.greatest("terms", "r.terms")))
    match = F.col("_c.status") == "match"
    sign = (F.col("item_kind") != "expense") & (compared(F.abs("micro"), F.col("display_unit"), F.abs("r.micro"), F.col("r.display_unit"))["status"] == "match")
    other, inferred = F.col("alternate") | F.col("r.alternate"), F.col("relabelled") | F.col("r.relabelled")
    both = both.where(match | ~other | (F.col("item_kind") == "result")).withColumn(
        "code", F.when(match, "reference_matches").when(other, "reference_structure").when(inferred, "reference_candidates").when(sign, "reference_sign").otherwise("reference_differs")
    )
    both = settled(both.withColumn("_id", F.struct(*PLACE)))
    of = lambda c: F.when(F.col("via_caption"), F.struct(F.col("r.table_no").alias("t"), F.col("r.row_no").alias("n"), F.col("figure_period").alias("p"), F.col("micro").alias("m"), F.col("display_unit").alias("u"))).otherwise(
        F.struct(F.col("table_no").alias("t"), F.col("row_no").alias("n"), F.col("r.figure_period").alias("p"), F.col("r.micro").alias("m"), F.col("r.display_unit").alias("u")))[c]
    pairs = both.where((F.col("code") != "reference_matches") & (F.col("via_caption") | F.col("r.via_caption"))).select(
        "_id", "doc_id", of("t").alias("whole_table"), of("n").alias("whole_row"), of("p").alias("part_period"), of("m").alias("part_micro"), of("u").alias("part_unit")
    )
    told = both.join(_shown_by_part(pairs, figures), "_id", "left_anti")
    status = F.when(F.col("code").isin("reference_structure", "reference_candidates"), "uncertain").otherwise(F.col("_c.status"))
    check = F.when(F.col("period") == "prior", "prior_year").otherwise("cross_reference")
    return told.select(
        *PLACE, check.alias("check"), status.alias("status"), "code", F.col("micro").alias("actual"), F.col("r.micro").alias("expected"), F.col("_c.tolerance").alias("tolerance"), F.col("_c.rounded").alias("rounded"),
        F.col("r.table_no").alias("ref_table"), F.col("r.row_no").alias("ref_row"), F.col("r.column_no").alias("ref_column"),
    )
