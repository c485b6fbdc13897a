"""Document context: page marks, appendices, tables of contents, table columns, line layout of pages."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

LEAST_ENTRIES = 4
#: Shapes of a contents entry, its title, a page label and an amount word. Fixed values.
ENTRY, TITLE = "\\p{L}.*?[\\s.…]+(\\d{1,3})$", "(?iu)^(?:inhaltsverzeichnis|inhalt|gliederung|contents|table of contents)$"
LABEL, AMOUNT = "(?iu)^(?:seite|page)n?$", "(?:EUR|€|%)"
PAGE, APPENDIX = "^PDF-Seite (\\d+)$", "(?u)^(?:Anlage|Beilage)\\b"
NUMBER = "^[-–(]?\\d[\\d.,]*\\)?%?$"

_number = re.compile(NUMBER)


def context(blocks: DataFrame) -> DataFrame:
    """Blocks with ``page``, ``section_mark`` (the last heading, reset by an appendix) and ``heading``: filled forward in order."""
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    page = F.last(F.nullif(F.regexp_extract("text", PAGE, 1), F.lit("")).cast("int"), ignorenulls=True).over(w)
    mark = F.when(F.col("text").rlike(APPENDIX), "").when(F.col("kind") == "heading", F.col("text"))
    heading = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w)
    return blocks.withColumn("page", page).withColumn("section_mark", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit(""))).withColumn("heading", heading)


def _pages(text: Column) -> Column:
    """Page numbers of a block whose every line is a contents entry, else null."""
    lines = F.filter(F.transform(F.split(text, "\n+"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(LABEL))
    numbers = F.transform(lines, lambda x: F.when(x.rlike(ENTRY) & ~x.rlike(AMOUNT), F.regexp_extract(x, ENTRY, 1).try_cast("int")))
    return F.when((F.size(lines) > 0) & F.forall(numbers, lambda n: n.isNotNull()), numbers)


def _ascending(c: Column) -> Column:
    return F.aggregate(c, F.struct(F.lit(0).alias("last"), F.lit(True).alias("up")), lambda a, n: F.struct(n.alias("last"), (a["up"] & (n >= a["last"])).alias("up")), lambda a: a["up"])


def contents_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, ordinal) of blocks that belong to a table of contents.

    That is a title with the ascending entries that follow it, or ``LEAST_ENTRIES`` ascending
    entries in a row, or in one block. Page labels and page marks between them do not part them.
    """
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    own = blocks.where((F.trim("text") != "") & ~F.col("text").rlike(PAGE)).select("doc_id", "ordinal", F.trim("text").alias("t"))
    named = own.withColumn("title", F.col("t").rlike(TITLE)).withColumn("label", F.col("t").rlike(LABEL)).withColumn("pages", _pages(F.col("t")))
    kept = named.where("NOT label").withColumn("first", F.col("pages")[0]).withColumn("last", F.element_at("pages", -1)).withColumn("up", F.coalesce(_ascending(F.col("pages")), F.lit(False)))
    part = F.col("title") | F.col("pages").isNull() | ~F.col("up") | F.lag("pages").over(w).isNull() & ~F.coalesce(F.lag("title").over(w), F.lit(False)) | F.coalesce(F.col("first") < F.lag("last").over(w), F.lit(False))
    runs = kept.withColumn("run", F.sum(part.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = Window.partitionBy("doc_id", "run")
    sized = runs.withColumn("has_title", F.bool_or("title").over(per)).withColumn("n", F.sum(F.coalesce(F.size("pages"), F.lit(0))).over(per)).withColumn("entries", F.count_if(F.col("pages").isNotNull()).over(per))
    inside = F.col("title") | F.col("pages").isNotNull() & (F.col("has_title") & F.col("up") | (F.col("n") >= LEAST_ENTRIES) & F.col("up"))
    return sized.where(inside).select("doc_id", "ordinal")


def table_columns(cells: DataFrame) -> DataFrame:
    """(doc_id, table_no, column_no, unit, scale, year): what a table's header cells say of a column; its right neighbour's word holds where it says nothing.

    ``cells``: doc_id, table_no, row_no, column_no, header, text.
    """
    head = cells.where("header").groupBy("doc_id", "table_no", "column_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda x: x["text"]), " ").alias("h"))
    every = cells.select("doc_id", "table_no", "column_no").distinct().join(head, ["doc_id", "table_no", "column_no"], "left")
    unit = F.when(F.col("h").rlike("%|Prozent"), "percent").when(F.col("h").rlike("TEUR|T€|Tsd|Mio|EUR|€"), "EUR")
    scale = F.when(F.col("h").rlike("TEUR|T€|Tsd"), 1_000).when(F.col("h").rlike("Mio"), 1_000_000).when(F.col("h").rlike("EUR|€"), 1)
    year = F.nullif(F.regexp_extract("h", "((?:19|20)\\d{2})", 1), F.lit("")).cast("int")
    w = Window.partitionBy("doc_id", "table_no").orderBy("column_no")
    right = w.rowsBetween(0, 1)
    own = every.withColumn("unit", unit).withColumn("scale", scale).withColumn("year", year)
    filled = own.withColumn("year", F.coalesce("year", F.last("year", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    return filled.select("doc_id", "table_no", "column_no", F.coalesce("unit", F.first("unit", ignorenulls=True).over(right)).alias("unit"), F.coalesce("scale", F.first("scale", ignorenulls=True).over(right)).alias("scale"), "year")


def margins(lines: DataFrame, edge: int = 2) -> DataFrame:
    """(doc_id, text) of lines that repeat at the top or bottom of pages: numbers masked, on a quarter of the pages and three at least."""
    place, document = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id")
    in_order = place.orderBy("line")
    # one order of a document's lines tells both edges, its pages (each by its first line) and keys that a page repeats
    at = lines.where("doc_id IS NOT NULL").select("doc_id", "page", "line", "text").withColumn("_up", F.row_number().over(in_order)).withColumn("_down", F.count("*").over(place) - F.col("_up") + 1)
    at = at.withColumn("_pages", F.count_if((F.col("_up") == 1) & F.col("page").isNotNull()).over(document))
    key = F.regexp_replace(collapse(F.col("text")), "\\d+", "#")
    outer = at.where((F.col("_up") <= edge) | (F.col("_down") <= edge)).select("doc_id", "page", "line", "_pages", key.alias("text"))
    again = F.array_contains(F.collect_list("text").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.col("text"))
    fresh = outer.withColumn("_new", F.col("page").isNotNull() & ~F.coalesce(again, F.lit(False)))
    found = fresh.groupBy("doc_id", "text").agg(F.count_if("_new").alias("n"), F.max("_pages").alias("pages"))
    return found.where(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.25))).select("doc_id", "text")


CELLS = "doc_id long, page int, table_no int, row_no int, column_no int, text string"


def _page_cells(page: tuple, items: list[tuple], gap: float) -> list[tuple]:
    """Cells of one page's items (text, x, y, width, height), which come from the top down, then from the left."""
    rows: list[tuple] = []
    lines: list[list[tuple]] = []
    for text, x, y, width, height in items:
        piece = text.strip(), x + width, _number.match(text.strip()) is not None
        if lines and abs(top - y) < max(height, 1.0) / 2:
            lines[-1].append(piece)
        else:
            lines.append([piece])
            top = y
    table, group, waiting = 0, [], None
    for line in [*lines, None]:
        if line is not None and any(n for _, _, n in line):
            group.append((waiting, line))
            waiting = None
            continue
        if len(group) >= 2:
            edges: list[list[float]] = []
            for e in sorted(right for _, cells in group for _, right, n in cells if n):
                if edges and e - edges[-1][-1] <= gap:
                    edges[-1].append(e)
                else:
                    edges.append([e])
            for r, (above, cells) in enumerate(group):
                rows.append((*page, table, r, 0, " ".join([t for t, _, _ in above or ()] + [t for t, _, n in cells if not n])))
                rows += [(*page, table, r, next(k for k, e in enumerate(edges, 1) if e[0] <= right <= e[-1]), t) for t, right, n in cells if n]
            table += 1
        group, waiting = [], line
    return rows


def page_tables(items: DataFrame, gap: float = 12.0) -> DataFrame:
    """Cells (doc_id, page, table_no, row_no, column_no, text) of positioned text that stands in columns.

    One page at a time: items of one baseline are a line; lines with two or more numbers in
    a row are a table; number columns are clusters of right edges; what stands left of the
    first is the label, joined with a label line directly above that has no numbers. Items
    without a text take no part; those at one place come in the order of their texts.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("table_no", pa.int32()), ("row_no", pa.int32()), ("column_no", pa.int32()), ("text", pa.string())])

    def run(batches):
        """A pass over sorted items, which holds one page."""
        page, held, rows = None, [], []

        def taken(least: int):
            while len(rows) > least:
                part = rows[:5_000]
                del rows[:5_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

        for b in batches:
            for doc_id, at, *item in zip(*(c.to_pylist() for c in b.columns)):
                if (doc_id, at) != page:
                    if held:
                        rows += _page_cells(page, held, gap)
                    page, held = (doc_id, at), []
                held.append(item)
            yield from taken(5_000)
        if held:
            rows += _page_cells(page, held, gap)
        yield from taken(0)

    nan = F.lit(float("nan"))
    named = items.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "text", *(F.coalesce(F.col(c).cast("double"), nan).alias(c) for c in ("x", "y", "width", "height")))
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small pages stay spread: the work is Python's, not the bytes'
    # places that are no numbers come last
    return named.repartition(parts, "doc_id", "page").sortWithinPartitions("doc_id", "page", F.isnan("y"), F.desc("y"), "x", "text").mapInArrow(run, CELLS)
