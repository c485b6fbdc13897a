"""Documents to blocks: HTML to typed blocks with table places, heading paths, lines and blocks of positioned text."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags that end a block, entities by name, the shapes of a tag, an entity and a numbered heading.
BOUNDARIES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol table thead tbody tr td th blockquote div".split())
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
TAG = regex.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""")
ENTITY = regex.compile(r"(?i)&(#x[0-9a-f]+|#\d+|[a-z]+);")
NUMBERED = regex.compile(r"(\d{1,2}(?:\.\d{1,2}){0,4})\.?\s+\p{Lu}")


def _character(m) -> str:
    name = m[1]
    if name[0] != "#":
        return ENTITIES.get(name.lower(), m[0])
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]


def heading_level(text: str) -> int | None:
    """Depth of a numbered heading such as ``2.1 Scope``; long lines and sentences are none."""
    m = None if len(text) > 120 or text[-1:] in ".:;," else NUMBERED.match(text)
    return m and m[1].count(".") + 1


@dataclass
class _Table:
    number: int
    row: int = -1
    column: int = -1
    head: bool = False
    skip: int = 0  # columns that the last cell covered besides its own


@dataclass
class _Page:
    """What is open while a page's tags go by."""

    rows: list[tuple] = field(default_factory=list)
    open: list[tuple[str, bool]] = field(default_factory=list)
    tables: list[_Table] = field(default_factory=list)
    count: int = 0
    text: list[str] = field(default_factory=list)

    def close_block(self):
        raw = "".join(self.text)
        self.text.clear()
        text = " ".join(regex.sub(r"[\s\ufeff]+", " ", ENTITY.sub(_character, raw)).split(" ")).strip(" ") if raw else ""
        if not text:
            return
        within = next(((t, title) for t, title in reversed(self.open) if t in ("li", "td", "th") or t[0] == "h" and t[1:].isdigit()), None)
        number = heading_level(text)
        place = (None, None, None, None)
        if within is None:
            kind, level = ("paragraph", None) if number is None else ("heading", number)
        elif within[0] == "li":
            kind, level = "list_item", None
        elif within[0][1:].isdigit():
            kind, level = "heading", 0 if within[1] else number or int(within[0][1:])
        else:
            kind, level = "table_cell", None
            if self.tables:
                t = self.tables[-1]
                place = t.number, t.row, t.column, t.head or within[0] == "th"
        self.rows.append((len(self.rows) + 1, kind, text, level, *place))

    def begin(self, tag: str, attributes: str):
        self.open.append((tag, bool(regex.search(r'class\s*=\s*"[^"]*\btitle\b', attributes))))
        t = self.tables[-1] if self.tables else None
        if tag == "table":
            self.tables.append(_Table(self.count))
            self.count += 1
        elif t and tag == "thead":
            t.head = True
        elif t and tag == "tr":
            t.row, t.column, t.skip = t.row + 1, -1, 0
        elif t and tag in ("td", "th"):
            t.column += 1 + t.skip
            span = regex.search(r'colspan\s*=\s*"?(\d+)', attributes)
            t.skip = max(0, int(span[1]) - 1) if span else 0

    def end(self, tag: str):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is not None:
            del self.open[at:]
        if tag == "table" and self.tables:
            self.tables.pop()
        elif tag == "thead" and self.tables:
            self.tables[-1].head = False


def page_blocks(html: str) -> list[tuple]:
    """(ordinal, kind, text, level, table, row, column, header) of one page; text of scripts and styles is text."""
    page, at = _Page(), 0
    for m in TAG.finditer(html):
        page.text.append(html[at : m.start()])
        at = m.end()
        tag = m[2].lower()
        if tag == "br":
            page.text.append(" ")
        elif tag in BOUNDARIES:
            page.close_block()
            page.end(tag) if m[1] else page.begin(tag, m[3])
    page.text.append(html[at:])
    page.close_block()
    return page.rows


_BLOCKS = pa.schema(
    [("doc_id", pa.int64()), ("ordinal", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("table_no", pa.int32()), ("row_no", pa.int32()), ("column_no", pa.int32()), ("header", pa.bool_())]
)
BLOCKS = "doc_id long, ordinal long, kind string, text string, level int, table_no int, row_no int, column_no int, header boolean"


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Typed blocks of HTML pages."""

    def run(batches):
        for b in batches:
            rows = [(d, *r) for d, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in page_blocks(h or "")]
            columns = list(zip(*rows)) or [[] for _ in _BLOCKS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS)], schema=_BLOCKS)

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, BLOCKS)


def outlined(blocks: DataFrame, deepest: int = 9) -> DataFrame:
    """Blocks with ``heading_path``: the open headings above each, as an array.

    A heading of level l stays open until the next heading of level l or less. For each
    level the last heading is carried forward with its place; it counts if no shallower
    heading came after it.
    """
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce("level", F.lit(1))
    is_at = lambda k: (F.col("kind") == "heading") & (level == k)
    last = {k: F.last(F.when(is_at(k), F.struct("ordinal", "text")), ignorenulls=True).over(w) for k in range(deepest + 1)}
    out = blocks.withColumns({f"_h{k}": c for k, c in last.items()})

    def open_at(k: int) -> Column:
        own = F.col(f"_h{k}")
        shallower = [F.col(f"_h{j}.ordinal") for j in range(k)]
        newest = F.greatest(F.lit(-1), F.lit(-1), *shallower) if shallower else F.lit(-1)
        above = (F.col("kind") != "heading") | (level > k)
        return F.when(own.isNotNull() & (own["ordinal"] > newest) & above, own["text"])

    path = F.filter(F.array(*(open_at(k) for k in range(deepest + 1))), lambda x: x.isNotNull())
    return out.withColumn("heading_path", path).drop(*(f"_h{k}" for k in range(deepest + 1)))


def page_lines(items: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line, text, y, height) of positioned text (doc_id, page, pos, text, x, y, width, height, end_of_line).

    Items follow each other on a line while their baselines differ by less than half a
    height and no line end stands between; only a real gap becomes a space.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("pos")
    prev = lambda c: F.lag(c).over(w)
    new = prev("pos").isNull() | prev("end_of_line") | (F.abs(F.col("y") - prev("y")) >= F.greatest(F.col("height"), prev("height"), F.lit(1.0)) / 2)
    gap = F.col("x") - (prev("x") + prev("width")) > F.greatest(F.col("height"), F.lit(1.0)) * 0.1
    numbered = items.withColumn("_new", new.cast("int")).withColumn("_gap", gap).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.struct("pos", F.concat(F.when((F.col("_new") == 0) & F.col("_gap"), " ").otherwise(""), F.col("text")).alias("t"), "y", "height")
    lines = numbered.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["t"]), ""), "\\s+", " "))
    return lines.select("doc_id", "page", "line", text.alias("text"), F.col("p")[0]["y"].alias("y"), F.array_max(F.transform("p", lambda x: x["height"])).alias("height")).where("text <> ''")


def line_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of lines: a gap over one and a half heights, a list mark or a larger font begins a new one; large lines are headings."""
    from .readmodels import upper_median

    usual = upper_median("height").over(Window.partitionBy("doc_id"))
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    large = F.col("height") >= 1.2 * F.col("usual")
    own = lines.select("doc_id", "page", "line", "text", "y", "height").where("doc_id IS NOT NULL").withColumn("usual", usual).withColumn("large", large).withColumn("mark", F.col("text").rlike("^(?:[-–•▪]|\\d{1,2}[.)]|[a-z]\\))\\s"))
    prev = lambda c: F.lag(c).over(w)
    new = prev("page").isNull() | (prev("page") != F.col("page")) | F.col("mark") | (prev("large") != F.col("large")) | (prev("y") - F.col("y") > 1.5 * F.greatest(F.col("height"), F.lit(1.0)))
    numbered = own.withColumn("_new", new.cast("int")).withColumn("ordinal", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lists = numbered.groupBy("doc_id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("p"), F.bool_and("large").alias("large"), F.first("mark").alias("mark"))
    kind = F.when(F.col("large"), "heading").when(F.col("mark"), "list_item").otherwise("paragraph")
    return lists.select("doc_id", "ordinal", F.col("p")[0]["page"].alias("page"), kind.alias("kind"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))
