"""Spans of blocks as rows: amounts, dates, years, direction words. Offsets count code points."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as sp

FIGURES = "doc_id long, ordinal long, start int, `end` int, raw string, micro decimal(38,0), display_unit decimal(38,0), unit string, scale int, decimals int, period string, parenthesized boolean, issue string"


def figures(blocks: DataFrame) -> DataFrame:
    """All figures of blocks (doc_id, ordinal, kind, text, report_year, column_unit, column_scale, column_period); the last four may be missing."""
    own = _filled(blocks, {"kind": "string", "report_year": "int", "column_unit": "string", "column_scale": "int", "column_period": "string"})

    def run(batches):
        for b in batches:
            rows = []
            for did, n, text, kind, year, unit, scale, period in zip(*(c.to_pylist() for c in b.columns)):
                for f in sp.figures(text or "", kind or "paragraph", year, (unit, scale or 1) if unit else None, period):
                    rows.append((did, n, f.start, f.end, f.raw, None if f.micro is None else Decimal(f.micro), Decimal(f.display_unit), f.unit, f.scale, f.decimals, f.period, f.parenthesized, f.issue))
            yield _batch(rows, _FIGURES)

    return own.select("doc_id", "ordinal", "text", "kind", "report_year", "column_unit", "column_scale", "column_period").mapInArrow(run, FIGURES)


def _filled(blocks: DataFrame, kinds: dict[str, str]) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in blocks.columns}
    return blocks.withColumns(missing).withColumns({"doc_id": F.col("doc_id").cast("long"), "ordinal": F.col("ordinal").cast("long")})


_D = pa.decimal128(38, 0)
_FIGURES = pa.schema(
    [("doc_id", pa.int64()), ("ordinal", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("raw", pa.string()), ("micro", _D), ("display_unit", _D), ("unit", pa.string()),
     ("scale", pa.int32()), ("decimals", pa.int32()), ("period", pa.string()), ("parenthesized", pa.bool_()), ("issue", pa.string())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _plain(blocks: DataFrame, found, value: pa.DataType, kind: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("raw", pa.string()), ("value", value)])

    def run(batches):
        for b in batches:
            yield _batch([(d, n, *x) for d, n, t, k in zip(*(c.to_pylist() for c in b.columns)) for x in found(t or "", k or "paragraph")], schema)

    return _filled(blocks, {"kind": "string"}).select("doc_id", "ordinal", "text", "kind").mapInArrow(run, f"doc_id long, ordinal long, start int, `end` int, raw string, value {kind}")


def dates(blocks: DataFrame) -> DataFrame:
    """(doc_id, ordinal, start, end, raw, value): ISO dates, of table cells too."""
    return _plain(blocks, lambda t, k: sp.dates(t), pa.string(), "string")


def years(blocks: DataFrame) -> DataFrame:
    return _plain(blocks, sp.years, pa.int32(), "int")


def statements(blocks: DataFrame) -> DataFrame:
    return _plain(blocks, sp.statements, pa.string(), "string")


def report_year(blocks: DataFrame, first: int = 400) -> DataFrame:
    """(doc_id, report_year, n_years): the year most often named in a document's first blocks, the later one at ties; with how many are named in all its blocks."""
    named = years(blocks).groupBy("doc_id", "value").agg(F.count_if(F.col("ordinal") <= first).alias("n"), F.count("*").alias("_all"))
    early = F.when(F.col("n") > 0, F.struct("n", "value"))
    return named.groupBy("doc_id").agg(F.max(early)["value"].alias("report_year"), F.sum("_all").alias("n_years")).where("report_year IS NOT NULL")
