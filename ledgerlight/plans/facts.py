"""Queries of facts, values, formulas and references between tables.

The tables come from line items by SQL that both engines run: a document has up to four
tables, whose rows are the lines of an order. The oracles rank by windows, look for parts by
correlated subqueries and compute formulas by joins, none of which the operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import facts
from ..operators.rounds import settled

QUERIES: dict = {}
ORACLES: dict = {}
U = exact.MICRO


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: Labels by number: (numbering, label, item or null, expense, formula or result). The formulas' items and their operands, sums, "of which", others.
LABELS = (
    ("A. ", "Eigenkapital", "eigenkapital", "balance"), ("", "Bilanzsumme", "bilanzsumme", "balance"), ("", "Rückstellungen", "rueckstellungen", "balance"), ("1. ", "Zinsen und ähnliche Erträge", "zinsertraege", "income"),
    ("2. ", "Zinsen und ähnliche Aufwendungen", "zinsaufwendungen", "expense"), ("", "Provisionserträge", "provisionsertraege", "income"), ("", "Provisionsaufwendungen", "provisionsaufwendungen", "expense"), ("", "Fremdkapital", "fremdkapital", "balance"),
    ("I. ", "Nettozinsertrag", "nettozinsertrag", "result"), ("", "Summe", None, None), ("3. ", "Jahresüberschuss", "jahresergebnis", "result"), ("", "davon Jahresüberschuss", None, None),
    ("", "Sonstige Posten", None, None), ("a) ", "Forderungen", None, None), ("", "Provisionsergebnis", "provisionsergebnis", "result"), ("B. ", "Rückstellungen", "rueckstellungen", "balance"),
)
_DEPTH = {"A. ": 1, "B. ": 1, "I. ": 2, "1. ": 3, "2. ": 3, "3. ": 3, "a) ": 4, "": None}


def _case(values) -> str:
    return "CASE p " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values) if v is not None) + " END"


#: Rows (doc_id, table_no, row_no, p: number of the label, s, k: order), cells (and column_no, v in units), captions and groups of columns.
_LINES = f"""
l AS (SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS doc_id, CAST(l_orderkey % 4 AS INT) AS table_no, l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS row_no, CAST(l_partkey % 16 AS INT) AS p, CAST(l_suppkey + l_linenumber AS BIGINT) AS s FROM {{lineitem}}),
lines AS (SELECT *, {_case([n for n, *_ in LABELS])} || {_case([x for _, x, *_ in LABELS])} AS raw_label, {_case([x for _, x, *_ in LABELS])} AS label, CASE p {" ".join(f"WHEN {i} THEN {_DEPTH[n]}" for i, (n, *_) in enumerate(LABELS) if _DEPTH[n])} END AS level, k % 6 = 0 AS alternate, p = 11 AS davon,
  1000 * (1 + (doc_id * 7 + CASE WHEN p = 9 AND s % 3 = 0 THEN 13 WHEN p = 15 THEN 2 ELSE p END * 13) % 50) AS base FROM l)"""
_CELLS = """
cells AS (SELECT lines.*, column_no, CASE WHEN s % 3 = 0 THEN 10 ELSE 1 END AS u, CASE WHEN s % 17 = 0 THEN 'pieces' WHEN s % 13 = 0 THEN 'percent' ELSE 'EUR' END AS unit, CASE WHEN column_no = 2 THEN 'prior' ELSE 'current' END AS column_period,
    CASE WHEN s % 19 <> 0 THEN CASE WHEN column_no = 2 THEN 'prior' ELSE 'current' END END AS period,
    (base + CASE WHEN column_no = 2 THEN 100 ELSE 0 END + CASE s % 8 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 3 THEN 500 ELSE 0 END) * CASE WHEN s % 8 = 2 THEN -1 ELSE 1 END AS v
  FROM lines {each} WHERE column_no < 3 OR k % 11 IN (0, 2)),
captions AS (SELECT doc_id, table_no, CASE k % 5 WHEN 0 THEN '9. Rückstellungen:' WHEN 1 THEN 'Entwicklung des Eigenkapitals im Jahr' WHEN 2 THEN '' WHEN 3 THEN 'Jahresüberschuss' END AS caption FROM lines WHERE row_no = 0),
grps AS (SELECT doc_id, table_no, column_no, CASE WHEN k % 11 IN (0, 2) THEN CASE column_no WHEN 1 THEN 'Inland' WHEN 2 THEN 'Gesamt' ELSE CASE WHEN k % 11 = 0 THEN 'Gesamt' ELSE 'Ausland' END END WHEN k % 11 = 1 THEN CASE column_no WHEN 1 THEN 'EUR' ELSE '31.12.2021' END WHEN k % 11 = 3 THEN '' END AS grp FROM lines {each} WHERE row_no = 0)"""


def sheets(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables, captions, groups and sums as the operators take them."""
    made = settled(spark.sql(f"WITH {_LINES.format(lineitem=f'parquet.`{sf_dir}/lineitem.parquet`')} SELECT * FROM lines"))  # four tables come from it
    cells = _CELLS.format(each="LATERAL VIEW explode(array(1, 2, 3)) x AS column_no")
    read = lambda what: spark.sql(f"WITH lines AS (SELECT * FROM {{made}}), {cells} {what}", made=made)
    amount = "CAST({} * 1000000 AS DECIMAL(38,0))"
    figures = read(
        f"SELECT doc_id, table_no, row_no, column_no, raw_label, label, level, davon, alternate, {amount.format('v')} AS micro, {amount.format('u')} AS display_unit, 0 AS decimals, unit, period, false AS issue, column_period, false AS percent, false AS change, false AS share, true AS amount FROM cells"
    )
    sums = read("SELECT doc_id, table_no, row_no, column_no, CASE WHEN s % 10 < 5 THEN 'match' ELSE 'mismatch' END AS status, CASE WHEN s % 10 = 0 THEN '+1+2-3' ELSE '+1' END AS parts, CASE WHEN s % 7 = 0 THEN 'Jahresüberschuss' ELSE label END AS label, s % 7 = 0 AS relabelled FROM cells WHERE s % 2 = 0")
    return figures, read("SELECT * FROM captions"), read("SELECT doc_id, table_no, column_no, grp AS `group` FROM grps"), sums


_ITEM = "CASE label " + " ".join(f"WHEN '{x}' THEN '{i}'" for x, i in dict((x, i) for _, x, i, _ in LABELS if i).items()) + " END"
_KIND = "CASE item " + " ".join(f"WHEN '{i}' THEN '{k}'" for i, k in dict((i, k) for _, _, i, k in LABELS if i).items()) + " END"
#: Facts by plain rules: the catalogue as a CASE, broken-down tables by their orders' numbers.
SQL_FACTS = f"""{_LINES.format(lineitem="lineitem")}, {_CELLS.format(each="CROSS JOIN (SELECT unnest([1, 2, 3]) AS column_no)")},
told AS (SELECT cells.* REPLACE (CASE WHEN s % 14 = 0 THEN 'Jahresüberschuss' ELSE label END AS label), s % 14 = 0 AS relabelled, s % 2 = 0 AND s % 10 < 5 AS confirmed, CASE WHEN s % 10 = 0 THEN 3 ELSE 1 END AS terms, coalesce(period, column_period) AS "per",
    CASE k % 5 WHEN 0 THEN 'rueckstellungen' WHEN 1 THEN 'eigenkapital' WHEN 3 THEN 'jahresergebnis' END AS captioned
  FROM cells WHERE NOT davon AND unit <> 'pieces' AND CASE k % 11 WHEN 0 THEN column_no > 1 WHEN 2 THEN column_no = 2 ELSE true END),
named AS (SELECT *, CASE WHEN label = 'Summe' THEN captioned ELSE {_ITEM} END AS item, label = 'Summe' AND captioned IS NOT NULL AS via FROM told),
facts AS (SELECT *, coalesce(item, 'label:' || lower(label)) AS key, {_KIND} AS kind FROM named)"""


def _facts(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    figures, captions, groups, sums = sheets(spark, sf_dir)
    return facts.build(figures, captions, groups, sums), figures


def _plain(df: DataFrame, *amounts: str) -> DataFrame:
    """Amounts as text, which both engines write alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in amounts})


@query(f"""WITH {SQL_FACTS} SELECT doc_id, table_no, row_no, column_no, key, item, kind AS item_kind, via AS via_caption, relabelled, confirmed, terms, alternate, "per" AS period, (v * {U})::BIGINT::VARCHAR AS micro, unit FROM facts""")
def d14_all_facts(spark, sf_dir):
    """Facts with captions, breakdowns by groups of columns, confirmed and relabelled sums."""
    got = _facts(spark, sf_dir)[0]
    return _plain(got.select("doc_id", "table_no", "row_no", "column_no", "key", "item", "item_kind", "via_caption", "relabelled", "confirmed", "terms", "alternate", "period", "micro", "unit"), "micro")


#: The best fact of each key by a window, and whether those of its rank agree.
SQL_VALUES = f"""{SQL_FACTS},
ranked AS (SELECT *, row_number() OVER w AS n, first_value(alternate) OVER w AS a1, first_value(via) OVER w AS c1, first_value(CASE WHEN kind = 'expense' THEN abs(v) ELSE v END) OVER w AS v1, first_value(u) OVER w AS u1 FROM facts WHERE unit = 'EUR'
  WINDOW w AS (PARTITION BY doc_id, key, "per" ORDER BY alternate, via, relabelled, u, NOT confirmed, table_no, row_no, column_no)),
vals AS (SELECT doc_id, key, "per" AS period, any_value(kind) AS kind, max(CASE WHEN n = 1 THEN v END) AS v, max(CASE WHEN n = 1 THEN u END) AS u, max(CASE WHEN n = 1 THEN table_no END) AS table_no, max(CASE WHEN n = 1 THEN row_no END) AS row_no, bool_or(n = 1 AND alternate) AS alternate_only,
    bool_and(abs(CASE WHEN kind = 'expense' THEN abs(v) ELSE v END - v1) <= greatest(u, u1)) FILTER (alternate = a1 AND via = c1) AS consistent, count(*) FILTER (alternate = a1 AND via = c1) AS candidates FROM ranked GROUP BY ALL)"""


@query(f"""WITH {SQL_VALUES} SELECT doc_id, key, period, table_no, row_no, (v * {U})::BIGINT::VARCHAR AS micro, alternate_only, consistent, candidates FROM vals""")
def d15_values(spark, sf_dir):
    """One value for each item: usual structure, labels before captions, labels as they stand, finest, confirmed, first."""
    return _plain(facts.resolved(_facts(spark, sf_dir)[0]).select("doc_id", "key", "period", "table_no", "row_no", "micro", "alternate_only", "consistent", "candidates"), "micro")


_SHARE = "CASE WHEN {b} <> 0 THEN (floor((abs({a})::HUGEINT * 200000000 + abs({b})) // (2 * abs({b}))) * CASE WHEN ({a} < 0) <> ({b} < 0) THEN -1 ELSE 1 END)::BIGINT END"
#: Formulas by joins; debt comes first, for its share needs it.
SQL_FORMULAS = f"""{SQL_VALUES},
operand AS (SELECT doc_id, period, key, v, u FROM vals WHERE NOT alternate_only),
debt AS (SELECT a.doc_id, a.period, 'fremdkapital' AS key, a.v - b.v AS v, greatest(a.u, b.u) AS u FROM operand a JOIN operand b USING (doc_id, period) WHERE a.key = 'bilanzsumme' AND b.key = 'eigenkapital'),
net AS (SELECT a.doc_id, a.period, CASE a.key WHEN 'zinsertraege' THEN 'nettozinsertrag' ELSE 'provisionsergebnis' END AS key, abs(a.v) - abs(b.v) AS v, greatest(a.u, b.u) AS u FROM operand a JOIN operand b USING (doc_id, period) WHERE (a.key, b.key) IN (('zinsertraege', 'zinsaufwendungen'), ('provisionsertraege', 'provisionsaufwendungen'))),
made AS (SELECT * FROM debt UNION ALL SELECT * FROM net),
known AS (SELECT * FROM operand UNION ALL SELECT * FROM made ANTI JOIN vals USING (doc_id, period, key)),
part AS (SELECT a.doc_id, a.period, a.key, {_SHARE.format(a="a.v", b="b.v")} AS micro FROM known a JOIN operand b USING (doc_id, period) WHERE b.key = 'bilanzsumme' AND a.key NOT LIKE 'label:%'),
formulas AS (SELECT doc_id, period, key, (v * {U})::BIGINT AS micro, (u * {U})::BIGINT AS display_unit, 1 AS round FROM made UNION ALL SELECT doc_id, period, key || 'quote', micro, 10000, CASE key WHEN 'eigenkapital' THEN 1 ELSE 2 END FROM part WHERE key IN ('eigenkapital', 'fremdkapital') AND micro IS NOT NULL)"""


@query(f"""WITH {SQL_FORMULAS} SELECT f.doc_id, f.period, f.key, f.micro::VARCHAR AS micro, f.display_unit::VARCHAR AS display_unit, x.key IS NOT NULL AS from_tables, f.round FROM formulas f LEFT JOIN vals x ON x.doc_id = f.doc_id AND x.period = f.period AND x.key = f.key""")
def d15_formulas(spark, sf_dir):
    """Formulas over values and over other formulas; none where an operand is missing or of an alternate table only."""
    return _plain(facts.evaluated(facts.resolved(_facts(spark, sf_dir)[0])), "micro", "display_unit")


@query(f"""WITH {SQL_FORMULAS} SELECT doc_id, period, 'share:' || key AS key, micro::VARCHAR AS micro FROM part WHERE micro IS NOT NULL""")
def d15_shares(spark, sf_dir):
    """Every item's share in the balance sheet total, from tables or formulas."""
    return _plain(facts.shares(facts.resolved(_facts(spark, sf_dir)[0])).select("doc_id", "period", "key", "micro"), "micro")


@query(f"""WITH {SQL_FORMULAS} SELECT f.doc_id, f.table_no, f.row_no, f.column_no, CASE WHEN abs(f.v - m.v) <= 2 * greatest(f.u, m.u) THEN 'match' ELSE 'mismatch' END AS status, (m.v * {U})::BIGINT::VARCHAR AS expected, f.v <> m.v AND abs(f.v - m.v) <= 2 * greatest(f.u, m.u) AS rounded
FROM facts f JOIN made m ON m.doc_id = f.doc_id AND m.period = f."per" AND m.key = f.key WHERE f.unit = 'EUR'""")
def d17_derived_rows(spark, sf_dir):
    """Rows of debt, net interest and commission against their formulas."""
    return _plain(facts.derived_rows(_facts(spark, sf_dir)[0]).select("doc_id", "table_no", "row_no", "column_no", "status", "expected", "rounded"), "expected")


D16_RANKED = f"""WITH {SQL_FACTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item, "per" ORDER BY alternate, relabelled, NOT confirmed, u, table_no, row_no, column_no) AS n FROM facts WHERE item IS NOT NULL AND unit = 'EUR'),
pairs AS (SELECT f.*, r.table_no AS rt, r.row_no AS rr, r.column_no AS rc, r.v AS rv, r.u AS ru, r.period AS rp, r.level AS rl, r.via AS rvia, r.alternate OR f.alternate AS other, r.relabelled OR f.relabelled AS inferred, greatest(f.terms, r.terms) AS n2, greatest(f.u, r.u) AS u2,
    CASE WHEN f.kind = 'expense' THEN abs(f.v) ELSE f.v END AS a, CASE WHEN f.kind = 'expense' THEN abs(r.v) ELSE r.v END AS b
  FROM ranked f JOIN ranked r ON r.doc_id = f.doc_id AND r.item = f.item AND r."per" = f."per" AND r.n = 1 WHERE f.table_no <> r.table_no),
sides AS (SELECT *, abs(a - b) <= n2 * u2 AS fits, kind <> 'expense' AND abs(abs(a) - abs(b)) <= u2 AS sign, CASE WHEN via THEN rt ELSE table_no END AS wt, CASE WHEN via THEN rr ELSE row_no END AS wr, CASE WHEN via THEN rl ELSE level END AS wl, CASE WHEN via THEN period ELSE rp END AS pp, CASE WHEN via THEN v ELSE rv END AS pv, CASE WHEN via THEN u ELSE ru END AS pu FROM pairs),
shown AS (SELECT DISTINCT s.doc_id, s.table_no, s.row_no, s.column_no FROM sides s JOIN cells x ON x.doc_id = s.doc_id AND x.table_no = s.wt AND x.row_no > s.wr AND x.period IS NOT DISTINCT FROM s.pp AND abs(x.v - s.pv) <= greatest(x.u, s.pu)
  WHERE NOT fits AND (via OR rvia) AND wl IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lines y WHERE y.doc_id = s.doc_id AND y.table_no = s.wt AND y.row_no > s.wr AND y.row_no <= x.row_no AND coalesce(y.level <= s.wl, true)))
SELECT doc_id, table_no, row_no, column_no, CASE "per" WHEN 'prior' THEN 'prior_year' ELSE 'cross_reference' END AS "check", CASE WHEN fits THEN 'match' WHEN other OR inferred THEN 'uncertain' ELSE 'mismatch' END AS status,
  CASE WHEN fits THEN 'reference_matches' WHEN other THEN 'reference_structure' WHEN inferred THEN 'reference_candidates' WHEN sign THEN 'reference_sign' ELSE 'reference_differs' END AS code,
  (v * {U})::BIGINT::VARCHAR AS actual, (rv * {U})::BIGINT::VARCHAR AS expected, (n2 * u2 * {U})::BIGINT::VARCHAR AS tolerance, fits AND a <> b AS rounded, rt AS ref_table, rr AS ref_row, rc AS ref_column
FROM sides ANTI JOIN shown USING (doc_id, table_no, row_no, column_no) WHERE fits OR NOT other OR kind = 'result'"""


@query(D16_RANKED)
def d16_ranked_references(spark, sf_dir):
    """Facts against the best fact of their item: terms of confirmed sums, signs, alternate structures, inferred labels, parts under a caption."""
    return _plain(facts.references(*_facts(spark, sf_dir)), "actual", "expected", "tolerance")
