"""Facts, values, formulas and references against plain loops over random tables."""

import random
import re

import pytest
import regex

from ledgerlight.functions.lineitems import ITEMS, NUMBERING
from ledgerlight.operators import facts as F
from ledgerlight.operators import tables as T

U = 1_000_000
FIGURES = (
    "doc_id long, table_no int, row_no int, column_no int, label string, level int, davon boolean, alternate boolean, micro long, display_unit long, "
    "unit string, period string, issue boolean, column_period string, percent boolean, change boolean, amount boolean, source string"
)
FIELDS = [x.split()[0] for x in FIGURES.split(",")]
LABELS = ["A. Eigenkapital", "Bilanzsumme", "Zinsen und ähnliche Erträge", "Zinsen und ähnliche Aufwendungen", "Fremdkapital", "Summe", "1. Jahresüberschuss", "a) Teil", "Fremdkapitalquote", "", None]
CAPTIONS = [None, "", "9. Eigenkapital:", "Entwicklung der Bilanzsumme", "Jahresüberschuss und Vorräte", "Anhang"]


def frame(spark, rows):
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], FIGURES)
    return df.withColumns({c: df[c].cast("decimal(38,0)") for c in ("micro", "display_unit")})


def random_rows(rng, docs):
    rows, captions, groups, sums = [], [], [], []
    for doc in range(docs):
        for t in range(rng.randint(1, 4)):
            alternate, wide = rng.random() < 0.25, rng.random() < 0.4
            captions.append((doc, t, rng.choice(CAPTIONS)))
            columns = {1: "current", 2: "prior", **({3: "current"} if wide else {})}
            names = rng.choice([{}, {1: "Inland", 2: "Gesamt", 3: "Gesamt"}, {1: "Inland", 2: None, 3: "Ausland"}, {1: "EUR", 3: "2021"}])
            groups += [(doc, t, c, names[c]) for c in columns if c in names]
            for r in range(rng.randint(0, 8)):
                label = rng.choice(LABELS)
                level = {"A. ": 1, "1. ": 3, "a) ": 4}.get((label or "")[:3])
                bare = re.sub(NUMBERING, "", label) if label is not None else None
                for c, p in columns.items():
                    v = rng.choice([100, 101, 103, 110, -100, 500, 0, None])
                    rows.append({"doc_id": doc, "table_no": t, "row_no": r, "column_no": c, "label": bare, "level": level, "davon": rng.random() < 0.05, "alternate": alternate, "micro": None if v is None else v * U,
                                 "display_unit": rng.choice([1, 1, 10]) * U, "unit": rng.choice(["EUR"] * 8 + ["percent", "pieces", None]), "period": rng.choice([p, p, None]), "issue": rng.choice([False, False, None, None, True]), "column_period": p, "percent": False, "change": False, "amount": rng.random() < 0.95, "source": "x"})
                    if rng.random() < 0.2:
                        again = rng.random() < 0.3
                        sums.append((doc, t, r, c, rng.choice(["match", "mismatch"]), rng.choice(["+0+1", "+0-1+2", "+0"]), "Eigenkapital" if again else bare, again))
    return rows, captions, groups, sums


def item_of(label):
    return next((k for k, _, row, _ in ITEMS if label and re.fullmatch(f"(?i:{row})", label)), None)


def item_of_caption(c):
    if not c:
        return None
    bare = re.sub(":\\s*$", "", re.sub(NUMBERING, "", c)).strip()
    return item_of(bare) or next((k for k, _, _, text in ITEMS if regex.search(f"(?i)(?<!\\p{{L}})(?:{text})(?!\\p{{L}})", bare)), None)


def plain_facts(rows, captions, groups, sums):
    about, group = {(d, t): item_of_caption(c) for d, t, c in captions}, {(d, t, c): g or "" for d, t, c, g in groups}
    columns = {}
    for r in rows:
        columns.setdefault((r["doc_id"], r["table_no"]), {})[r["column_no"]] = r["column_period"]
    out = []
    for r in sorted(rows, key=lambda r: tuple(r[f] for f in FIELDS[:4])):
        d, t, c = (r[f] for f in ("doc_id", "table_no", "column_no"))
        names = {n: group.get((d, t, n), "") for n in columns[d, t]}
        total = next((names[n] for n in sorted(names) if names[n] in ("Gesamt",)), None)
        broken = any(len({names[n] for n, p in columns[d, t].items() if p == period and names[n] not in ("", "EUR", "2021")}) > 1 for period in ("current", "prior"))
        if r["micro"] is None or r["issue"] or not r["amount"] or r["davon"] or r["unit"] not in ("EUR", "percent") or broken and names[c] != total:
            continue
        s = next((s for s in sums if s[:4] == (d, t, r["row_no"], c)), None)
        label = s[6] if s and s[7] else r["label"]
        is_sum = label == "Summe"
        item = about[d, t] if is_sum else item_of(label)
        ok = bool(s and s[4] == "match")
        out.append({**r, "at": (d, t, r["row_no"], c), "label": label, "item": item, "key": item or f"label:{(label or '').lower()}", "kind": next((k for i, k, _, _ in ITEMS if i == item), None), "via": is_sum and item is not None, "re": bool(s and s[7]), "ok": ok, "terms": len(re.findall("[+-]", s[5])) if ok else 1, "per": r["period"] or r["column_period"], "raw": r["period"]})
    return out


def size(f, v=None):
    v = f["micro"] if v is None else v
    return abs(v) if f["kind"] == "expense" else v


def plain_values(facts):
    groups = {}
    for f in facts:
        if f["unit"] == "EUR":
            groups.setdefault((f["doc_id"], f["key"], f["per"]), []).append(f)
    out = {}
    for k, every in groups.items():
        kept = [f for f in every if not f["alternate"]] or every
        kept = [f for f in kept if not f["via"]] or kept
        best = min(kept, key=lambda f: (f["re"], f["display_unit"], not f["ok"], f["at"]))
        agree = all(abs(size(f) - size(best)) <= max(f["display_unit"], best["display_unit"]) for f in kept)
        out[k] = (best["at"][1:], best["micro"], best["display_unit"], all(f["alternate"] for f in every), agree, len(kept))
    return out


def nearest(a, b):
    q = (2 * abs(a) * 100 * U + abs(b)) // (2 * abs(b))
    return -q if (a < 0) != (b < 0) else q


def plain_formula(values, key, doc, per):
    """(micro, unit) by recursion, or None."""
    how, *names = next(f[1:] for f in F.FORMULAS if f[0] == key)

    def operand(k):
        v = values.get((doc, k, per))
        if v:
            return None if v[3] else v[1:3]
        return plain_formula(values, k, doc, per) if any(f[0] == k for f in F.FORMULAS) else None

    a, b = map(operand, names)
    if not a or not b or how == "share" and b[0] == 0:
        return None
    if how == "share":
        return nearest(a[0], b[0]), 10_000
    return (a[0] - b[0] if how == "difference" else abs(a[0]) - abs(b[0])), max(a[1], b[1])


def plain_references(facts, rows):
    groups, out = {}, []
    for f in facts:
        if f["item"] and f["unit"] == "EUR":
            groups.setdefault((f["doc_id"], f["item"], f["per"]), []).append(f)
    for every in groups.values():
        ref = min(every, key=lambda f: (f["alternate"], f["re"], not f["ok"], f["display_unit"], f["at"]))
        for f in every:
            if f["table_no"] == ref["table_no"]:
                continue
            unit = max(f["display_unit"], ref["display_unit"])
            most = unit * max(f["terms"], ref["terms"])
            fits = abs(size(f) - size(ref)) <= most
            if not fits and (f["via"] or ref["via"]):
                part, whole = (f, ref) if f["via"] else (ref, f)
                below = sorted((r for r in rows if (r["doc_id"], r["table_no"]) == whole["at"][:2] and r["row_no"] > whole["row_no"]), key=lambda r: r["row_no"])
                shown = False
                for r in below:
                    if whole["level"] is None or r["level"] is None or r["level"] <= whole["level"]:
                        break
                    shown |= r["micro"] is not None and r["period"] == part["raw"] and abs(r["micro"] - part["micro"]) <= max(r["display_unit"], part["display_unit"])
                if shown:
                    continue
            other = f["alternate"] or ref["alternate"]
            if not fits and other and f["kind"] != "result":
                continue
            sign = f["kind"] != "expense" and abs(abs(f["micro"]) - abs(ref["micro"])) <= unit
            code = "matches" if fits else "structure" if other else "candidates" if f["re"] or ref["re"] else "sign" if sign else "differs"
            out.append((*f["at"], f["per"], code, "match" if fits else "uncertain" if code in ("structure", "candidates") else "mismatch", f["micro"], ref["micro"], most, *ref["at"][1:]))
    return sorted(out)


@pytest.fixture(scope="module")
def random_tables(spark):
    rows, captions, groups, sums = random_rows(random.Random(5), 150)
    figures = frame(spark, rows)
    built = F.build(
        figures, spark.createDataFrame(captions, "doc_id long, table_no int, caption string"), spark.createDataFrame(groups, "doc_id long, table_no int, column_no int, group string"),
        spark.createDataFrame(sums, "doc_id long, table_no int, row_no int, column_no int, status string, parts string, label string, relabelled boolean"),
    ).cache()
    return rows, plain_facts(rows, captions, groups, sums), figures, built


def test_facts(random_tables):
    _, want, _, built = random_tables
    got = sorted((r.doc_id, r.table_no, r.row_no, r.column_no, r.key, r.item or "", r.item_kind or "", r.via_caption, r.relabelled, r.confirmed, r.terms, r.period) for r in built.collect())
    assert got == sorted((*f["at"], f["key"], f["item"] or "", f["kind"] or "", f["via"], f["re"], f["ok"], f["terms"], f["per"]) for f in want)
    assert len(got) > 1000 and any(f["via"] for f in want)


def test_values_formulas_and_shares(random_tables):
    _, facts, _, built = random_tables
    want = plain_values(facts)
    values = F.resolved(built).cache()
    assert {(r.doc_id, r.key, r.period): ((r.table_no, r.row_no, r.column_no), r.micro, r.display_unit, r.alternate_only, r.consistent, r.candidates) for r in values.collect()} == want
    assert {v[4] for v in want.values()} == {True, False}
    places = {(d, p) for d, _, p in want}
    made = {(d, f[0], p): plain_formula(want, f[0], d, p) for d, p in places for f in F.FORMULAS}
    made = {k: v for k, v in made.items() if v}
    assert {(r.doc_id, r.key, r.period): (r.micro, r.display_unit) for r in F.evaluated(values).collect()} == made
    assert any(k[1] == "fremdkapitalquote" and (k[0], "fremdkapital", k[2]) not in want for k in made)
    known = {**{k: v[1] for k, v in want.items() if not k[1].startswith("label:") and not v[3]}, **{k: v[0] for k, v in made.items() if k not in want and not k[1].endswith("quote")}}
    total = {(d, p): v[1] for (d, k, p), v in want.items() if k == "bilanzsumme" and not v[3]}
    share = {(d, f"share:{k}", p): nearest(v, total[d, p]) for (d, k, p), v in known.items() if total.get((d, p))}
    assert {(r.doc_id, r.key, r.period): r.micro for r in F.shares(values).collect()} == share


def test_derived_rows(random_tables):
    _, facts, _, built = random_tables
    values, want = plain_values(facts), []
    for f in facts:
        v = f["unit"] == "EUR" and f["key"] in ("fremdkapital", "nettozinsertrag", "provisionsergebnis") and plain_formula(values, f["key"], f["doc_id"], f["per"])
        if v:
            want.append((*f["at"], "match" if abs(f["micro"] - v[0]) <= 2 * max(f["display_unit"], v[1]) else "mismatch", v[0]))
    assert sorted((r.doc_id, r.table_no, r.row_no, r.column_no, r.status, r.expected) for r in F.derived_rows(built).collect()) == sorted(want) and want


def test_references(random_tables):
    rows, facts, figures, built = random_tables
    want = plain_references(facts, rows)
    got = sorted((r.doc_id, r.table_no, r.row_no, r.column_no, "prior" if r.check == "prior_year" else "current", r.code.removeprefix("reference_"), r.status, r.actual, r.expected, r.tolerance, r.ref_table, r.ref_row, r.ref_column) for r in F.references(built, figures).collect())
    assert got == want and {w[5] for w in want} == {"matches", "structure", "candidates", "sign", "differs"}


def test_formulas_over_formulas_and_circles(spark):
    deep = (("c", "difference", "b", "x"), ("b", "difference", "a", "x"), ("a", "magnitudes", "x", "y"))
    assert [f[0] for f in F.formula_order(deep)] == ["a", "b", "c"]
    values = spark.createDataFrame([(1, "x", "current", -9, 1, False), (1, "y", "current", 2, 3, False), (2, "x", "current", 5, 1, False), (3, "x", "current", 5, 1, False), (3, "y", "current", 5, 1, True)], "doc_id long, key string, period string, micro long, display_unit long, alternate_only boolean")
    values = values.withColumns({c: values[c].cast("decimal(38,0)") for c in ("micro", "display_unit")})
    assert sorted((r.doc_id, r.key, r.micro, r.display_unit, r["round"]) for r in F.evaluated(values, deep).collect()) == [(1, "a", 7, 3, 1), (1, "b", 16, 3, 2), (1, "c", 25, 3, 3)]
    with pytest.raises(ValueError):
        F.formula_order((("a", "share", "b", "x"), ("b", "share", "a", "x")))


def test_one_hot_document_empty_tables_and_other_columns(spark):
    """Very many facts of one item, a table with extra columns that other steps use as names, and no rows at all."""
    base = {"doc_id": 1, "level": None, "davon": False, "alternate": False, "display_unit": U, "unit": "EUR", "period": None, "issue": None, "column_period": "current", "percent": False, "change": False, "amount": True, "source": None}
    rows = [{**base, "table_no": t, "row_no": 0, "column_no": 1, "label": "Eigenkapital", "micro": (100 + t % 3) * U} for t in range(3000)]
    figures = frame(spark, rows).withColumnRenamed("source", "key").withColumn("item", F.F.lit("no"))
    f = F.build(figures)
    v = F.resolved(f).collect()
    assert len(v) == 1 and (v[0].micro, v[0].candidates, v[0].consistent) == (100 * U, 3000, False)
    assert sorted((r["status"], r["count"]) for r in F.references(f, figures).groupBy("status").count().collect()) == [("match", 1999), ("mismatch", 1000)]
    none = F.build(figures.limit(0))
    assert F.resolved(none).count() == 0 and F.references(none, figures).count() == 0 and F.evaluated(F.resolved(none)).count() == 0


def test_facts_of_the_table_model_with_its_sums(spark):
    """The whole way: cells, model, sums that confirm a total, facts under a caption."""
    cells = []
    for r, (label, v) in enumerate([("1. Gewinnrücklagen", 40), ("2. Kapitalrücklage", 60), ("Summe", 100)]):
        for c, text, micro in ((0, label, None), (1, str(v), v * U)):
            cells.append((7, r * 2 + c, 1, 1, r, c, False, "2023" if c else None, text, micro, U if c else None, 0 if c else None, "EUR" if c else None, "current" if c else None, False, False))
    df = spark.createDataFrame(cells, "doc_id long, ordinal long, page int, table_no int, row_no int, column_no int, header boolean, column_label string, text string, micro long, display_unit long, decimals int, unit string, period string, parenthesized boolean, issue boolean")
    m = T.model(df.withColumns({c: df[c].cast("decimal(38,0)") for c in ("micro", "display_unit")}))
    captions = spark.createDataFrame([(7, 1, "A. Eigenkapital")], "doc_id long, table_no int, caption string")
    got = {r.row_no: r for r in F.build(m, captions, None, T.list_sums(m)).collect()}
    assert (got[2].item, got[2].via_caption, got[2].confirmed, got[2].terms) == ("eigenkapital", True, True, 2) and got[0].key == "label:gewinnrücklagen"
