
from pyspark.sql import functions as F

from ledgerlight.operators import batches, checklist, grid, grounding, readmodels, retrieval, sheets


def test_greedy_budget_skips(spark):
    items = F.array(*(F.struct(F.lit(n).alias("n")) for n in (5, 3, 9, 2)))
    kept = spark.range(1).select(retrieval.greedy(items, "n", 10, 16).alias("k")).first().k
    assert [x.n for x in kept] == [5, 3, 2]
    kept = spark.range(1).select(retrieval.greedy(items, "n", 100, 2).alias("k")).first().k
    assert [x.n for x in kept] == [5, 3]


def test_packets(spark):
    texts = ["Vorstand legt Strategie fest", "Governance und Verantwortung des Vorstands klar geregelt", "Kantine bietet Suppe", "Kontrolle der Governance"]
    blocks = spark.createDataFrame([(1, k, t, None) for k, t in enumerate(texts, 1)], "doc_id long, ordinal int, text string, heading string")
    req = spark.createDataFrame([(7, "title", "Governance und Verantwortung"), (7, "aspect", "Vorstand Verantwortung"), (8, "title", "nirgends erwähnt")], "req_id long, part string, text string")
    got = retrieval.packets(blocks, req).orderBy("rank").collect()
    assert [r.req_id for r in got] == [7] * len(got) and got[0].ordinal == 2 and got[0].role == "match"
    assert {r.role for r in got} >= {"match", "context_after"}
    assert sum(r.n_tokens for r in retrieval.packets(blocks, req, max_tokens=4).collect()) <= 4


def test_sections_and_batches(spark):
    sizes = F.array(*map(F.lit, (5, 3, 9, 2))).cast("array<bigint>")
    assert spark.range(1).select(grid.section_numbers(sizes, 10).alias("s")).first().s == [1, 1, 2, 3]
    units = spark.createDataFrame([(1, "a", ["b1", "b2"], 20), (1, "b", ["b2", "b1"], 30), (1, "c", ["b3", "b4"], 10)], "doc_id long, unit_id string, block_keys array<string>, question_tokens long")
    tokens = spark.createDataFrame([(1, f"b{k}", 100) for k in range(1, 5)], "doc_id long, block_key string, tokens long")
    got = batches.plan(units, tokens, 1000, 24).orderBy("batch").collect()
    assert [r.unit_ids for r in got] == [["a", "b"], ["c"]] and got[0].state_tokens == 200 and got[0].question_tokens == 30
    s = batches.summary(batches.plan(units, tokens, 225, 24)).first()
    assert (s.requests, s.questions) == (3, 3)


def test_checklist_issues(spark):
    rows = [("a", None, "t"), ("b", "a", "t"), ("c", "b", "t"), ("d", "c", "t"), ("e", "x", "t"), ("f", "f", "t"), ("g", "h", "t"), ("h", "g", " "), ("a", None, "t"), ("i", None, "z" * 30)]
    df = spark.createDataFrame([(k, p, k, t) for k, p, t in rows], "k string, parent string, sort string, text string")
    got = {(r.k, r.issue) for r in checklist.issues(df, 3, 20).collect()}
    assert got == {("a", "duplicate_key"), ("d", "too_deep"), ("e", "unknown_parent"), ("f", "self_parent"), ("g", "cycle"), ("h", "cycle"), ("h", "empty_text"), ("i", "text_too_long")}


def long_form(spark, sheets_):
    return spark.createDataFrame([(f, r, c, v) for f, rows in sheets_.items() for r, row in enumerate(rows, 1) for c, v in enumerate(row) if v is not None], "file_id string, row_no int, column_no int, value string")


def test_trial_balance(spark):
    s = {
        "one": [["Summen und Salden"], [], ["Konto", "Beschriftung", "EB-Wert", "Soll", "Haben", "Saldo"], ["1200", "Forderungen", "0", "1", "2", "933929.51"], ["Summe Klasse 1", None, None, None, None, "9"], ["1800", "Bank", None, None, None, "4.858.728,78"]],
        "two": [["Konto", "Name", "Saldo", "S/H"], ["1200", "x", "228.104,76", "H"], ["1201", "y", "10,5 H"]],
        "three": [["Konto", "Name", "Saldo Soll", "Saldo Haben"], ["1200", "x", None, "228104.76"]],
        "four": [["Konto", "Name", "EB", "Soll", "Haben"], ["1200", "x", "100,00", "50,50", "20,25"]],
        "none": [["a", "b"], ["1200", "x"]],
    }
    cells = long_form(spark, s)
    got = {(r.file_id, r.row_no): float(r.closing) / 1e6 for r in sheets.trial_balance(cells).collect()}
    assert got == {("one", 4): 933929.51, ("one", 6): 4858728.78, ("two", 2): -228104.76, ("two", 3): -10.5, ("three", 2): -228104.76, ("four", 2): 130.25}
    assert {r.file_id: r.skipped for r in sheets.skipped_rows(cells).collect()}["one"] == 1


def test_checklist_sheet(spark):
    s = {"c": [["Nr.", "Titel", "Anforderung", "Aspekte", "Übergeordnet", "Reihenfolge"], ["A-1", "Eins", "x", "Durchschnitt; Gruppen", None, "2"], ["", " "], ["A-1-a", "Zwei", "y", None, "A-1", "z"]]}
    got = [(r.key, r.aspects, r.parent, r.order) for r in sheets.checklist(long_form(spark, s)).orderBy("row_no").collect()]
    assert got == [("A-1", ["Durchschnitt", "Gruppen"], None, 2), ("A-1-a", [], "A-1", None)]


def test_contract_and_outcome(spark):
    e = "array<struct<block_key:string,quote:string,support:string>>"
    df = spark.createDataFrame([("fulfilled", [], [], 50, "x"), ("no_assessment_possible", [], [], 101, ""), ("fulfilled", [("b", "q", "supports"), ("b", "q", "supports")], [], 90, "x")], f"status string, evidence {e}, missing array<string>, confidence int, explanation string")
    v = grounding.contract_violations(F.col("status"), F.col("evidence"), F.col("missing"), F.col("confidence"), F.col("explanation"))
    assert [r.v for r in df.select(v.alias("v")).collect()] == [["fulfilled_without_support"], ["confidence", "explanation", "missing_information"], ["repeated_evidence"]]
    c = "array<struct<support:string,verdict:string,needs_review:boolean>>"
    df = spark.createDataFrame([("fulfilled", [("supports", "verified", False)]), ("fulfilled", [("supports", "verified", True)]), ("not_fulfilled", [("contradicts", "contradicted", True)]), ("fulfilled", [])], f"status string, checks {c}")
    assert [r.o.reason for r in df.select(grounding.assessment_outcome(F.col("status"), F.col("checks")).alias("o")).collect()] == [None, "not_supported", "contradicted", None]


def test_upsert_and_as_of(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    b = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted(map(tuple, readmodels.upsert(t, b, ["k"]).collect())) == [(1, "a"), (2, None), (3, "c")]
    assert readmodels.append_new(t, b, ["k"]).count() == 3


def test_cycles_of_any_length(spark):
    rows, want = [], set()
    for name, n in (("a", 2), ("b", 10), ("c", 17), ("d", 1000)):
        rows += [(f"{name}{i}", f"{name}{(i + 1) % n}", "s", "t") for i in range(n)]
        want |= {(f"{name}{i}", "cycle") for i in range(n)}
    rows += [(f"tail{i}", f"tail{i - 1}" if i else "b3", "s", "t") for i in range(40)] + [(f"chain{i}", f"chain{i - 1}" if i else None, "s", "t") for i in range(40)] + [("self", "self", "s", "t"), ("on", "self", "s", "t")]
    want |= {(f"tail{i}", "too_deep") for i in range(40)} | {(f"chain{i}", "too_deep") for i in range(3, 40)} | {("self", "self_parent"), ("on", "too_deep")}
    assert {(r.k, r.issue) for r in checklist.issues(spark.createDataFrame(rows, "k string, parent string, sort string, text string")).collect()} == want
    assert checklist.issues(spark.createDataFrame(rows[-42:-40], "k string, parent string, sort string, text string")).where("issue = 'cycle'").count() == 0


def test_upper_median(spark):
    df = spark.createDataFrame([(k, float(v)) for k in range(1, 8) for v in range(k)], "k int, v double")
    assert {r.k: r.m for r in df.groupBy("k").agg(readmodels.upper_median("v").alias("m")).collect()} == {k: k // 2 for k in range(1, 8)}


def test_german_order(spark):
    from ledgerlight.operators import checklist

    rows = [(1, "Zoll", None, 1), (2, "Ärmel", None, 1), (3, "Apfel", None, 1), (4, "arm", "ÄRMEL", 2), (5, "Öl", "ärmel", 2), (6, "Ofen", "Ärmel", 2), (7, "tief", "ofen", 1), (8, "tiefer", "tief", 1), (9, "zu tief", "tiefer", 1), (10, "fremd", "nirgends", 0), (11, "kreis", "kreis", 0), (12, None, "Zoll", None)]
    df = spark.createDataFrame(rows, "k long, key string, parent_key string, sort long")
    got = [(r.position, r.k, r.depth) for r in checklist.display_order(df).orderBy("position").collect()]
    assert got == [(n, k, d) for n, (k, d) in enumerate([(10, 0), (3, 0), (2, 0), (4, 1), (6, 1), (7, 2), (8, 3), (5, 1), (1, 0), (12, 1)], 1)]
    assert checklist.display_order(df.limit(0)).count() == 0
    moves = {(r.k, s): (r.new_sort, r.swap_k) for s in (-1, 1) for r in checklist.moved(spark.createDataFrame([(1, 9, 10), (2, 9, 20), (3, 8, 5)], "k long, parent long, sort long"), s).collect()}
    assert moves == {(1, -1): (None, None), (1, 1): (20, 2), (2, -1): (10, 1), (2, 1): (None, None), (3, -1): (None, None), (3, 1): (None, None)}
