from pyspark.sql import functions as F

from ledgerlight.functions import decisions as d

CRITERIA = "struct<type:string,options:array<struct<key:string,label:string>>,levels:array<string>,true_label:string,false_label:string>"
ANSWER = "struct<type:string,noul:double,choice:string,score:double,confidence:double,probabilities:map<string,double>>"
NOUL, CHOICE = ("noul", [], [], "ja", "nein"), ("choice", [("de", "Deutsch"), ("at", "Wien")], [], None, None)
SCORE = ("score", [], ["a", "b", "c"], None, None)


def test_answers(spark):
    rows = [
        (NOUL, ("noul", 0.2, None, None, None, None)), (CHOICE, ("choice", None, "at", None, 0.7, {"at": 0.81})), (CHOICE, ("choice", None, "fr", None, 0.7, {})), (SCORE, ("score", None, None, 1.5, 0.6, {"2": 0.4})),
        (SCORE, ("score", None, None, 2.1, 0.6, {})), (NOUL, ("choice", None, "de", None, 0.9, {})),
    ]
    df = spark.createDataFrame(rows, f"c {CRITERIA}, a {ANSWER}")
    got = [r.d and tuple(r.d) for r in df.select(d.from_answer(F.col("c"), F.col("a")).alias("d")).collect()]
    assert got == [(False, None, None, 8000, 6000, "nein"), (None, "at", None, 8100, 7000, "Wien"), None, (None, None, 7500, 4000, 6000, "c"), None, None]


def test_model_answers(spark):
    rows = [(NOUL, True, None, None, 12_000), (NOUL, True, "de", None, 1), (CHOICE, None, "de", None, 9000), (SCORE, None, None, 3, 5), (SCORE, None, None, 1, 5)]
    df = spark.createDataFrame(rows, f"c {CRITERIA}, b boolean, k string, l int, p int")
    got = [r.d and tuple(r.d) for r in df.select(d.from_model(*(F.col(x) for x in "cbklp")).alias("d")).collect()]
    assert got == [(True, None, None, 10000, 10000, "ja"), None, (None, "de", None, 9000, 9000, "Deutsch"), None, (None, None, 5000, 5, 5, "b")]


def test_texts(spark):
    df = spark.createDataFrame([(["eins", "zwei"], ["Governance", "kurz", "Kontrolle"], [("x", ["Kontrolle", "Governance"]), ("y", ["Kontrolle"]), ("z", ["kurz"])])], "b array<string>, w array<string>, o array<struct<key:string,words:array<string>>>")
    r = df.select(d.state_text(F.col("b")).alias("s"), d.lexical_candidates(F.col("w"), F.col("o")).alias("k")).first()
    assert r.s == "[1] eins\n\n[2] zwei" and r.k == ["x", "y"]
