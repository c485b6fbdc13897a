"""Canonical JSON against the forms of the standard, and digests that do not depend on order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import canonical as C


def said(df, name="x"):
    return [r[0] for r in df.select(C.canonical(F.col(name), df.schema[name].dataType)).collect()]


NUMBERS = {0.0: "0", -0.0: "0", 1.0: "1", -1.5: "-1.5", 100.0: "100", 1e7: "10000000", 1.25e10: "12500000000", 123456789012345680000.0: "123456789012345680000", 1e21: "1e+21", 1.5e300: "1.5e+300", 1e-6: "0.000001", 1.5e-7: "1.5e-7",
           1e-7: "1e-7", 0.1: "0.1", 0.30000000000000004: "0.30000000000000004", -2e-5: "-0.00002", float("nan"): "null", float("inf"): "null", float("-inf"): "null"}


def test_numbers(spark):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(NUMBERS)], "n int, x double").orderBy("n")
    assert said(df) == list(NUMBERS.values())
    rng = random.Random(2)
    many = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-12, 25) for _ in range(2000)]
    got = said(spark.createDataFrame([(v,) for v in many], "x double").coalesce(1))
    assert [float(g) for g in got] == many
    assert all(("e" in g) == (not 1e-6 <= abs(v) < 1e21) for g, v in zip(got, many))


def test_strings(spark):
    odd = ["", "a", 'quo"te', "back\\slash", "\b\f\n\r\t", "\x00\x01\x1f", "ä€😀", "/", " ", "\x7f", "$1 \\$", "x" * 100_000 + "\n", "\\\\n"]
    got = said(spark.createDataFrame([(s,) for s in odd], "x string").coalesce(1))
    assert got == [json.dumps(s, ensure_ascii=False) for s in odd]


def test_nested_values(spark):
    df = spark.sql("""SELECT named_struct('b', array(1, null, 3), 'a', named_struct('z', true, 'Y', date'2024-02-29', 'x', cast(null as string)), '10', 1.50bd, '9', 100bd, 'm', map('k', 1.5d, '2', 0d, 'K', -1d, '10', null), 'e', array(), 'f', map(),
      't', timestamp'2024-03-01 12:00:00.25', 's', cast(null as struct<q: int>)) AS x""")
    assert said(df) == ['{"9":100,"10":1.5,"a":{"x":null,"Y":"2024-02-29","z":true},"b":[1,null,3],"e":[],"f":{},"m":{"2":0,"10":null,"k":1.5,"K":-1},"s":null,"t":"2024-03-01T12:00:00.250Z"}']
    with pytest.raises(TypeError):
        C.canonical(F.lit(b"x"), spark.sql("SELECT X'00' AS x").schema["x"].dataType)


def test_digests_do_not_depend_on_the_order_of_keys(spark):
    rng = random.Random(4)
    keys = ["a", "B", "b", "Z", "z9", "_x", "10", "9", "ä", "name", "4294967295", "01"]
    digests = set()
    for _ in range(6):
        rng.shuffle(keys)
        fields = ", ".join(f"'{k}', '{k}{k}'" for k in keys)
        some = ", ".join(f"'{k}', '{k}{k}'" for k in keys if k != "B")
        df = spark.sql(f"SELECT named_struct({some}) AS s, map({some}) AS m, map({fields}) AS b")
        digests |= {r for x in "smb" for r in df.select(C.content_hash(F.col(x), df.schema[x].dataType)).first()}
    assert len(digests) == 2  # the whole map has one key more
    df = spark.sql("SELECT map('_x', 1, '01', 2, '10', 3, '9', 4, 'ä', 5, 'b', 6, 'a', 7, 'B', 8, '4294967295', 9) AS x")
    assert list(json.loads(said(df)[0])) == ["9", "10", "_x", "01", "4294967295", "a", "ä", "b", "B"]
    other = spark.sql("SELECT map('a', 1) AS x UNION ALL SELECT map('a', 2) UNION ALL SELECT cast(null as map<string, int>)")
    assert sorted(said(other)) == ['null', '{"a":1}', '{"a":2}'] and said(other.limit(0)) == []
