"""Canonical JSON of any value as a column expression, for digests that do not depend on the order of keys.

Keys are in the order that web engines give them: whole numbers below 2**32 - 1 first, by value,
then the others in Unicode collation order. Numbers have the digits that the JVM prints (the
shortest ones from Java 19 on; before, a few numbers have one more), with an exponent from 1e21 upwards
and below 1e-6; instants are in UTC with milliseconds. Fields that differ in case only need a
session that tells case apart.
Null values are ``null``, as are numbers that are not finite; a null struct, array or map too.
Empty ones are ``{}`` and ``[]``. A binary value has no canonical form: ``TypeError``.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import once

_INDEX = "^(?:0|[1-9][0-9]{0,9})$"
MOST_INDEX = 2**32 - 2
#: Characters with an escape of their own. Fixed values.
ESCAPES = (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\b", "\\\\b"), ("\f", "\\\\f"), ("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t"))
# Fixed values end here.


def _index(key: Column) -> Column:
    """The key as a number if it counts as one, else null."""
    n = F.when(key.rlike(_INDEX), key.cast("long"))
    return F.when(n <= MOST_INDEX, n)


def _order(key: Column) -> Column:
    """What keys are sorted by: numbers (-1: none) after which come words, then the words."""
    n = _index(key)
    return F.struct(n.isNull().alias("word"), F.coalesce(n, F.lit(-1)).alias("n"), F.collate(key, "UNICODE").alias("k"), key.alias("plain"))


def quoted(c: Column) -> Column:
    """A string with its quotation marks and escapes."""

    def body(s: Column) -> Column:
        for plain, escaped in ESCAPES:
            s = F.regexp_replace(s, plain, escaped)
        for code in [n for n in range(32) if chr(n) not in "\b\f\n\r\t"]:
            s = F.replace(s, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
        return s

    return once(c, lambda s: F.concat(F.lit('"'), F.when(s.rlike('["\\\\\\x00-\\x1f]'), body(s)).otherwise(s), F.lit('"')))


def number(c: Column) -> Column:
    """A double in its shortest form; null if it is not finite."""

    def body(s: Column) -> Column:
        exponent = F.coalesce(F.try_element_at(F.split(s, "E"), F.lit(2)).cast("int"), F.lit(0))
        whole, fraction = F.regexp_extract(s, "^-?([0-9]+)", 1), F.regexp_extract(s, "\\.([0-9]+)", 1)
        raw = F.concat(whole, fraction)
        digits = F.regexp_replace(F.regexp_replace(raw, "^0+", ""), "0+$", "")
        point = F.length(whole) + exponent - (F.length(raw) - F.length(F.regexp_replace(raw, "^0+", "")))  # places before the decimal point
        n = F.length(digits)
        plain = (
            F.when((point >= n) & (point <= 21), F.rpad(digits, point, "0"))
            .when((point > 0) & (point <= 21), F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, n)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        )
        power = F.concat(F.when(point > 0, "e+").otherwise("e-"), F.abs(point - 1).cast("string"))
        scientific = F.concat(digits.substr(F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), digits.substr(F.lit(2), n))).otherwise(""), power)
        return F.when(digits == "", "0").otherwise(F.concat(F.when(s.startswith("-"), "-").otherwise(""), F.coalesce(plain, scientific)))

    finite = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c.cast("string"))
    return once(finite, body)


def _sorted_names(names: list[str]) -> list[str]:
    """Field names in the order of keys, by the engine's own collation."""
    order = F.array_sort(F.array(*(_order(F.lit(n)) for n in names)))
    return [x["plain"] for x in SparkSession.active().range(1).select(order.alias("a")).first()["a"]] if len(names) > 1 else names


def canonical(c: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a value of type ``kind``, never null."""
    if isinstance(kind, T.StructType):
        names = _sorted_names(kind.names)
        fields = [F.concat(quoted(F.lit(n)), F.lit(":"), canonical(c[n], kind[n].dataType)) for n in names]
        text = F.concat(F.lit("{"), F.array_join(F.array(*fields), ","), F.lit("}")) if fields else F.when(c.isNotNull(), "{}")
        return F.coalesce(F.when(c.isNotNull(), text), F.lit("null"))
    if isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.struct(_order(e["key"].cast("string")).alias("o"), F.concat(quoted(e["key"].cast("string")), F.lit(":"), canonical(e["value"], kind.valueType)).alias("t"))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(c), entry)), lambda e: e["t"]), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        text = quoted(c)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(c.cast("double"))
    elif isinstance(kind, T.DecimalType):
        text = F.regexp_replace(F.format_string("%s", c.cast("string")), "(\\.[0-9]*?)0+$", "$1")
        text = F.regexp_replace(text, "\\.$", "")
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = c.cast("string")
    elif isinstance(kind, T.DateType):
        text = F.date_format(c, "'\"'yyyy-MM-dd'\"'")
    elif isinstance(kind, T.TimestampType):
        text = F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "'\"'yyyy-MM-dd'T'HH:mm:ss.SSS'Z\"'")
    elif isinstance(kind, T.NullType):
        text = F.lit(None).cast("string")
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()}")
    return F.coalesce(text, F.lit("null"))


def content_hash(c: Column, kind: T.DataType) -> Column:
    """Lower-case hex SHA-256 of the canonical JSON in UTF-8."""
    return F.sha2(canonical(c, kind), 256)
