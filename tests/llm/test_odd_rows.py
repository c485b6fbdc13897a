"""Nulls, empty texts, repeated rows, clashing columns and empty tables for the operators that SQL tests do not reach."""

import pytest

from ledgerlight.llm import licenses, quality, registry, secrets, urls
from ledgerlight.llm.bpe import Merges, round_trip, sufficient_lookahead
from ledgerlight.llm.wordpieces import token_counts

DOCS = [(1, "Released under the MIT licence.\n(c) 2020 Someone", "a"), (1, "Released under the MIT licence.\n(c) 2020 Someone", "a"), (None, None, "b"), (2, "", "c"), (3, "password = abcdefABCDEF123 AKIA" + "Q7" * 9, "d"), (4, "x" * 100_000, "e")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lines string")


def test_licenses(docs):
    got = sorted((str(r.doc_id), r.license, r.n_notices, r.notices) for r in licenses.scan(docs).collect())
    assert got == [("1", "MIT-line", 1, "MIT-line"), ("1", "MIT-line", 1, "MIT-line"), ("2", None, 0, ""), ("3", None, 0, ""), ("4", None, 0, ""), ("None", None, 0, "")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.COM/en/70?x"), (2, "http://example.com/en/"), (3, None), (4, "no scheme/en/"), (5, "x://net/de/"), (6, "x://b.example.net/de/8"), (6, "x://b.example.net/de/8"), (None, "x://org#/es/"), (7, "x://myorg/es/")]
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == sorted([
        ("1", "a.example.com", "/en/70", "example.com/en/7", "allow"), ("2", "example.com", "/en/", "com/en/", "block"), ("3", "", "", None, "allow"), ("4", "", "", None, "allow"), ("5", "net", "/de/", "net/de/", "allow"),
        ("6", "b.example.net", "/de/8", "example.net/de/8", "block"), ("6", "b.example.net", "/de/8", "example.net/de/8", "block"), ("None", "org", "", None, "allow"), ("7", "myorg", "/es/", None, "allow"),
    ])
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_quality(docs):
    got = quality.judged(docs).select("doc_id", "lines", "_q.*").collect()
    assert len(got) == 6 and all(r.base_failed and not r.kept for r in got)
    assert quality.filtered(docs).columns == docs.columns
    assert quality.judged(docs.limit(0)).count() == 0
    clash = docs.withColumnRenamed("lines", "_q")
    assert quality.filtered(clash).columns == clash.columns


def test_secrets(docs):
    got = {str(r.doc_id): [(s.kind, s.start, s.end) for s in r._spans] for r in secrets.scanned(docs).collect()}
    assert got["3"] == [(0, 0, 26), (1, 27, 49)] and got["None"] == got["2"] == []
    assert {r.text for r in secrets.redacted(docs).where("doc_id = 3").collect()} == {"[SECRET] [SECRET]"}
    assert secrets.redacted(docs).columns == docs.columns and secrets.redacted(docs).where("doc_id IS NULL").first().text is None
    assert secrets.redacted(docs.limit(0)).count() == 0


def test_tokens(docs):
    path = registry.vocabulary_file("word_bpe_49k.json")
    got = round_trip(docs, path).collect()
    assert len(got) == 6 and all(r.n_tokens == 0 for r in got if r.doc_id in (None, 2))
    assert round_trip(docs.limit(0), path).count() == 0
    assert token_counts(docs, registry.vocabulary_file("byte_bpe_50k.json")).count() == 6


def test_stream_equals_whole():
    import random

    rnd = random.Random(0)
    for _ in range(40):
        merges = []
        known = list("abc")
        for _ in range(12):
            m = rnd.choice(known), rnd.choice(known)
            if m not in merges:
                merges.append(m)
                known.append(m[0] + m[1])
        m = Merges({k: i for i, k in enumerate(known)}, merges)
        assert m.lookahead == sufficient_lookahead(merges)
        word = [rnd.choice("abc") for _ in range(rnd.randint(1, 300))]
        assert list(m.stream(word, 4)) == m.encode(word)


def test_urls_beyond_a_plans_bits(spark):
    rows = [(i, f"http://h{i % 40}.{'example.' * (i % 3)}{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'es')[i // 3 % 3]}/{i % 11}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [(f"h{i}.com/", ("allow", "block")[i % 2]) for i in range(40)] + [("com/en/", "block"), ("net/", "block"), ("h7.example.net/de/", "allow")]
    want = {}
    for i, url in rows:
        host, path = url[7:].split("/", 1)
        fit = [(len(r), r, v) for r, v in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and ("/" + path).startswith("/" + r.split("/", 1)[1])]
        want[i] = max(fit)[1:] if fit else (None, "allow")
    for bits in (urls.MOST_BITS, 64):
        assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules, most_bits=bits).collect()} == want
    assert {r.verdict for r in urls.judge(pages, ()).collect()} == {"allow"}


def test_license_digests_do_not_depend_on_wrapping(spark):
    texts = ["use\nsub license all", "use sub\nlicense all", "USE sublicense, all!", "licence licence licences", "license license licenses"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.digest for r in licenses.scan(df).collect()}
    assert got[0] == got[1] == got[2] and got[3] == got[4] != got[0]
    whole = dict(licenses.KNOWN)["BSD-3-Clause"]
    rewrapped = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + "\n".join(whole.replace("\n", " ").split(" ")).replace("copyright\nholder\n", "copyright owner\n")
    got = licenses.scan(spark.createDataFrame([(1, rewrapped), (2, "x " * 200_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got} == {1: "BSD-3-Clause", 2: None}


def test_long_licenses_as_published(spark):
    from pathlib import Path

    place = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    rows = [(i, (place / f).read_text()) for f, i in names.items() if (place / f).exists()]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()} if rows else {}
    assert got == {i: i for i, _ in rows}


def test_rules_are_the_contracts(spark):
    assert set(urls.RULES) == {("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")}
    rows = [(1, "x://net/de/"), (2, "http://a.net/de/7"), (3, "http://a.example.net/de/80"), (4, "http://a.org/es/")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("org/es/", "block")}
