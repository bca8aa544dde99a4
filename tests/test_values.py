import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.urls import may_crawl, normalize_url, resolve_one


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "options", "expected"),
    [
        ("  hello   WORLD ", {"casing": "title"}, "Hello World"),
        (" a\tb﻿", {}, "a b"),
        ("Ab", {"casing": "lower"}, "ab"),
        ("Ab", {"casing": "upper"}, "AB"),
        (" a  b ", {"trim": False, "squeeze": False}, " a  b "),
        (None, {}, None),
    ],
)
def test_text(spark, value, options, expected):
    assert one(spark, value, lambda c: X.normalize_text(c, **options)) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [("$1,234.5", "1234.50"), ("12 EUR", "12.00"), ("€ 7", "7.00"), ("", "0.00"), ("$", "0.00"), ("n/a", "n/a"), ("1e2", "100.00"), ("12d", "12d"), (None, None)],
)
def test_currency(spark, value, expected):
    assert one(spark, value, X.normalize_currency) == expected


@pytest.mark.parametrize(("value", "expected"), [("YES", "true"), ("Available", "true"), ("0", "false"), (" yes", " yes"), (None, None)])
def test_boolean(spark, value, expected):
    assert one(spark, value, X.normalize_boolean) == expected


def test_enum_and_list(spark):
    assert one(spark, "blk", lambda c: X.normalize_enum(c, {"Black": ["black", "blk"]})) == "Black"
    assert one(spark, "Blk", lambda c: X.normalize_enum(c, {"Black": ["black", "blk"]})) == "Blk"
    assert one(spark, "a| b ||c", lambda c: X.normalize_list(c, "|")) == ["a", "b", "", "c"]


@pytest.mark.parametrize(
    ("value", "unit", "expected"),
    [("250g", "kg", (0.25, "kg")), ("1500mm", "m", (1.5, "m")), ("32 oz", "lb", (2.0, "lb")), ("2LB", "oz", (32.0, "oz")), ("5 kg", "m", (5.0, "kg")), ("big", "kg", None)],
)
def test_measurement(spark, value, unit, expected):
    found = one(spark, value, lambda c: X.normalize_measurement(c, unit))
    assert (tuple(found) if found else None) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [("a", "a"), ("a,b", '"a,b"'), ('a"b', '"a""b"'), ("a\nb", '"a\nb"'), ("=1", '"\t=1"'), ("-5", '"\t-5"'), ("a\rb", "a\rb"), (None, "")],
)
def test_csv_cell(spark, value, expected):
    assert one(spark, value, X.csv_cell) == expected


def test_redact(spark):
    assert one(spark, "key sk-" + "a1" * 12 + " end", X.redact) == "key [REDACTED] end"
    assert one(spark, "bearer short", X.redact) == "bearer short"


@pytest.mark.parametrize(
    ("value", "kind"),
    [("[1]", "array"), ('{"a":1}', "object"), ("1.5", "number"), ("true", "boolean"), ('"https://a.b"', "url"), ('"$5"', "currency"), ('"x"', "string"), ("null", "string"), (None, "string")],
)
def test_types(spark, value, kind):
    assert one(spark, value, X.infer_type) == kind


@pytest.mark.parametrize(("value", "yes"), [('{"a":""}', False), ('{"a":" \\n"}', False), ('{"a":[null,""]}', False), ('{"a":0}', True), ('{"a":"x"}', True), ("[false]", True), ("{", False), (None, False)])
def test_meaningful(spark, value, yes):
    assert one(spark, value, X.meaningful) is yes


def test_json_is_canonical(spark):
    assert one(spark, '{"b":1.0,"a":[2]}', X.canonical_json) == one(spark, '{ "a": [2], "b": 1 }', X.canonical_json)


def test_similarity(spark):
    rows = spark.createDataFrame([("abc", "ABD"), ("", "x"), ("", "")], "a string, b string").select(X.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [round(r["s"], 4) for r in rows] == [0.6667, 0.0, 1.0]


@pytest.mark.parametrize(
    ("link", "expected"),
    [("/a#b", "https://x.y/a"), ("#top", None), ("JavaScript:x", None), ("mailto:a@b", None), ("//z.w/q", "https://z.w/q"), ("ftp://a.b", None), ("", None), (None, None)],
)
def test_resolve(link, expected):
    assert resolve_one(link, "https://x.y/p/") == expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [("HTTP://A.com:80/x/?b=2&a=1#f", "http://a.com/x?a=1&b=2"), ("https://a.com", "https://a.com/"), ("https://a.com:8443/", "https://a.com:8443/"), ("nothing", None)],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, url, normalize_url) == expected


@pytest.mark.parametrize(
    ("url", "yes"),
    [("https://a.com/", True), ("http://localhost/", False), ("http://b.localhost", False), ("http://10.1.2.3/", False), ("http://172.20.0.1", False), ("http://172.32.0.1", True), ("http://100.64.1.1", False), ("http://198.18.0.1", False), ("http://224.0.0.1", False), ("http://[::1]/", False), ("http://[fd00::1]/", False), ("ftp://a.com", False), (None, False)],
)
def test_may_crawl(spark, url, yes):
    assert one(spark, url, may_crawl) is yes
