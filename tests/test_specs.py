import json
import random

from pyspark.sql import functions as F

from arborweb.operators import incidental, specs

CAPTURE = "n INT, parent_id STRING, url STRING, method STRING, resource_type STRING, headers MAP<STRING, STRING>, body BINARY"


def some_captures():
    draw = random.Random(2)
    rows = []
    for n in range(120):
        url = f"http://h{draw.randrange(3)}/path/{draw.choice(['getcase', 'list', 'a[b', 'Getcase', ''])}" + draw.choice(["", "?a=1", "?a=1&b=2+3", "?b=&a=2#f", "?x=%41"])
        body = draw.choice([None, b"", b'{"a": {"b": [1, 2, {"c": "x"}]}, "n": null}', b"a=1&b=2", b"\xffraw text", b"{broken", b'[1, "a"]'])
        rows.append((n, f"p{n % 7}", url if n % 40 else None, draw.choice([None, "get", "POST", "Post"]), draw.choice([None, "xhr", "Fetch", "document"]), draw.choice([None, {}, {"X-Kind": "1"}, {"x-kind": "2", "Accept": "*"}]), body))
    return rows


MATCHES = [
    dict(url="*getcase*"), dict(url="http://h?/path/*"), dict(url="*[Gg]etcase*"), dict(url="*a[[]b*"), dict(url="*a[b"), dict(url="*"), dict(url="?*"), dict(url="http://h1/path/list"), dict(url="*[!e]"), dict(method="post"), dict(resource_type="XHR"),
    dict(query_contains={"a": "1"}), dict(query_contains={"b": "2 3", "a": "1"}), dict(query_contains={"x": "A"}), dict(header_contains={"X-KIND": "1"}), dict(header_contains={"accept": "*", "X-Kind": "2"}), dict(body_contains="raw"), dict(body_contains={"a": {"b": [{"c": "x"}]}}),
    dict(body_contains={"a": "1", "b": "2"}), dict(body_contains={"a": "1", "b": 2}), dict(body_contains={"n": None}), dict(url="*path*", method="GET", resource_type="fetch", query_contains={"a": "1"}), dict(method="post", body_contains={"a": {"b": [2]}}), dict(url="*nowhere*"),
]


def as_row(k, m):
    body = m.get("body_contains")
    return (f"s{k}", m.get("url"), m.get("method"), m.get("resource_type"), m.get("query_contains"), m.get("header_contains"), body if isinstance(body, str) else None, json.dumps(body) if isinstance(body, dict) else None)


def test_a_table_of_specs_is_every_spec_by_itself(spark):
    captured = spark.createDataFrame(some_captures(), CAPTURE).withColumn("key", F.lit("clash"))
    table = spark.createDataFrame([as_row(k, m) for k, m in enumerate(MATCHES)], specs.SPEC)
    got = sorted((r["spec_id"], r["n"]) for r in specs.matches(captured, table).collect())
    each = None
    for k, m in enumerate(MATCHES):
        found = incidental.matches(captured, incidental.Match(**m)).select(F.lit(f"s{k}").alias("spec_id"), "n")
        each = found if each is None else each.unionByName(found)
    want = sorted((r["spec_id"], r["n"]) for r in each.collect())
    assert got == want and len({s for s, _ in want}) >= len(MATCHES) - 2


def test_specs_are_filed_under_what_they_must_have(spark):
    table = spark.createDataFrame([as_row(k, m) for k, m in enumerate(MATCHES)], specs.SPEC)
    keys = {r["spec_id"]: r["key"] for r in specs.filed(table).collect()}
    assert keys["s0"] == "u:getcas" and keys["s1"] == "u:http:/" and keys["s5"] == specs.ANY and keys["s9"] == "m:POST" and keys["s12"] == "q:a=1" and keys["s15"] == "h:accept=*" and keys["s17"] == specs.ANY
    assert specs._letters("*a[") == "a" and specs._letters("ab[!]]cdef") == "cdef" and specs._letters("") == ""


def test_specs_that_say_nothing(spark):
    table = spark.createDataFrame([("empty", None, "", None, {}, None, "", None), ("broken", None, None, None, None, None, None, "{"), ("ok", "*", None, None, None, None, None, None)], specs.SPEC)
    assert {r["spec_id"]: r["class"] for r in specs.invalid(table).collect()} == {"empty": "ConfigError", "broken": "ConfigError"}
    captured = spark.createDataFrame(some_captures()[1:4], CAPTURE)
    assert {r["spec_id"] for r in specs.matches(captured, table).collect()} == {"ok"}
    assert specs.matches(captured, table.filter("false")).collect() == [] == specs.matches(captured.filter("false"), table).collect()


def test_claims(spark):
    captured = spark.createDataFrame([(k, "p", f"http://h/{k}", "get", "xhr", None, None) for k in range(8)], CAPTURE)
    table = spark.createDataFrame([("one", "*/3", None, None, None, None, None, None, True), ("all", "http://h/*", None, None, None, None, None, None, False), ("many", "http://h/*", None, None, None, None, None, None, None)], specs.SPEC + ", exactly_one BOOLEAN")
    asked = spark.createDataFrame([("r1", "p", "one"), ("r2", "p", "all"), ("r3", "p", "many"), ("r4", "q", "all"), ("r5", "p", "missing")], "request_id STRING, parent_id STRING, spec_id STRING")
    got = {r["request_id"]: (r["actual_count"], r["error"], r["candidate_urls"]) for r in specs.claims(asked, captured, table).collect()}
    some = [f"http://h/{k}" for k in range(5)]
    assert got == {"r1": (1, None, None), "r2": (8, None, None), "r3": (8, "IncidentalError", some), "r4": (0, "IncidentalError", None), "r5": (0, "ConfigError", some)}
