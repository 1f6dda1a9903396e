import hashlib
import json
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborweb.functions import identity, urls
from arborweb.model import REQUESTS
from arborweb.operators import forms, http, incidental, requests
from arborweb.plans.frontier import crawl
from arborweb.plans.grammar import Selector
from arborweb.sources import dom

FORM = """<form id=f action='/go' method=post><input name=a value=1><input name=a value=2><input type=checkbox name=c><input type=checkbox name=d checked>
<input type=radio name=r value=x><input type=radio name=r value=y checked><input name=dis value=z disabled><input value=noname><select name=s><option value=''>All<option>two</select>
<select name=m multiple><option selected>1<option>2<option selected value=3>three</select><select name=e></select><textarea name=t>text here</textarea>
<button name=b1 value=v1 id=first>One</button><button name=b2 value=v2 type=submit>Two</button><button type=button name=no>x</button><input type=reset name=rs><input type=image name=img value=i></form>"""


def make(spark, rows):
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", REQUESTS).alias("r")).select("r.*")


def test_dedup_key_text():
    assert identity.dedup_key("GET", "http://x/") == hashlib.sha256(b"GET http://x/|").hexdigest()
    assert identity.key_text("POST", "u", {"b": "1", "a": "2"}, [("y", "1"), ("x", "2")], {"k": 1, "a": 2}) == "POST u?[('a', '2'), ('b', '1')]|[('x', '2'), ('y', '1')]|{\"a\": 2, \"k\": 1}"
    assert identity.key_text("GET", "u", b"raw") == "GET u?b'raw'|"
    assert identity.dedup_key("GET", "u") != identity.dedup_key("POST", "u")


@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=2), st.text("xy", max_size=2)), max_size=5), st.randoms())
@settings(max_examples=50, deadline=None)
def test_the_order_of_fields_does_not_matter(pairs, draw):
    shuffled = list(pairs)
    draw.shuffle(shuffled)
    assert identity.dedup_key("POST", "u", None, pairs) == identity.dedup_key("POST", "u", None, shuffled)


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_requoting_twice_changes_nothing(u):
    once = urls.requote_text(u)
    assert urls.requote_text(once) == once and once.isascii()


def test_requoting():
    assert urls.requote_text("/a b%41%2f%zz é?q=1&r=[x]") == "/a%20bA%2f%25zz%20%C3%A9?q=1&r=[x]"


def test_joining(spark):
    from urllib.parse import urljoin

    cases = [(b, u) for b in ("http://h/d/p?q#f", "https://h", "http://h/a/b/") for u in ("x", "/y", "../z", "?q=2", "//o/p", "http://k/../m", "", "#top", "/a/../b", "mailto:a@b", "/c/./d")]
    df = spark.createDataFrame(cases, "b STRING, u STRING").select("b", "u", urls.join(F.col("b"), F.col("u")).alias("j"))
    assert {(r["b"], r["u"]): r["j"] for r in df.collect()} == {(b, u): urljoin(b, u) for b, u in cases}


def test_globs_and_queries(spark):
    import fnmatch

    globs = ["*a?c*", "[!x]*", "http://h/*.html", "[a-c]b", "a[", "*[0-9].x"]
    texts = ["abc", "xbc", "http://h/a/b.html", "bb", "a[", "q7.x", "ABC"]
    for g in globs:
        df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", urls.matches_glob(F.col("t"), g).alias("m"))
        assert {r["t"]: r["m"] for r in df.collect()} == {t: fnmatch.fnmatchcase(t, g) for t in texts}
    pairs = spark.range(1).select(urls.query_pairs(F.lit("http://h/?a=1&b=&a=2+3&c=%41#d=5")).alias("p")).first()["p"]
    assert [(p["k"], p["v"]) for p in pairs] == [("a", "1"), ("a", "2 3"), ("c", "A")]


@pytest.fixture(scope="module")
def form(spark):
    pages = dom.from_strings(spark, [("http://h/x", f"<html><body>{FORM}</body></html>")])
    return forms.find_forms(dom.shred(pages, content={"option", "textarea"}), Selector.css("form#f")).cache()


def test_fields_of_a_form(form):
    r = form.first()
    assert (r["action"], r["method"], r["n_forms"]) == ("http://h/go", "POST", 1)
    assert [(f["name"], f["field_type"], f["value"]) for f in r["fields"]] == [
        ("a", "text", "1"), ("a", "text", "2"), ("d", "checkbox", "on"), ("r", "radio", "y"), ("s", "select", ""), ("m", "select", "1"), ("m", "select", "3"), ("e", "select", None),
        ("t", "textarea", "text here"), ("b1", "submit", "v1"), ("b2", "submit", "v2"), ("img", "image", "i"),
    ]
    assert r["fields"][4]["options"] == ["", "two"]


def submitted(form, **kw):
    r = forms.submit(form, "next", **kw).first()
    return [(p["k"], p["v"]) for p in r["data"] or r["params"]], r


def test_submitting(form):
    pairs, r = submitted(form)
    assert pairs == [("a", "1"), ("a", "2"), ("d", "on"), ("r", "y"), ("s", ""), ("m", "1"), ("m", "3"), ("e", ""), ("t", "text here"), ("b1", "v1")]
    assert r["method"] == "POST" and r["params"] is None
    via = json.loads(r["via_json"])
    assert (via["type"], via["form_selector"], via["description"]) == ("form_submit", "form#f", "form at form#f")
    gathered = {}
    for k, v in pairs:
        gathered.setdefault(k, []).append(v)
    assert r["dedup_key"] == identity.dedup_key("POST", "http://h/go", None, {k: v[0] if len(v) == 1 else v for k, v in gathered.items()})


def test_overrides_and_submit_selectors(form):
    pairs, _ = submitted(form, data={"a": [None, "9", "10", None], "t": "new", "x": "y"}, submit_selector="[name=b2]")
    assert [p for p in pairs if p[0] in "atx"] == [("a", "1"), ("a", "9"), ("a", "10"), ("t", "new"), ("x", "y")] and pairs[-2] == ("b2", "v2")
    for s, want in {"#first": "b1", "//input[@value='i']": "img", "[value='nope']": "b1", ".cls": "b1", "[value=\"v2\"]": "b2"}.items():
        assert [p[0] for p in submitted(form, submit_selector=s)[0] if p[0] in ("b1", "b2", "img")] == [want]
    with pytest.raises(ValueError):
        forms.submit(form, "")


def test_resolving_and_inheritance(spark):
    parents = spark.createDataFrame([("p", "http://h/d/list?x=1", '{"headers": {"A": "1", "B": "1"}, "k": 1}')], "request_id STRING, url STRING, permanent STRING")
    rel = {"parent_id": "p", "method": "GET", "url": "detail.aspx?id=%31 2", "continuation": "s", "permanent": '{"headers": {"B": "2"}}'}
    rows = requests.complete(make(spark, [rel, {**rel, "dedup_key": "mine"}, {**rel, "skip_dedup": True}, {**rel, "archive": True, "headers": {"B": "own"}}]))
    got = requests.resolve_from(rows, parents).collect()
    url = "http://h/d/detail.aspx?id=1%202"
    assert {r["url"] for r in got} == {url} and {r["current_location"] for r in got} == {"http://h/d/list?x=1"}
    assert sorted(str(r["dedup_key"]) for r in got) == sorted(["mine", "None", identity.dedup_key("GET", url), identity.dedup_key("GET", url)])
    assert sorted(r["headers"]["B"] for r in got) == ["2", "2", "2", "own"] and all(r["headers"]["A"] == "1" for r in got)
    assert all(json.loads(r["permanent"]) == {"headers": {"A": "1", "B": "2"}, "k": 1} for r in got)
    assert sorted(str(r["priority"]) for r in got) == ["1", "None", "None", "None"]
    with pytest.raises(Exception, match="continuation"):
        requests.complete(make(spark, [{**rel, "continuation": ""}])).collect()


def test_dedup_priority_and_steps(spark):
    rows = spark.createDataFrame([(1, "a", None, False), (2, "a", 1, False), (3, "b", 5, False), (4, "a", 9, True), (5, "c", 1, False)], "seq LONG, dedup_key STRING, priority INT, skip_dedup BOOLEAN")
    seen = spark.createDataFrame([("c",)], "dedup_key STRING")
    assert sorted(r["seq"] for r in requests.dedup(rows, seen).collect()) == [1, 3, 4]
    assert [r["seq"] for r in requests.next_batch(rows, 3).collect()] == [2, 5, 3]
    steps = spark.createDataFrame([("s", 4)], "name STRING, priority INT")
    asked = spark.createDataFrame([("s", None), ("s", 2), ("gone", None)], "continuation STRING, priority INT")
    assert sorted(str(r["priority"]) for r in requests.inherit_priority(asked, steps).collect()) == ["2", "4", "None"]
    assert [r["continuation"] for r in requests.missing_steps(asked, steps).collect()] == ["gone"]


def test_deferred_values(spark):
    calls = []

    async def solve():
        calls.append(1)
        return ["x", "y"]

    row = {"parent_id": "p", "method": "POST", "url": "u", "continuation": "s", "data": [{"k": "cap", "v": requests.deferred("solve")}, {"k": "b", "v": "1"}], "via_json": json.dumps({"cap": requests.deferred("solve")})}
    rows = requests.complete(make(spark, [row, {**row, "dedup_key": "own"}]))
    got = requests.resolve_deferred(rows, {"solve": solve}).collect()
    assert calls == [1]
    assert [[(p["k"], p["v"]) for p in r["data"]] for r in got] == [[("cap", "x"), ("cap", "y"), ("b", "1")]] * 2
    assert sorted(r["dedup_key"] for r in got) == sorted(["own", identity.dedup_key("POST", "u", None, {"cap": ["x", "y"], "b": "1"})])
    with pytest.raises(TypeError):
        requests.resolve_deferred(rows, {"solve": lambda: "plain"})


def test_chains_and_reseed_points(spark):
    rows = [("0", None, True)] + [(str(i), str(i - 1), None if i % 3 else i % 2 == 0) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "request_id STRING, parent_id STRING, reseedable BOOLEAN")
    assert {r["request_id"]: (r["depth"], r["root_id"]) for r in requests.chains(df).collect()} == {str(i): (i, "0") for i in range(40)}
    failed = spark.createDataFrame([("8",), ("5",), ("2",)], "request_id STRING")
    assert {r["failed_id"]: r["reseed_id"] for r in requests.reseed_points(df, failed).collect()} == {"8": "6", "5": None, "2": "0"}


def test_archive_and_via(spark):
    asked = spark.createDataFrame([("1", "u1", True), ("2", "u2", True), ("3", "u1", False)], "request_id STRING, url STRING, archive BOOLEAN")
    kept = spark.createDataFrame([("u1", "f1")], "url STRING, file_url STRING")
    assert sorted(tuple(r) for r in requests.archive_decisions(asked, kept).collect()) == [("1", False, "f1"), ("2", True, None)]
    for via in (identity.link_via(Selector.xpath("//a"), "link: x"), identity.form_via(Selector.css("#f"), "css=#b", {"a": ["1", "2"]}, "form at #f")):
        assert identity.read_via(identity.via_json(via)) == via
    assert identity.read_via('{"type": "link", "selector": "(//a)[1]", "description": "d"}')["selector_type"] == "xpath"
    with pytest.raises(ValueError):
        identity.read_via('{"type": "other"}')


def test_status_classes(spark):
    codes = {200: "successful", 304: "successful", 301: "persistent", 404: "persistent", 429: "transient", 503: "transient", 520: "persistent", 555: "persistent", None: "persistent"}
    df = spark.createDataFrame([(c,) for c in codes], "c INT").select("c", http.classify(F.col("c")).alias("k"), http.classify(F.col("c"), {404: "transient"}).alias("o"))
    assert {r["c"]: r["k"] for r in df.collect()} == codes
    assert {r["c"]: r["o"] for r in df.collect()} == codes | {404: "transient"}
    kinds = [http.codes_of(k) for k in ("successful", "transient", "persistent")]
    assert sum(map(len, kinds)) == len(set.union(*kinds))
    with pytest.raises(ValueError):
        http.code_types({1: "odd"})


def test_incidental_matches(spark):
    rows = [("p", "http://h/api/get?q=1&r=", "POST", "xhr", {"X-A": "1"}, bytearray(b'{"a": {"b": [1, 2]}, "c": "d"}')), ("p", "http://h/page", "get", "document", {}, None), ("q", "http://h/api/x?q=2", None, None, {"x-a": "1"}, bytearray(b"a=1&b=two+w"))]
    df = spark.createDataFrame(rows, "parent_id STRING, url STRING, method STRING, resource_type STRING, headers MAP<STRING, STRING>, body BINARY")

    def n(**kw):
        return incidental.matches(df, incidental.Match(**kw)).count()

    assert [n(url="*api*"), n(url="*API*"), n(method="Get"), n(resource_type="XHR"), n(query_contains={"q": "1"}), n(query_contains={"r": ""}), n(header_contains={"x-A": "1"})] == [2, 0, 1, 1, 1, 0, 2]
    assert [n(body_contains="two"), n(body_contains={"c": "d"}), n(body_contains={"a": {"b": [2]}}), n(body_contains={"a": {"b": [3]}}), n(body_contains={"b": "two w", "a": "1"})] == [1, 1, 1, 0, 1]
    assert n(url="*api*", method="post", body_contains={"c": "d"}) == 1
    with pytest.raises(ValueError):
        incidental.Match()
    asked = spark.createDataFrame([("r1", "p"), ("r2", "q"), ("r3", "z")], "request_id STRING, parent_id STRING")
    wrong = incidental.cardinality(asked, df, incidental.Match(url="http*"))
    assert {r["request_id"]: r["actual_count"] for r in wrong.collect()} == {"r1": 2, "r3": 0}
    assert {r["request_id"] for r in incidental.cardinality(asked, df, incidental.Match(url="http*", exactly_one=False)).collect()} == {"r3"}


CONTAINED = [
    ({"a": [1, {"b": 2, "c": 3}]}, {"a": [{"b": 2}]}, True), ([1, 2], [], True), ({"a": 1}, {"a": 2}, False), ([1], {"a": 1}, False), ({"a": 1}, [1], False), ({"x.y": {"it's": None}}, {"x.y": {"it's": None}}, True),
    ({"a": 1}, {"b": None}, False), ({"a": "1"}, {"a": 1}, False), ({"a": True}, {"a": True}, True), ({"a": 1.5}, {"a": 1.5}, True), ([[1, 2], [3]], [[3], [2]], True), ([[1, 2]], [[1, 3]], False), ({}, {}, True), ("x", "x", True), ({"a": [{"b": [1]}]}, {"a": [{"b": [1, 2]}]}, False), ({"a": 7}, {}, True),
]


def test_deep_containment(spark):
    for actual, wanted, there in CONTAINED:
        df = spark.createDataFrame([(json.dumps(actual),), ("{broken",), (None,)], "t STRING")
        assert [r["h"] for r in df.select(incidental.json_column_contains(F.col("t"), wanted).alias("h")).collect()] == [there, False, False], (actual, wanted)


@pytest.mark.parametrize(
    "actual, wanted, there",
    [
        ('{"a\\"b": 1}', {'a"b': 1}, True),
        ('{"a\\\\b": {"]": 2}}', {"a\\b": {"]": 2}}, True),
        ('{"a.b": 1, "": 3}', {"a.b": 1, "": 3}, True),
        ('{"a": {"b": 1}}', {"a.b": 1}, False),
        ('{"n": 123456789012345678901234567890}', {"n": 123456789012345678901234567890}, True),
        ('{"n": 123456789012345678901234567891}', {"n": 123456789012345678901234567890}, False),
        ('{"n": 18446744073709551616}', {"n": 18446744073709551616}, True),
        ('{"n": 9223372036854775807}', {"n": 9223372036854775807}, True),
        ('{"n": 1}', {"n": 10**60}, False),
        ('{"n": 2.0}', {"n": 2}, True),
        ('{"n": 2.5}', {"n": 2.5}, True),
        ('{"n": true}', {"n": 1}, False),
    ],
)
def test_containment_of_odd_keys_and_large_numbers(spark, actual, wanted, there):
    df = spark.createDataFrame([(actual,)], "t STRING")
    assert df.select(incidental.json_column_contains(F.col("t"), wanted).alias("h")).first()["h"] is there


def test_promotion_of_captures(spark):
    asked = spark.createDataFrame([("r1", "p", "next")], "request_id STRING, parent_id STRING, continuation STRING")
    captured = spark.createDataFrame([("p", f"http://h/{k}", "post", "xhr") for k in range(9)], "parent_id STRING, url STRING, method STRING, resource_type STRING")
    got = incidental.promoted_requests(asked, captured, incidental.Match(resource_type="xhr")).collect()
    assert len(got) == 9 and all((r["parent_id"], r["method"], r["nonnavigating"], r["reseedable"]) == ("r1", "POST", True, False) for r in got)
    wrong = incidental.cardinality(asked, captured, incidental.Match(resource_type="xhr")).first()
    assert (wrong["actual_count"], wrong["candidate_urls"]) == (9, [f"http://h/{k}" for k in range(5)])


@pytest.mark.parametrize("pairs", [[("b", "2"), ("a", "x y")], [("a", "1"), ("a", "2")], [("a", "it's")], [("ü", "1")], [("a", "b\\c")], [], None])
def test_keys_of_rows_are_those_of_requests(spark, pairs):
    df = spark.createDataFrame([(None if pairs is None else [{"k": k, "v": v} for k, v in pairs],)], "p ARRAY<STRUCT<k: STRING, v: STRING>>")
    none = F.lit(None).cast("array<struct<k:string,v:string>>")
    key = identity.request_key(F.lit("POST"), F.lit("http://h/"), none, F.col("p"), F.lit(None).cast("string"))
    asked = identity.request_key(F.lit("GET"), F.lit("http://h/"), F.col("p"), none, F.lit(None).cast("string"))
    gathered = {}
    for k, v in pairs or []:
        gathered.setdefault(k, []).append(v)
    gathered = {k: v[0] if len(v) == 1 else v for k, v in gathered.items()}
    r = df.select(key.alias("d"), asked.alias("p")).first()
    assert r["d"] == identity.dedup_key("POST", "http://h/", None, gathered) and r["p"] == identity.dedup_key("GET", "http://h/", gathered)


def test_crawl(spark):
    def rows(ids):
        return spark.createDataFrame([(i, i, f"k{i % 50}", False, None) for i in ids], "seq LONG, n LONG, dedup_key STRING, skip_dedup BOOLEAN, priority INT")

    def run(got):
        more = got.filter("n < 40").select(F.explode(F.array(F.col("n") * 2 + 1, F.col("n") * 2 + 2, F.col("n"))).alias("n"))
        return got.select("n"), more.select(F.col("n").alias("seq"), "n", F.concat(F.lit("k"), (F.col("n") % 50).cast("string")).alias("dedup_key"), F.lit(False).alias("skip_dedup"), F.lit(None).cast("int").alias("priority")), got.filter("false").select("n")

    done = crawl(rows([0]), lambda r: r, run)
    keys = [r["n"] % 50 for r in done.results.collect()]
    assert sorted(keys) == list(range(50)) and done.left.isEmpty()
    part = crawl(rows([0]), lambda r: r, run, rounds=2)
    rest = crawl(part.left, lambda r: r, run, visited=part.visited)
    assert sorted(r["n"] % 50 for r in part.results.unionAll(rest.results).collect()) == list(range(50))
    few = crawl(rows([0]), lambda r: r, run, batch=3)
    assert sorted(r["n"] % 50 for r in few.results.collect()) == list(range(50))


def test_date_range():
    from arborweb.operators.validate import DateRange

    with pytest.raises(ValueError):
        DateRange(date(2024, 2, 1), date(2024, 1, 1))


def test_reseed_points_of_deep_chains_and_circles(spark):
    rows = [("0", None, True)] + [(str(i), str(i - 1), None) for i in range(1, 300)] + [("a", "b", None), ("b", "a", None)]
    df = spark.createDataFrame(rows, "request_id STRING, parent_id STRING, reseedable BOOLEAN")
    failed = spark.createDataFrame([("299",), ("none",)], "request_id STRING")
    assert {r["failed_id"]: r["reseed_id"] for r in requests.reseed_points(df, failed).collect()} == {"299": "0", "none": None}
    (round_,) = requests.reseed_points(df, spark.createDataFrame([("a",)], "request_id STRING")).collect()
    assert (round_["reseed_id"], round_["error"]) == (None, "the parents run in a circle")


def test_chains_and_circles(spark):
    rows = [(str(i), str(i - 1) if i else None) for i in range(40)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "gone")]
    df = spark.createDataFrame(rows, "request_id STRING, parent_id STRING")
    got = {r["request_id"]: (r["depth"], r["root_id"]) for r in requests.chains(df).collect()}
    assert got == {str(i): (i, "0") for i in range(40)} | {k: (None, None) for k in "abcd"} | {"x": (1, "gone")}
    assert requests.chains(df.filter("false")).collect() == []


def test_keys_that_are_missing_and_rows_without_an_order(spark):
    rows = [(None, 1, "u1"), (None, 2, "u2"), ("k", None, "u3"), ("k", 5, "u4"), ("m", None, "u5"), ("m", None, "u5"), ("v", 1, "u6"), (None, None, None)]
    df = spark.createDataFrame(rows, "dedup_key STRING, seq LONG, url STRING")
    got = requests.dedup(df, spark.createDataFrame([("v",), (None,)], "dedup_key STRING")).collect()
    assert sorted((r["dedup_key"] or "", r["url"] or "") for r in got) == [("", ""), ("", "u1"), ("", "u2"), ("k", "u4"), ("m", "u5")]


ODD_HREFS = ["http://[bad", "//[x/y", "http://h]/p", "/a", "http://[::1]/ok", "../up", None, "", "https://plain/x"]


def test_one_href_that_is_no_url_costs_its_link_only(spark):
    from arborweb.operators import links

    anchors = "".join(f'<a href="{h}">t</a>' if h is not None else "<a>t</a>" for h in ODD_HREFS)
    pages = spark.createDataFrame([(1, "http://h/d/p", f"<body>{anchors}<form id=f action='http://[bad'><input name=q></form></body>"), (2, "http://h/d/p", "<body><a href='/fine'>t</a></body>")], "page_id LONG, url STRING, html STRING")
    found = links.find_links(pages, Selector.xpath("//a"))
    got = [(r["href"], r["url"], r["error"]) for r in found.filter("page_id = 1").orderBy("pos").collect()]
    joined = [urls.join_text("http://h/d/p", h) for h in ODD_HREFS]
    assert [g[1] for g in got] == joined and joined[0] is joined[1] is None and joined[4] == "http://[::1]/ok"
    assert [g[2] for g in got] == [f"Not a URL: {h}" if h is not None and j is None else None for h, j in zip(ODD_HREFS, joined)]
    bad = links.bad_links(found).collect()
    assert {r["pos"] for r in bad} == {k for k, (h, j) in enumerate(zip(ODD_HREFS, joined), 1) if h is not None and j is None} and bad[0]["class"] == "AssumptionError"
    assert sorted(r["url"] for r in links.follow(found, "next").collect()) == sorted([j for h, j in zip(ODD_HREFS, joined) if h and j] + ["http://h/fine"])
    (form,) = forms.find_forms(dom.shred(pages), Selector.css("form#f")).collect()
    assert (form["action"], form["error"]) == (None, "Not a URL: http://[bad")
    assert forms.submit(forms.find_forms(dom.shred(pages), Selector.css("form#f")), "next").count() == 0


def test_plain_urls_are_not_sent_to_python(spark):
    df = spark.createDataFrame([("http://h/x", "/a"), ("http://h/x", "http://o/p"), ("http://h/x", "../b")], "b STRING, u STRING")
    plan = df.select(urls.join(F.col("b"), F.col("u")))._jdf.queryExecution().toString()
    # what Python is given is null for a URL that the JVM can join
    assert "ArrowEvalPython" in plan and "THEN null ELSE u" in plan


def test_the_selector_of_a_link_names_its_place(spark):
    from arborweb.operators import links

    pages = spark.createDataFrame([(1, "http://h/", "<div id='d7'>" + "".join(f"<a href='/{k}'>t</a>" for k in range(12)) + "</div>")], "page_id LONG, url STRING, html STRING")
    for s in (Selector.xpath("//div[@id='d7']/a"), Selector.css("div#d7 a")):
        found = links.find_links(pages, s).orderBy("pos").collect()
        assert [r["selector"] for r in found] == [s.nth(k).value for k in range(1, 13)]


def test_resolving_against_a_location_that_is_none(spark):
    new = requests.complete(make(spark, [{"parent_id": "p", "method": "GET", "url": "//[x", "continuation": "c"}, {"parent_id": "p", "method": "GET", "url": "y", "continuation": "c"}]))
    done = requests.resolve_from(new, spark.createDataFrame([("p", "http://h/a", None)], "request_id STRING, url STRING, permanent STRING"))
    assert sorted(r["url"] or "" for r in done.collect()) == ["", "http://h/y"]
    assert [r["message"] for r in requests.without_url(done).collect()] == ["Not a URL, as seen from http://h/a"]


def test_a_crawl_is_taken_up_again(spark, tmp_path):
    """A run that ends after two rounds, one of them half written, gives what one run gives."""

    def rows(ids):
        return spark.createDataFrame([(i, i, f"k{i % 50}", False, None) for i in ids], "seq LONG, n LONG, dedup_key STRING, skip_dedup BOOLEAN, priority INT")

    asked = []

    def run(got):
        asked.append(sorted(r["n"] for r in got.select("n").collect()))
        more = got.filter("n < 40").select(F.explode(F.array(F.col("n") * 2 + 1, F.col("n") * 2 + 2, F.col("n"))).alias("n"))
        return got.select("n"), more.select(F.col("n").alias("seq"), "n", F.concat(F.lit("k"), (F.col("n") % 50).cast("string")).alias("dedup_key"), F.lit(False).alias("skip_dedup"), F.lit(None).cast("int").alias("priority")), got.filter("n % 7 = 0").select("n")

    def told(done):
        return [sorted(r[c] for r in t.collect()) for t, c in ((done.results, "n"), (done.errors, "n"), (done.visited, "dedup_key"))]

    whole = crawl(rows([0]), lambda r: r, run)
    rounds, asked[:] = list(asked), []
    folder = str(tmp_path / "run")
    first = crawl(rows([0]), lambda r: r, run, rounds=2, folder=folder)
    assert first.rounds == 2 and not first.left.isEmpty()
    # the third round broke off: its results stand there, the next frontier does not
    spark.createDataFrame([(999,)], "n LONG").write.parquet(f"{folder}/results/round=2")
    second = crawl(rows([0]), lambda r: r, run, folder=folder)
    assert told(second) == told(whole) and asked == rounds and second.rounds == whole.rounds
    again = crawl(rows([0]), lambda r: r, run, folder=folder)
    assert asked == rounds and told(again) == told(whole)


def test_a_failure_that_passes(spark):
    df = spark.createDataFrame([(500, "60"), (500, None), (None, "5"), (404, "9"), (200, None)], "status_code INT, retry_after STRING")
    done = http.outcomes(df, passing=lambda d: F.col("retry_after").isNotNull() & (F.coalesce("status_code", F.lit(0)) != 404))
    assert [r["action"] for r in done.collect()] == ["retry", "error", "retry", "error", "step"]
