import json
import random
from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal
from enum import Enum
from uuid import UUID

import pytest
from pydantic import BaseModel, Field, field_validator
from pyspark.sql import functions as F

from arborweb.errors import AssumptionError, ConfigError, DataFormatError, HaltRun, SkipRequest, PersistentError, SpeculationFailure, StructureError, TransientError, HTTPAssumptionError, expected_count
from arborweb.operators import observe, rates, speculate, validate
from arborweb.operators.speculate import SpeculativeRange
from arborweb.plans import registry
from arborweb.plans.grammar import Selector
from arborweb.sources import responses
from arborweb.streaming.speculation import advance


class Case(BaseModel):
    docket: str
    judge: str = Field(min_length=2)
    filed: date

    @field_validator("docket")
    @classmethod
    def known(cls, v):
        if not v.startswith("B"):
            raise ValueError("unknown docket")
        return v


def test_native_validation(spark):
    rows = [("1", "5.5", "2024-02-30", "http://x/"), ("2", " 7 ", "2024-02-28", "ftp://x/"), (None, "abc", None, None), ("4", "99", "2024-1-1", "https://y")]
    df = spark.createDataFrame(rows, "id STRING, price STRING, day STRING, link STRING")
    fields = [validate.Field("price", "double", least=6.0, most=50.0), validate.Field("day", "date"), validate.Field("link", "url", required=False), validate.Field("id", choices=("1", "2"))]
    got = {r["id"]: r for r in validate.validate(df, fields).collect()}
    locs = {k: [e["loc"] for e in r["errors"]] for k, r in got.items()}
    assert locs == {"1": ["price", "day"], "2": ["link"], None: ["price", "day", "id"], "4": ["price", "day", "id"]} or locs["4"] == ["price", "id"]
    assert got["2"]["price"] == 7.0 and got["2"]["day"] == date(2024, 2, 28) and not got["2"]["valid"]
    said = validate.validate(df, fields).select(validate.summary(F.col("errors")).alias("s")).collect()
    assert any(r["s"] == "link: Input should be a valid url" for r in said)


def test_model_validation(spark):
    rows = [('{"docket": "B1", "judge": "Xy", "filed": "2024-01-02"}',), ('{"docket": "A1", "judge": "X", "filed": "no"}',), ("{broken",), (None,)]
    got = validate.validate_model(spark.createDataFrame(rows, "data STRING"), Case).collect()
    assert [r["valid"] for r in got] == [True, False, False, False]
    assert json.loads(got[0]["data"]) == {"docket": "B1", "judge": "Xy", "filed": "2024-01-02"}
    assert [e["loc"] for e in got[1]["errors"]] == ["docket", "judge", "filed"] and got[2]["errors"][0]["type"] == "json_invalid"


def test_deferred_validation():
    d = validate.Deferred(Case, "http://x/", docket="B2", judge="J", filed="2024-01-01")
    raw = d.raw
    raw["docket"] = "changed"
    assert d.raw["docket"] == "B2" and d.model_name == "Case"
    with pytest.raises(DataFormatError) as e:
        d.confirm()
    assert e.value.errors[0]["loc"] == "judge" and e.value.context["error_count"] == 1 and "URL: http://x/" in str(e.value)
    assert validate.Deferred(Case, docket="B2", judge="Jo", filed="2024-01-01").confirm().filed == date(2024, 1, 1)


def test_errors():
    e = StructureError("//a", "xpath", "links", 1, None, 0, "http://x/")
    assert isinstance(e, AssumptionError) and isinstance(e, PersistentError) and not issubclass(SpeculationFailure, (PersistentError, TransientError))
    assert issubclass(HTTPAssumptionError, TransientError)
    assert str(e).split("\n")[:3] == ["HTML structure mismatch for 'links': expected at least 1, found 0", "URL: http://x/", "Context:"]
    assert [expected_count(*b) for b in ((1, None), (2, 2), (1, 3))] == ["at least 1", "exactly 2", "between 1 and 3"]


def test_ranges(spark):
    of = speculate.templates(spark, [("a", 0, SpeculativeRange(3, 5, gap=2)), ("b", 0, SpeculativeRange(5, 5)), ("c", 0, SpeculativeRange(should_advance=False))])
    assert {r["entry"]: (r["min"], r["soft_max"], r["gap"]) for r in of.collect()} == {"a": (3, 5, 2), "b": (5, 5, 10), "c": (1, 2, 0)}
    assert sorted((r["entry"], r["n"]) for r in speculate.seeds(of).collect()) == [("a", 3), ("a", 4), ("c", 1)]
    later = speculate.started_at(of.filter("entry = 'a'"), F.lit(9)).first()
    assert (later["min"], later["soft_max"]) == (9, 10) and speculate.started_at(of.filter("entry = 'a'"), F.lit(4)).first()["soft_max"] == 5
    for bad in ({"min": 0}, {"min": 5, "soft_max": 4}, {"gap": -1}):
        with pytest.raises(ValueError):
            SpeculativeRange(**bad)


def test_the_probing_loop(spark):
    of = speculate.templates(spark, [("e", 0, SpeculativeRange(1, 3, gap=3)), ("f", 0, SpeculativeRange(2, 4, gap=2)), ("g", 1, SpeculativeRange(1, 3, should_advance=False))])
    there = {"e": {2, 4, 7, 11, 12}, "f": {9}, "g": {1, 2, 3}}
    known = spark.createDataFrame([(e, n) for e, ns in there.items() for n in ns], "entry STRING, n LONG").withColumn("ok", F.lit(True))
    asked = []

    def answer(probes):
        asked.append(probes.count())
        return probes.join(known, ["entry", "n"], "left").select("entry", "param_index", "n", F.coalesce("ok", F.lit(False)).alias("ok"))

    got = {r["entry"]: (r["highest_success"], r["consecutive_failures"], r["done"]) for r in speculate.probe(of, answer).collect()}
    assert got == {"e": (7, 3, True), "f": (None, 2, True), "g": (2, 0, True)}
    assert len(asked) < 8


def test_probing(spark):
    of = speculate.templates(spark, [("e", 0, SpeculativeRange(1, 4, gap=2)), ("f", 1, SpeculativeRange(5, 5, gap=3)), ("g", 0, SpeculativeRange(1, 3, gap=0))])
    assert sorted((r["entry"], r["n"]) for r in speculate.seeds(of).collect()) == [("e", 1), ("e", 2), ("e", 3), ("g", 1), ("g", 2)]
    seen = spark.createDataFrame([("e", 0, n, n in (1, 2)) for n in (1, 2, 3)] + [("g", 0, 1, True), ("g", 0, 2, True)], "entry STRING, param_index INT, n LONG, ok BOOLEAN")
    now = speculate.state(seen, of)
    got = {r["entry"]: (r["highest_success"], r["consecutive_failures"], r["next_n"], r["done"]) for r in now.collect()}
    assert got == {"e": (2, 1, 4, False), "f": (None, 0, 5, False), "g": (2, 0, 3, True)}
    assert sorted((r["entry"], r["n"]) for r in speculate.next_probes(now).collect()) == [("e", 4), ("f", 5), ("f", 6), ("f", 7)]
    more = seen.unionAll(spark.createDataFrame([("e", 0, 4, False)], seen.schema))
    assert speculate.state(more, of).filter("entry = 'e'").first()["done"]
    runs = spark.createDataFrame([("x", n, ok) for n, ok in enumerate([True, False, False, True, False, False, False, True], 1)], "entry STRING, n LONG, ok BOOLEAN")
    assert [(r["n"], r["beyond"]) for r in speculate.failures_beyond(runs, ["entry"]).orderBy("n").collect()] == [(1, 0), (2, 1), (3, 2), (4, 0), (5, 1), (6, 2), (7, 3), (8, 0)]
    assert tuple(speculate.stops(runs, 3, ["entry"]).first()) == ("x", 7, 4)


def test_the_state_of_a_stream():
    state = (None, 0, 0, False)
    for batch in ([(2, True), (1, False)], [(3, False)], [(5, True), (4, False)]):
        state = advance(state, batch, 2)
    assert state == (2, 2, 4, True)


def test_streaming(spark, tmp_path):
    from arborweb.streaming.frontier import status_counts, stream_dedup
    from arborweb.streaming.speculation import stream_speculation

    rows = [("k1", False), ("k1", False), ("k2", True), ("k2", True), ("k3", False)]
    spark.createDataFrame(rows, "dedup_key STRING, skip_dedup BOOLEAN").write.parquet(str(tmp_path / "a"))
    s = stream_dedup(spark.readStream.schema("dedup_key STRING, skip_dedup BOOLEAN").parquet(str(tmp_path / "a")))
    s.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["dedup_key"] for r in spark.table("once").collect()) == ["k1", "k2", "k2", "k3"]
    spark.createDataFrame([("e", n, n == 1) for n in range(1, 5)], "entry STRING, n LONG, ok BOOLEAN").write.parquet(str(tmp_path / "b"))
    t = stream_speculation(spark.readStream.schema("entry STRING, n LONG, ok BOOLEAN").parquet(str(tmp_path / "b")), 3)
    t.writeStream.format("memory").outputMode("update").queryName("states").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    last = spark.table("states").orderBy(F.desc("last_n")).first()
    assert (last["highest_success"], last["consecutive_failures"], last["done"]) == (1, 3, True)
    spark.createDataFrame([(200, datetime(2024, 1, 1, 0, 5)), (503, datetime(2024, 1, 1, 5))], "status_code INT, ts TIMESTAMP").write.parquet(str(tmp_path / "d"))
    u = status_counts(spark.readStream.schema("status_code INT, ts TIMESTAMP").parquet(str(tmp_path / "d")))
    u.writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert {r["class"] for r in spark.table("counts").collect()} == {"successful", "transient"}


def test_rates(spark):
    times = [0.0, 0.4, 0.8, 1.1, 1.2, 5.0]
    df = spark.createDataFrame([("a", datetime.fromtimestamp(1000 + t), i == 2) for i, t in enumerate(times)] + [("b", datetime.fromtimestamp(1000), False)], "site STRING, ts TIMESTAMP, vip BOOLEAN")
    got = rates.admit(df, 2, 1.0, keys=["site"]).filter("site = 'a'").orderBy("ts").collect()
    assert [r["admitted"] for r in got] == [True, True, False, True, False, True]
    got = rates.admit(df, 2, 1.0, keys=["site"], bypass="vip").filter("site = 'a'").orderBy("ts").collect()
    assert [r["admitted"] for r in got] == [True, True, True, True, False, True]
    got = rates.admit_all(df, [(2, 1.0), (3, 10.0)], keys=["site"]).filter("site = 'a'").orderBy("ts").collect()
    assert [r["admitted"] for r in got] == [True, True, False, True, False, False]
    with pytest.raises(ValueError):
        rates.admit(df, 0, 1.0, keys=["site"])
    n = rates.window_counts(df, 1, keys=["site"]).filter("site = 'a'").orderBy("ts").collect()
    assert [r["n_window"] for r in n] == [1, 2, 3, 3, 4, 1]


def test_one_key_is_spread_over_its_stretches(spark):
    draw = random.Random(5)
    times, t = [], 0
    for k in range(1500):
        t += draw.choice([0, 1, 3, 10, 40, 90, 200]) if k % 300 < 200 else draw.choice([0, 1, 2])
        times.append(t)
    free = [draw.random() < 0.1 for _ in times]
    spans = [(2, 30), (5, 100)]
    want, passed = {}, []
    for k, (t, past) in enumerate(zip(times, free, strict=True)):
        want[k] = past or all(len(passed) < n or passed[-n] <= t - s for n, s in spans)
        if want[k] and not past:
            passed.append(t)
    rows = [(k, None, datetime.fromtimestamp(1000 + t), f) for k, (t, f) in enumerate(zip(times, free, strict=True))]
    df = spark.createDataFrame([*rows, (-1, None, None, False), (-2, None, None, True)], "k INT, site STRING, ts TIMESTAMP, vip BOOLEAN").repartition(3)
    got = {r["k"]: r["admitted"] for r in rates.admit_all(df, spans, keys=["site"], bypass="vip", ties=("k",)).collect()}
    assert got == {**want, -1: None, -2: True} and len(set(want.values())) == 2
    keyed = df.filter("ts is not null").select(F.lit("x").alias("key"), F.unix_micros("ts").alias("time"), F.col("vip"))
    blocks = keyed.select("key", F.floor(F.col("time") / 100_000_000).cast("long").alias("block")).distinct()
    dealt = rates.stretches(keyed.filter("not vip").select("key", "time"), [(n, s * 1_000_000) for n, s in spans], blocks)
    assert dealt.select("stretch").distinct().count() > 20
    assert rates.admit_all(df.limit(0), spans, keys=["site"]).count() == 0


def test_observation(spark):
    m = spark.createDataFrame([("r", "//a", i, f"  t {i}\n" + "x" * (200 if i == 1 else 0)) for i in range(6)] + [("r", "//b", 0, None)], "request_id STRING, selector STRING, seq INT, text STRING")
    got = {r["selector"]: r for r in observe.roll_up(m, ["request_id", "selector"]).collect()}
    assert got["//a"]["match_count"] == 6 and got["//a"]["sample_elements"][0] == "t 0" and len(got["//a"]["sample_elements"][1]) == 103 and len(got["//a"]["sample_elements"]) == 3
    rows = [("r", "selector_match_1", None, "//table", "xpath", "tables", 1, 1, None, ["s"]), ("r", "selector_match_2", "selector_match_1", ".//tr", "xpath", "rows", 0, 1, None, []), ("r", "selector_match_3", "selector_match_1", "td", "css", "cells", 2, 0, 1, ["c", "d"]), ("r", "selector_match_10", None, "//p", "xpath", "ps", 2, 2, 2, [""])]
    q = spark.createDataFrame(rows, observe.QUERY)
    r = observe.render(q).first()
    assert r["tree"] == '- //table "tables" ✓ (1 match)\n  → "s"\n  - .//tr "rows" ✗ (0 matches, expected 1+)\n  - td "cells" ✗ (2 matches, expected max 1)\n    → "c"\n- //p "ps" ✓ (2 matches)'
    told = json.loads(r["json"])
    assert [c["selector"] for c in told[0]["children"]] == [".//tr", "td"] and "parent" not in told[0]
    assert {x["element_id"]: x["absolute_selector"] for x in observe.absolute_selectors(q).collect()} == {"selector_match_1": "//table", "selector_match_2": "//table//tr", "selector_match_3": None, "selector_match_10": "//p"}
    assert observe.absolute_text([("xpath", "//a"), ("xpath", "./b"), ("xpath", "c")]) == "//a/b//c"
    assert observe.absolute_text([("css", "a.b"), ("css", "c")]) == "a.b c"


def test_responses(spark):
    df = spark.createDataFrame([(1, "", bytearray(b"caf\xc3\xa9"), True, "f"), (2, "given", bytearray(b"\xff"), False, "f"), (3, None, bytearray(b"\xff\xfe"), None, "f"), (4, '{"a": 1}', None, False, None)], "id INT, text STRING, content BINARY, is_archive BOOLEAN, file_url STRING")
    got = {r["id"]: (r["text"], r["error"]) for r in responses.readable_text(df).collect()}
    assert got == {1: ("café", None), 2: ("given", None), 3: (None, "Failed to decode content as utf-8"), 4: ('{"a": 1}', None)}
    assert {r["id"]: r["p"] for r in df.select("id", responses.local_path(df).alias("p")).collect()} == {1: "f", 2: None, 3: None, 4: None}
    latin = responses.readable_text(df.filter("id = 3"), "latin1").first()["text"]
    assert latin == "ÿþ"
    j = {r["id"]: r["error"] for r in responses.json_of(df.filter("id in (1, 4)")).select("id", "error").collect()}
    assert j == {1: "Failed to parse JSON", 4: None}


class Site(registry.Scraper):
    @registry.entry(Case)
    def by_court(self, court: str, days: list[date]):
        for d in days:
            yield registry.Follow(f"/{court}/{d}", self.parse)

    @registry.entry(Case)
    def by_number(self, n: SpeculativeRange):
        yield registry.Follow(f"/{n.min}", "parse")

    @registry.step(priority=2, preprocess=lambda t: t.replace("<style>", ""))
    def parse(self, page, text, accumulated_data, response):
        yield registry.Data({"p": page.find("p")[0].text_content(), "n": len(text), "acc": accumulated_data.get("x"), "url": response["url"]})
        yield None
        yield registry.Follow("/next", self.other, fields={"accumulated_data": {"y": 1}})

    @registry.step(encoding="latin-1")
    def other(self, json_content, local_filepath):
        if json_content.get("bad"):
            raise AssumptionError("not so", "u")
        yield {"v": json_content["v"], "file": local_filepath}


def test_catalogue(spark):
    s = Site()
    assert [(i.name, i.priority, i.wants) for i in s.list_steps()] == [("other", 9, ("json_content", "local_filepath")), ("parse", 2, ("page", "text", "accumulated_data", "response"))]
    assert [e.name for e in s.list_entries()] == ["by_court", "by_number"] and [e.name for e in s.list_speculative_entries()] == ["by_number"]
    assert s.schema()["entries"]["by_court"]["parameters"]["required"] == ["court", "days"]
    assert s.steps_table(spark).count() == 2 and s.entries_table(spark).count() == 2 and s.about(spark).first()["status"] == "in_development"
    with pytest.raises(ConfigError):
        s.continuation("gone")


def test_seeding():
    s = Site()
    made, templates = s.initial_seed([{"by_court": {"court": "c", "days": ["2024-01-01", "2024-01-02"]}}, {"by_number": {"n": {"min": 3, "soft_max": 4}}}])
    assert [m.url for m in made] == ["/c/2024-01-01", "/c/2024-01-02"] and templates[0][:2] == ("by_number", 0)
    for bad in ([], [{"gone": {}}], [{"by_court": {"court": "c"}}], [{"by_court": {"court": "c", "days": [], "more": 1}}]):
        with pytest.raises(ValueError):
            s.initial_seed(bad)


def test_entries_are_checked_when_declared():
    def bare(self, x):
        yield

    def two(self, a: SpeculativeRange, b: SpeculativeRange):
        yield

    def loose(self, x: tuple):
        yield

    def odd(self, x: object.__class__.__subclasses__):
        yield

    for f in (bare, two, loose, odd):
        with pytest.raises(TypeError):
            registry.entry(Case)(f)


def test_steps(spark):
    rows = [("1", "<style><p>hi</p>", None, "u1", '{"x": 5}', False, None), ("2", None, bytearray(b"<p>\xc3\xa9</p>"), "u2", None, False, None)]
    df = spark.createDataFrame(rows, "request_id STRING, text STRING, content BINARY, url STRING, accumulated_data STRING, is_archive BOOLEAN, file_url STRING")
    got = registry.run_step(df, Site, "parse").orderBy("request_id", "seq").collect()
    assert [(r["request_id"], r["kind"]) for r in got] == [("1", "data"), ("1", "request"), ("2", "data"), ("2", "request")]
    assert json.loads(got[0]["payload"]) == {"p": "hi", "n": 9, "acc": 5, "url": "u1"}
    assert json.loads(got[1]["payload"]) == {"url": "/next", "continuation": "other", "method": "GET", "priority": 9, "accumulated_data": {"y": 1}}
    rows = [("1", None, bytearray(b'{"v": "\xe9"}'), "u", None, True, "/f"), ("2", '{"bad": true}', None, "u", None, False, "/f"), ("3", "no json", None, "u", None, False, None)]
    got = {r["request_id"]: r for r in registry.run_step(spark.createDataFrame(rows, df.schema), Site, "other").collect()}
    assert json.loads(got["1"]["payload"]) == {"v": "é", "file": "/f"}
    assert got["2"]["error_class"] == "AssumptionError" and got["3"]["kind"] == "error"
    with pytest.raises(ConfigError):
        registry.run_step(df, Site, "gone")


class Picky(registry.Scraper):
    @registry.step(auto_await_timeout=5.0)
    def parse(self, page, response):
        said = page.query(Selector.css("h1"), "titles", 1, 1)[0].text_content()
        yield registry.Data(said)
        if said == "stop":
            raise HaltRun("enough")
        if said == "skip":
            raise SkipRequest("not this one")
        if said == "again":
            raise HTTPAssumptionError("later")
        yield registry.Data(page.find("input")[0].get_attribute("name"))


def test_what_breaks_on_one_response_is_its_row(spark):
    pages = {"1": "<h1>a</h1><input name=n>", "2": "<h1>b</h1>", "3": " ", "4": "<!-- no -->", "5": None, "6": "<p>no title", "7": "<h1>stop", "8": "<h1>skip", "9": "<h1>again", "a": "<!DOCTYPE html>"}
    df = spark.createDataFrame([(k, h, "http://h/") for k, h in pages.items()], "request_id STRING, text STRING, url STRING")
    out = registry.run_step(df, Picky, "parse", observe=True).cache()
    got = {}
    for r in out.filter("kind <> 'query'").orderBy("request_id", "seq").collect():
        got.setdefault(r["request_id"], []).append((r["kind"], r["error_class"]))
    data = ("data", None)
    assert got == {"1": [data, data], "2": [data, ("error", "IndexError")], **{k: [("error", "AssumptionError")] for k in "345a"}, "6": [("error", "StructureError")], "7": [data, ("halt", "HaltRun")], "8": [data, ("skip", "SkipRequest")], "9": [data, ("error", "HTTPAssumptionError")]}
    acts = {r["request_id"]: r["action"] for r in registry.actions(out, Picky().continuation("parse")._step).collect()}
    assert acts == {"2": "error", "3": "error", "4": "error", "5": "error", "a": "error", "6": "await", "7": "halt", "8": "skip", "9": "retry"}
    late = registry.actions(out.withColumns({"n": F.lit(3), "s": F.lit(9.0)}), Picky().continuation("parse")._step, attempt="n", waited="s").filter("request_id in ('6', '9')")
    assert {r["action"] for r in late.collect()} == {"error"}
    told = {r["request_id"]: r for r in registry.queries_of(out).collect()}
    assert (told["6"]["match_count"], told["6"]["expected_max"], told["1"]["sample_elements"]) == (0, 1, ["a"])
    assert registry.split_outputs(out)[2].count() == 7


FORM = """<html><body><form id=f action=../go method=post><input name=a value=1><input name=a value=2><input name=off disabled>
<input type=checkbox name=c><input type=checkbox name=d checked><select name=s><option value=''>All<option>two</select>
<select name=m multiple><option selected value=1>x<option>y<option selected>3</select><textarea name=t>text</textarea>
<input type=reset name=z><button name=b1 value=v1 id=first>1</button><input type=submit name=b2 value=v2></form>
<div class=l><a href=/x>X y</a> <a href=z?q=1> Z </a></div><p>no <a>href</a></p></body></html>"""


def test_the_page_of_a_step():
    from arborweb.plans.page import Observer, Page
    from arborweb.sources.dom import parse

    seen = Observer()
    page = Page(parse(FORM), "http://h/d/e", 0, seen)
    form = page.find_form(Selector.css("#f"), "the form")
    assert (form.action, form.method, form.get_field("d").value, form.get_field("none")) == ("http://h/go", "POST", "on", None)
    row = form.submit("next", {"a": [None, "9", "10"], "x": "y"}, "[name=b2]", archive=True).row()
    assert [(p["k"], p["v"]) for p in row["data"]] == [("a", "1"), ("a", "9"), ("a", "10"), ("d", "on"), ("s", ""), ("m", "1"), ("m", "3"), ("t", "text"), ("b2", "v2"), ("x", "y")]
    assert row["method"] == "POST" and row["archive"] and json.loads(row["via_json"])["submit_selector"] == "[name=b2]"
    assert {s: form.submit("n", submit_selector=s).row()["data"][-1]["k"] for s in ("#first", "xpath=//input[@value='v2']", "button.x", "][", Selector.css("form#f input[name=b2]"))} == {"#first": "b1", "xpath=//input[@value='v2']": "b2", "button.x": "b1", "][": "b1", Selector.css("form#f input[name=b2]"): "b2"}
    links = page.find_links(Selector.css("div.l a"), "links", 2, 2)
    assert [(x.url, x.text, x.selector.value) for x in links] == [("http://h/x", "X y", ":nth-match(div.l a, 1)"), ("http://h/d/z?q=1", "Z", ":nth-match(div.l a, 2)")]
    assert json.loads(links[1].follow("next", priority=2).row()["via_json"])["description"] == "link: Z"
    with pytest.raises(StructureError, match="anchors missing href"):
        page.find_links(Selector.xpath("//a"), "anchors")
    with pytest.raises(StructureError, match="at least 5, found 1"):
        page.query(Selector.xpath("//p"), "paragraphs", 5)
    with pytest.raises(ConfigError):
        page.query_strings(Selector.css("a"), "strings")
    with pytest.raises(ValueError):
        page.query(Selector.xpath("//p"), "paragraphs", 2, 1)
    box = page.query(Selector.css("div.l"), "box")[0]
    for _ in range(2):
        assert box.query_strings(Selector.xpath("./a/@href"), "hrefs") == ["/x", "z?q=1"]
    mine = [q for q in seen.made.values() if q["description"] in ("box", "hrefs")]
    assert [(q["match_count"], q["parent_element_id"]) for q in mine] == [(1, None), (4, mine[0]["element_id"])] and mine[1]["sample_elements"] == ["/x", "z?q=1", "/x"]


def test_checks(monkeypatch):
    from arborweb import checks

    def half(n):
        return n // 2

    assert checks.require(lambda n: n > 0, "n is positive")(half) is half
    monkeypatch.setenv("ARBORWEB_CHECKS", "1")
    strict = checks.ensure(lambda n, result: result * 2 == n, "n is even")(checks.require(lambda n: n > 0, "n is positive")(half))
    assert strict(4) == 2
    with pytest.raises(AssertionError, match="precondition of half: n is positive"):
        strict(0)
    with pytest.raises(AssertionError, match="postcondition of half: n is even"):
        strict(3)


def test_building_requests(spark):
    from arborweb.operators import requests

    r = requests.build(spark, [{"url": "u", "continuation": "s", "params": {"a": ["1", "2"], "b": 3}, "timeout": (1, 2), "permanent": {"headers": {"x": "1"}}}]).first()
    assert [(p["k"], p["v"]) for p in r["params"]] == [("a", "1"), ("a", "2"), ("b", "3")]
    assert (r["method"], r["connect_timeout"], r["read_timeout"], r["allow_redirects"], r["verify"]) == ("GET", 1.0, 2.0, True, "true")
    assert json.loads(r["permanent"]) == {"headers": {"x": "1"}}
    with pytest.raises(ValueError):
        requests.build(spark, [{"url": "u", "method": "get"}])


def test_wait_conditions(spark):
    class Waiting(registry.Scraper):
        @registry.step(await_list=(registry.WaitForSelector("#a"), registry.WaitForTimeout(5)))
        def one(self, page):
            yield None

    assert json.loads(Waiting().steps_table(spark).first()["await_list"]) == [{"type": "WaitForSelector", "selector": "#a", "state": "visible", "timeout": None}, {"type": "WaitForTimeout", "timeout": 5}]


def test_requests_without_a_time(spark):
    rows = [("a", 0.0, 1), ("a", 0.5, 2), ("a", None, 3), ("a", None, 4), ("b", None, 5), (None, 1.0, 6), ("a", -5.0, 7)]
    df = spark.createDataFrame(rows, "site STRING, s DOUBLE, _at INT").select("site", F.col("s").cast("timestamp").alias("ts"), "_at", F.lit("x").alias("time"))
    got = {r["_at"]: r for r in rates.window_counts(df, 1, keys=["site"]).collect()}
    assert {k: r["n_window"] for k, r in got.items()} == {1: 1, 2: 2, 3: None, 4: None, 5: None, 6: 1, 7: 1} and {r["time"] for r in got.values()} == {"x"}
    got = {r["_at"]: r["admitted"] for r in rates.admit(df, 1, 1.0, keys=["site"]).collect()}
    assert got == {1: True, 2: False, 3: None, 4: None, 5: None, 6: True, 7: True}


class Odd(BaseModel):
    amount: Decimal
    tags: set[str]


class Shade(Enum):
    DARK = "dark"


@dataclass
class Inner:
    days: tuple[date, ...]


def test_records_of_any_type():
    """What a step may yield, and how it stands in JSON."""
    made = {
        "decimal": Decimal("1.50"), "set": {"b", "a"}, "days": (date(2024, 1, 2), datetime(2024, 1, 2, 3, 4)), "time": time(5, 6), "inner": Inner((date(2024, 5, 6),)),
        "model": Odd(amount="2.5", tags={"x"}), "enum": Shade.DARK, "bytes": b"abc", "id": UUID(int=1), 7: None, date(2024, 1, 1): 1.5, "deep": [{"s": frozenset({2, 1})}],
    }
    assert json.loads(json.dumps(registry._plain(made))) == {
        "decimal": "1.50", "set": ["a", "b"], "days": ["2024-01-02", "2024-01-02T03:04:00"], "time": "05:06:00", "inner": {"days": ["2024-05-06"]},
        "model": {"amount": "2.5", "tags": ["x"]}, "enum": "dark", "bytes": "abc", "id": "00000000-0000-0000-0000-000000000001", "7": None, "2024-01-01": 1.5, "deep": [{"s": [1, 2]}],
    }


class Seeded(registry.Scraper):
    @registry.entry(dict)
    def by_day(self, day: date, tag: str = "x"):
        yield registry.Follow(f"/d/{day.isoformat()}", self.parse)
        if day.year < 2000:
            raise KeyError("too early")

    @registry.entry(dict)
    def by_number(self, numbers: SpeculativeRange, court: str):
        yield registry.Follow(f"/n/{numbers.min}", self.parse)

    @registry.step(priority=4)
    def parse(self, page):
        yield None


def test_one_bad_invocation_costs_its_row_only(spark):
    rows = [
        (1, "by_day", '{"day": "2024-01-02", "tag": "t"}'), (2, "by_day", '{"day": "1999-01-02", "tag": "t"}'), (3, "by_day", '{"day": 5, "tag": "t"}'), (4, "by_day", None), (5, None, "{}"), (6, "nothing", "{}"), (7, "by_day", "[1]"), (8, "by_day", "{"),
        (9, "by_number", '{"numbers": {"min": 3, "soft_max": 9}, "court": "b"}'), (10, "by_number", '{"numbers": {"min": 0, "soft_max": 9}, "court": "b"}'), (11, "by_number", '{"numbers": {"min": 1, "soft_max": 2, "should_advance": false}, "court": "a"}'), (None, "by_number", '{"numbers": {"min": 2, "soft_max": 2}, "court": "c"}'),
    ]
    df = spark.createDataFrame(rows, "k INT, entry STRING, params STRING").withColumn("payload", F.lit("clash"))
    made = registry.seed_table(df.repartition(3), Seeded, key="k")
    asked, templates, bad = registry.split_seeds(made.cache())
    assert sorted((r["k"], r["url"], r["continuation"], r["priority"]) for r in asked.collect()) == [(1, "/d/2024-01-02", "parse", 4), (2, "/d/1999-01-02", "parse", 4)]
    assert {r["k"]: (r["param_index"], r["min"], r["soft_max"], r["gap"], r["params"]) for r in templates.collect()} == {None: (0, 2, 2, 10, '{"court":"c"}'), 9: (1, 3, 9, 10, '{"court":"b"}'), 11: (2, 1, 2, 0, '{"court":"a"}')}
    errors = {r["k"]: (r["class"], [(e["loc"], e["type"]) for e in r["errors"]]) for r in bad.collect()}
    assert set(errors) == {2, 3, 4, 5, 6, 7, 8, 10} and errors[2] == ("KeyError", [("__root__", "KeyError")]) and errors[6] == errors[5] == ("ConfigError", [("__root__", "unknown_entry")])
    assert errors[4] == ("DataFormatError", [("day", "missing"), ("tag", "missing")]) and errors[8][1] == [("__root__", "json_invalid")] and errors[3][0] == errors[7][0] == errors[10][0] == "DataFormatError"
    assert registry.seed_table(df.filter("false"), Seeded, key="k").collect() == []
