"""Many specs at once: a table of what captured requests should be like, joined to the captures.

A spec is a row, with the meaning of ``incidental.Match``: ``spec_id``, a glob ``url``, ``method``,
``resource_type``, ``query`` and ``headers`` (maps), ``body_text`` (a text that the body has) and
``body_json`` (JSON that the body contains, or has as form data); what is null is not tested.

Each spec is filed under one key that all it matches must have: a query parameter, a header, a
stretch of the letters that its glob spells out, its kind or method; only a spec that
has none of these is held against every capture. Of several such keys a spec is filed under the
one that fewest specs have, and specs that test the same are tested once. A capture has all its
keys, so an equality join finds the few specs worth testing, and one predicate decides, the same for all.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..shipping import series_udf

SPEC = "spec_id STRING, url STRING, method STRING, resource_type STRING, query MAP<STRING, STRING>, headers MAP<STRING, STRING>, body_text STRING, body_json STRING"
TESTED = ("url", "method", "resource_type", "query", "headers", "body_text", "body_json")
#: Letters of a glob that a spec is filed under.
GRAM = 6
#: A spec that has no key.
ANY = "*"


def json_contains(actual: object, wanted: object) -> bool:
    """``incidental.json_column_contains`` for values at hand."""
    if isinstance(wanted, dict):
        return isinstance(actual, dict) and all(k in actual and json_contains(actual[k], v) for k, v in wanted.items())
    if isinstance(wanted, list):
        return isinstance(actual, list) and all(any(json_contains(a, w) for a in actual) for w in wanted)
    if isinstance(wanted, (bool, str)) or wanted is None or isinstance(actual, (bool, str)) or actual is None:
        return type(actual) is type(wanted) and actual == wanted
    return not isinstance(actual, (dict, list)) and actual == wanted


def _body_holds(body: pd.Series, wanted: pd.Series, pairs: pd.Series) -> pd.Series:
    out = []
    for text, spec, form in zip(body, wanted, pairs, strict=True):
        if text is None or spec is None:
            out.append(None)
            continue
        asked = json.loads(spec)
        try:
            found = json_contains(json.loads(text), asked)
        except ValueError:
            found = False
        if not found and isinstance(asked, dict):
            has = {(p["k"], p["v"]) for p in form if p is not None} if form is not None else set()
            found = all(isinstance(v, str) and (k, v) in has for k, v in asked.items())
        out.append(found)
    return pd.Series(out, dtype=object)


def _pattern(glob: pd.Series) -> pd.Series:
    return glob.map(urls.glob_pattern, na_action="ignore")


def _letters(glob: str) -> str:
    """The longest stretch of a glob that stands for itself."""
    best, now, at = "", "", 0
    while at <= len(glob):
        c = glob[at : at + 1]
        if c and c not in "*?[":
            now += c
        else:
            best, now = max(best, now, key=len), ""
            if c == "[":
                shut = glob.find("]", at + 1 + (glob[at + 1 : at + 2] == "!") + 1)
                if shut < 0:
                    # a bracket that is not closed: it and what follows are left out, which is safe
                    break
                at = shut
        at += 1
    return best


def _stretch(glob: pd.Series) -> pd.Series:
    return glob.map(_letters, na_action="ignore")


def invalid(specs: DataFrame) -> DataFrame:
    """An error row for each spec that tests nothing, or whose ``body_json`` is no JSON."""
    nothing = F.forall(F.array(*[_asked(c) for c in TESTED]), lambda x: ~x)
    broken = F.col("body_json").isNotNull() & F.try_parse_json("body_json").isNull()
    said = F.when(nothing, "a match needs at least one field to test").when(broken, "body_json is no JSON")
    return specs.withColumn("message", said).filter("message is not null").select("spec_id", F.lit("ConfigError").alias("class"), "message")


def _asked(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & (F.size(c) > 0 if name in ("query", "headers") else c != "")


def _lowered(headers: Column) -> Column:
    """(k, v) of headers with names in lower case."""
    return F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))


def filed(specs: DataFrame) -> DataFrame:
    """Specs with ``pattern``, a regular expression for the glob, and ``key``."""
    query, headers = F.array_sort(F.map_entries("query")), F.array_sort(_lowered(F.col("headers")))
    stretch = series_udf(_stretch, T.StringType())(F.col("url"))
    rows = specs.withColumns({"pattern": series_udf(_pattern, T.StringType())(F.col("url")), "_stretch": stretch})
    key = F.coalesce(
        F.when(_asked("query"), F.concat(F.lit("q:"), query[0]["key"], F.lit("="), query[0]["value"])),
        F.when(_asked("headers"), F.concat(F.lit("h:"), headers[0]["k"], F.lit("="), headers[0]["v"])),
        F.when(F.length("_stretch") >= GRAM, F.concat(F.lit("u:"), F.substring("_stretch", 1, GRAM))),
        F.when(_asked("resource_type"), F.concat(F.lit("r:"), F.lower("resource_type"))),
        F.when(_asked("method"), F.concat(F.lit("m:"), F.upper("method"))),
        F.lit(ANY),
    )
    return rows.withColumn("key", key).drop("_stretch")


def filed_apart(specs: DataFrame) -> DataFrame:
    """``filed``, but of all query parameters, headers and stretches of letters that a spec's matches must
    have, ``key`` is the one that fewest of ``specs`` have: what all have (a site's name, a campaign)
    would hold each of them against each capture. ``spec_id`` names a row."""
    none = F.expr("cast(array() as array<string>)")
    stretch = series_udf(_stretch, T.StringType())(F.col("url"))
    grams = F.when(F.length("_stretch") >= GRAM, F.transform(F.sequence(F.lit(1), F.greatest(F.length("_stretch") - GRAM + 1, F.lit(1))), lambda k: F.concat(F.lit("u:"), F.substr(F.col("_stretch"), k, F.lit(GRAM)))))
    query = F.transform(F.array_sort(F.map_entries("query")), lambda e: F.concat(F.lit("q:"), e["key"], F.lit("="), e["value"]))
    headers = F.transform(F.array_sort(_lowered(F.col("headers"))), lambda e: F.concat(F.lit("h:"), e["k"], F.lit("="), e["v"]))
    all_ = F.array_compact(F.array_distinct(F.concat(F.array("key"), *[F.coalesce(x, none) for x in (query, headers, grams)])))
    rows = filed(specs)
    may = rows.withColumn("_stretch", stretch).filter(F.substring("key", 1, 2).isin("q:", "h:", "u:")).select("spec_id", F.posexplode(all_).alias("_at", "_key"))
    n = may.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    best = may.join(n, "_key").groupBy("spec_id").agg(F.min_by("_key", F.struct("_n", "_at")).alias("_best"))
    return rows.join(best, "spec_id", "left").withColumn("key", F.coalesce("_best", "key")).drop("_best")


def _keys(url: Column, method: Column, kind: Column, headers: Column) -> Column:
    """All keys under which a spec may be filed that a capture meets."""
    none = F.expr("cast(array() as array<string>)")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(url) - GRAM + 1, F.lit(1))), lambda k: F.concat(F.lit("u:"), F.substr(url, k, F.lit(GRAM))))
    query = F.transform(urls.query_pairs(url), lambda p: F.concat(F.lit("q:"), p["k"], F.lit("="), p["v"]))
    named = F.transform(_lowered(headers), lambda p: F.concat(F.lit("h:"), p["k"], F.lit("="), p["v"]))
    plain = F.array(F.lit(ANY), F.concat(F.lit("r:"), F.lower(F.coalesce(kind, F.lit("")))), F.concat(F.lit("m:"), F.upper(F.coalesce(method, F.lit("")))))
    return F.array_distinct(F.filter(F.concat(plain, F.coalesce(grams, none), F.coalesce(query, none), F.coalesce(named, none)), lambda k: k.isNotNull()))


def _same() -> Column:
    """A name for all that a spec tests."""
    each = {c: F.array_sort(F.map_entries(c)) if c in ("query", "headers") else F.col(c) for c in TESTED}
    return F.sha2(F.to_json(F.struct(*[v.alias(c) for c, v in each.items()])), 256)


def _test(s: str, c: str) -> Column:
    """Whether capture ``c`` is as spec ``s`` says; both name struct columns."""

    def spec(name: str) -> Column:
        return F.col(f"{s}.{name}")

    def open_(name: str, met: Column) -> Column:
        unset = spec(name).isNull() | (F.size(spec(name)) == 0 if name in ("query", "headers") else spec(name) == "")
        return unset | F.coalesce(met, F.lit(False))

    url, body = F.col(f"{c}.url"), F.make_valid_utf8(F.col(f"{c}.body").cast("string"))
    pairs = urls.query_pairs(url)
    query = F.forall(F.map_entries(spec("query")), lambda e: F.exists(pairs, lambda p: (p["k"] == e["key"]) & (p["v"] == e["value"])))
    own = _lowered(F.col(f"{c}.headers"))
    headers = F.forall(F.map_entries(spec("headers")), lambda e: F.coalesce(F.try_element_at(F.filter(own, lambda p: p["k"] == F.lower(e["key"])), F.lit(-1))["v"] == e["value"], F.lit(False)))
    asked = F.when(spec("body_json").isNotNull() & (spec("body_json") != ""), spec("body_json"))
    holds = series_udf(_body_holds, T.BooleanType())(F.when(asked.isNotNull(), body), asked, F.when(asked.isNotNull(), urls.form_pairs(body)))
    return (
        open_("url", F.rlike(url, spec("pattern")))
        & open_("method", F.upper(F.coalesce(F.col(f"{c}.method"), F.lit(""))) == F.upper(spec("method")))
        & open_("resource_type", F.lower(F.coalesce(F.col(f"{c}.resource_type"), F.lit(""))) == F.lower(spec("resource_type")))
        & open_("query", query)
        & open_("headers", headers)
        & open_("body_text", F.contains(body, spec("body_text")))
        & open_("body_json", holds)
    )


def matches(captured: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id`` and the columns of ``captured`` (url, method, resource_type, headers, body among
    them), a row for each capture that a spec fits. Invalid specs fit nothing (``invalid``)."""
    columns = captured.columns
    good = specs.join(invalid(specs).select("spec_id"), "spec_id", "left_anti").withColumn("_same", _same())
    # specs that test the same are one until they have met their captures
    tests = good.dropDuplicates(["_same"]).select(F.col("_same").alias("spec_id"), *TESTED)
    of = filed_apart(tests).select("key", F.struct("spec_id", *TESTED, "pattern").alias("_spec"))
    own = captured.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_capture"))
    keyed = own.withColumn("key", F.explode(_keys(F.col("_capture.url"), F.col("_capture.method"), F.col("_capture.resource_type"), F.col("_capture.headers"))))
    met = keyed.join(of, "key").filter(_test("_spec", "_capture")).select(F.col("_spec.spec_id").alias("_same"), "_capture")
    return met.join(good.select("_same", "spec_id"), "_same").select("spec_id", "_capture.*")


def claims(requests: DataFrame, captured: DataFrame, specs: DataFrame, *, samples: int = 5) -> DataFrame:
    """``request_id, spec_id, actual_count, candidate_urls, error`` of requests (request_id, parent_id,
    spec_id): how many of its parent's captures a request's spec fits. ``specs`` may have
    ``exactly_one`` (true if null or missing): else one match or more is asked for."""
    exactly = F.coalesce(F.col("exactly_one"), F.lit(True)) if "exactly_one" in specs.columns else F.lit(True)
    found = matches(captured.select("parent_id", *[c for c in captured.columns if c != "parent_id"]), specs)
    n = found.groupBy("parent_id", "spec_id").agg(F.count(F.lit(1)).alias("actual_count"))
    first = captured.select("parent_id", "url").distinct().withColumn("_at", F.row_number().over(Window.partitionBy("parent_id").orderBy("url"))).filter(F.col("_at") <= samples)
    had = first.groupBy("parent_id").agg(F.sort_array(F.collect_list("url")).alias("candidate_urls"))
    met = requests.select("request_id", "parent_id", "spec_id").join(n, ["parent_id", "spec_id"], "left").join(specs.select("spec_id", exactly.alias("_one")), "spec_id", "left").join(had, "parent_id", "left")
    count = F.coalesce("actual_count", F.lit(0))
    wrong = F.when(F.col("_one").isNull(), "ConfigError").when(F.when(F.col("_one"), count != 1).otherwise(count < 1), "IncidentalError")
    return met.select("request_id", "spec_id", count.alias("actual_count"), F.when(wrong.isNotNull(), F.col("candidate_urls")).alias("candidate_urls"), wrong.alias("error"))
