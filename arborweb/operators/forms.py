"""Forms of pages: their controls in document order, and the requests that submit them."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import identity, urls
from ..plans.grammar import Binary, Literal, Selector, Union, guess_grammar, own_attribute, read
from ..plans.treequery import query

FIELD = "STRUCT<name: STRING, field_type: STRING, value: STRING, options: ARRAY<STRING>, element_id: STRING>"
CONTROLS = ("input", "button", "select", "textarea")


def controls(nodes: DataFrame, forms: DataFrame, *, key: str = "page_id") -> DataFrame:
    """``page, form (its pre), pre, idx, name, field_type, value, options, element_id`` of what
    each form would submit: one row for a control, several for a multiple select.

    Controls without a name or disabled are left out, as are push and reset buttons and
    boxes that are not checked. A checked box without a value says ``on``; a select
    submits its selected option or else its first, a multiple one each selected option.
    """
    f = forms.select(F.col(key).alias("f_page"), F.col("pre").alias("form"), (F.col("pre") + F.col("size")).alias("f_end"))
    a = F.col("attrs")
    named = nodes.filter(F.col("tag").isin(*CONTROLS) & (F.coalesce(a["name"], F.lit("")) != "") & ~F.map_contains_key(a, "disabled"))
    mine = named.join(f, (F.col(key) == F.col("f_page")) & (F.col("pre") > F.col("form")) & (F.col("pre") <= F.col("f_end")))
    said = F.lower(F.when(F.coalesce(a["type"], F.lit("")) == "", F.when(F.col("tag") == "button", "submit").otherwise("text")).otherwise(a["type"]))
    kind = F.when(F.col("tag").isin("select", "textarea"), F.col("tag")).otherwise(said)
    mine = mine.select(key, "form", "pre", "size", "tag", "attrs", "content", kind.alias("field_type"))
    boxes = F.col("field_type").isin("radio", "checkbox") & (F.col("tag") == "input")
    gone = ((F.col("tag") == "button") & (F.col("field_type") != "submit")) | ((F.col("tag") == "input") & F.col("field_type").isin("reset", "button")) | (boxes & ~F.map_contains_key(a, "checked"))
    mine = mine.filter(~gone)
    value = F.when(F.col("tag") == "textarea", F.coalesce("content", F.lit(""))).when(boxes, F.coalesce(a["value"], F.lit("on"))).otherwise(a["value"])
    none = F.lit(None).cast("array<string>")
    plain = mine.filter("tag <> 'select'").select(key, "form", "pre", F.lit(0).alias("idx"), a["name"].alias("name"), "field_type", value.alias("value"), none.alias("options"), F.when(F.col("tag") == "textarea", F.lit(None)).otherwise(a["id"]).alias("element_id"))

    selects = mine.filter("tag = 'select'").select(F.col(key).alias("s_page"), "form", F.col("pre").alias("s_pre"), (F.col("pre") + F.col("size")).alias("s_end"), a["name"].alias("name"), F.map_contains_key(a, "multiple").alias("multiple"))
    options = nodes.filter("tag = 'option'").select(F.col(key).alias("o_page"), F.col("pre").alias("o_pre"), F.coalesce(a["value"], F.col("content"), F.lit("")).alias("o_value"), F.map_contains_key(a, "selected").alias("o_selected"))
    met = selects.join(options, (F.col("s_page") == F.col("o_page")) & (F.col("o_pre") > F.col("s_pre")) & (F.col("o_pre") <= F.col("s_end")), "left")
    listed = met.groupBy("s_page", "form", "s_pre", "name", "multiple").agg(F.sort_array(F.collect_list(F.when(F.col("o_pre").isNotNull(), F.struct("o_pre", "o_value", "o_selected")))).alias("all"))
    chosen = F.transform(F.filter("all", lambda o: o["o_selected"]), lambda o: o["o_value"])
    every = F.transform("all", lambda o: o["o_value"])
    first = F.coalesce(F.get(chosen, F.lit(0)), F.get(every, F.lit(0)))
    values = F.when(F.col("multiple"), chosen).otherwise(F.array(first))
    picked = listed.select("s_page", "form", "s_pre", "name", every.alias("options"), F.posexplode(values).alias("idx", "value"))
    picked = picked.select(F.col("s_page").alias(key), "form", F.col("s_pre").alias("pre"), "idx", "name", F.lit("select").alias("field_type"), "value", "options", F.lit(None).cast("string").alias("element_id"))
    return plain.unionByName(picked)


def find_forms(nodes: DataFrame, selector: Selector, *, key: str = "page_id") -> DataFrame:
    """``page, form, action, method, fields, selector, selector_type, n_forms, error`` of each
    match, the fields in document order. A page should have one: see ``n_forms``. An action
    that is no URL is null and said in ``error``; such a form submits nothing."""
    found = query(nodes, selector, key=key)
    fields = controls(nodes, found, key=key).groupBy(key, "form").agg(F.sort_array(F.collect_list(F.struct("pre", "idx", F.struct("name", "field_type", "value", "options", "element_id").alias("f")))).alias("fs"))
    a = F.col("attrs")
    action = F.coalesce(a["action"], F.lit(""))
    joined = urls.join(F.col("base"), action)
    met = found.withColumn("n_forms", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn("base", F.col("url")).withColumn("form", F.col("pre")).join(fields, [key, "form"], "left")
    return met.select(
        key,
        "form",
        F.when(action == "", F.col("base")).otherwise(joined).alias("action"),
        F.upper(F.when(F.coalesce(a["method"], F.lit("")) == "", "GET").otherwise(a["method"])).alias("method"),
        F.coalesce(F.transform("fs", lambda x: x["f"]), F.expr(f"cast(array() as array<{FIELD}>)")).alias("fields"),
        F.lit(selector.value).alias("selector"),
        F.lit(selector.grammar).alias("selector_type"),
        F.col("n_forms").cast("int").alias("n_forms"),
        F.when(action != "", urls.unjoined(action, joined)).alias("error"),
    )


def get_field(fields: Column, name: str) -> Column:
    """The first field of a name, or null."""
    return F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))


def submit_predicates(selector: str | Selector | None) -> list[tuple[str, str]]:
    """The id, name and value that a selector asks of the element it finds, in either
    grammar; a text may name its grammar (``css=``, ``xpath=``). Nothing for a selector that
    does not parse, or that finds elements by other means."""
    if selector is None or not str(selector).strip():
        return []
    if isinstance(selector, str):
        grammar, _, rest = selector.strip().partition("=")
        known = grammar in ("css", "xpath")
        selector = Selector.of(rest, grammar) if known else Selector.of(selector.strip(), guess_grammar(selector.strip()))
    try:
        found = read(selector)
    except ConfigError:
        return []
    if not isinstance(found, Union) or len(found.paths) != 1 or not found.paths[0].steps:
        return []
    return [pair for test in found.paths[0].steps[-1].where for pair in _asked(test)]


def _asked(test: object) -> list[tuple[str, str]]:
    """The equalities of an attribute and a text that all of a predicate's matches meet."""
    if not isinstance(test, Binary):
        return []
    if test.op == "and":
        return _asked(test.left) + _asked(test.right)
    name = own_attribute(test.left)
    return [(name, test.right.value)] if test.op == "=" and name in ("id", "name", "value") and isinstance(test.right, Literal) and isinstance(test.right.value, str) else []


def submit_text(selector: str | Selector | None) -> str | None:
    return f"{selector.grammar}={selector.value}" if isinstance(selector, Selector) else selector


def activated(fields: Column, selector: str | Selector | None = None) -> Column:
    """The place in ``fields`` of the submit control that is used, -1 if there is none: the
    first that meets all predicates of ``selector``, else the first."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(fields) - 1, F.lit(0))), lambda i: F.coalesce(F.get(fields, i)["field_type"].isin("submit", "image"), F.lit(False)))
    wanted = submit_predicates(selector)

    def fits(i: Column) -> Column:
        f = F.get(fields, i)
        ok = F.lit(True)
        for attr, v in wanted:
            ok = ok & F.coalesce(f["element_id" if attr == "id" else attr] == v, F.lit(False))
        return ok

    return F.coalesce(F.get(F.filter(places, fits), F.lit(0)), F.get(places, F.lit(0)), F.lit(-1))


def merge_override(default: Column, override: str | list[str | None]) -> Column:
    """A field's values under an override: a text or a full list replaces them; in a list
    with nulls, a null keeps the default at its place, or is dropped where there is none."""
    given = [override] if isinstance(override, str) else list(override)
    if None not in given:
        return F.array(*[F.lit(v) for v in given]).cast("array<string>")
    kept = [F.lit(v) if v is not None else F.get(default, F.lit(i)) for i, v in enumerate(given)]
    return F.filter(F.array(*kept), lambda v: v.isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A column that is used inside a lambda would
    else be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sent(fields: Column, on: Column) -> Column:
    """(k, v) of the fields that are submitted when control ``on`` is."""
    each = F.transform(fields, lambda f, i: F.struct(f["name"].alias("k"), F.coalesce(f["value"], F.lit("")).alias("v"), (~f["field_type"].isin("submit", "image") | (i == on)).alias("goes")))
    return F.filter(each, lambda f: f["goes"])


def _by_name(sent: Column) -> Column:
    """(k, vs) of each name in the order of its first field."""
    names = F.array_distinct(F.transform(sent, lambda f: f["k"]))
    return let(names, lambda ns: F.transform(ns, lambda n: F.struct(n.alias("k"), F.transform(F.filter(sent, lambda f: f["k"] == n), lambda f: f["v"]).alias("vs"))))


def _overridden(values: Column, name: str, override: str | list[str | None]) -> Column:
    def body(vs: Column) -> Column:
        default = F.coalesce(F.get(F.filter(vs, lambda x: x["k"] == name), F.lit(0))["vs"], F.expr("cast(array() as array<string>)"))
        new = F.struct(F.lit(name).alias("k"), merge_override(default, override).alias("vs"))
        there = F.exists(vs, lambda x: x["k"] == name)
        return let(new, lambda n: F.when(there, F.transform(vs, lambda x: F.when(x["k"] == name, n).otherwise(x))).otherwise(F.concat(vs, F.array(n))))

    return let(values, body)


def submit(forms: DataFrame, continuation: str, *, data: Mapping[str | Selector, str | list[str | None]] | None = None, submit_selector: str | Selector | None = None, key: str = "page_id") -> DataFrame:
    """A request for each form. Names keep the order in which they first stand in the form,
    repeated ones have all their values; overrides come in place or, for new names, last.
    POST only if the form says so; a GET carries ``params``, a POST ``data``. Forms whose
    action is no URL make none (their ``error`` says so)."""
    if not continuation:
        raise ValueError("a request needs a continuation")
    values = let(activated(F.col("fields"), submit_selector), lambda on: let(_sent(F.col("fields"), on), _by_name))
    for name, override in (data or {}).items():
        values = _overridden(values, name.value if isinstance(name, Selector) else name, override)
    rows = forms.filter("action is not null").withColumn("_values", values)
    pairs = F.flatten(F.transform("_values", lambda x: F.transform(x["vs"], lambda v: F.struct(x["k"].alias("k"), v.alias("v")))))
    none = F.expr("cast(null as array<struct<k: string, v: string>>)")
    post = F.col("method") == "POST"
    method = F.when(post, "POST").otherwise("GET")
    rows = rows.withColumn("_pairs", pairs).withColumn("_method", method)
    fields_json = F.to_json(F.map_from_entries(F.transform("_values", lambda x: F.struct(x["k"], F.to_json(x["vs"])))))
    via = F.to_json(F.struct(F.lit("form_submit").alias("type"), F.col("selector").alias("form_selector"), "selector_type", F.lit(submit_text(submit_selector)).cast("string").alias("submit_selector"), fields_json.alias("field_data"), F.concat(F.lit("form at "), F.col("selector")).alias("description")), {"ignoreNullFields": "false"})
    params, body = F.when(post, none).otherwise(F.col("_pairs")), F.when(post, F.col("_pairs")).otherwise(none)
    rows = rows.withColumn("params", params).withColumn("data", body)
    return rows.select(
        F.col(key).cast("string").alias("parent_id"),
        F.col("_method").alias("method"),
        F.col("action").alias("url"),
        "params",
        "data",
        F.lit(continuation).alias("continuation"),
        identity.request_key(F.col("_method"), F.col("action"), F.col("params"), F.col("data"), F.lit(None).cast("string")).alias("dedup_key"),
        via.alias("via_json"),
    )


def field_data(pairs: list[tuple[str, str]]) -> str:
    """Pairs as the JSON that provenance keeps: one value as text, several as a list."""
    out: dict[str, list[str]] = {}
    for k, v in pairs:
        out.setdefault(k, []).append(v)
    return json.dumps({k: v[0] if len(v) == 1 else v for k, v in out.items()})
