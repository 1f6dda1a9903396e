"""Identity and provenance of requests: deduplication keys and the JSON of a link or form."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grammar import Selector, guess_grammar
from ..shipping import series_udf


def key_text(method: str, url: str, params: object = None, data: object = None, body: object = None) -> str:
    """What a key is a digest of: method and URL, sorted parameters, sorted data, JSON body.

    A mapping is sorted by name, a sequence by the text of its entries, so their order
    never matters; bytes and streams count by content.
    """

    def said(x: object) -> str:
        if isinstance(x, dict):
            return str(sorted(x.items()))
        if isinstance(x, (list, tuple)):
            return str(sorted(x, key=repr))
        if hasattr(x, "read"):
            if not x.seekable():
                return str(x)
            at = x.tell()
            content = x.read()
            x.seek(at)
            return str(content)
        return str(x)

    head = f"{method} {url}" + (f"?{said(params)}" if params else "")
    tail = said(data) if data else ""
    if body is not None:
        tail += "|" + json.dumps(body, sort_keys=isinstance(body, dict))
    return f"{head}|{tail}"


def dedup_key(method: str, url: str, params: object = None, data: object = None, body: object = None) -> str:
    return hashlib.sha256(key_text(method, url, params, data, body).encode("utf-8")).hexdigest()


def bare_key(method: Column, url: Column) -> Column:
    """The key of requests without parameters, data and body, in the JVM."""
    return F.sha2(F.concat(method, F.lit(" "), url, F.lit("|")), 256)


def _gathered(pairs: object) -> dict[str, object] | None:
    """Pairs as a mapping; a repeated name has the list of its values."""
    if pairs is None or not len(pairs):
        return None
    out: dict[str, object] = {}
    for p in pairs:
        k, v = p["k"], p["v"]
        if k not in out:
            out[k] = v
        elif isinstance(out[k], list):
            out[k].append(v)
        else:
            out[k] = [out[k], v]
    return out


def _full_keys(method: pd.Series, url: pd.Series, params: pd.Series, data: pd.Series, body: pd.Series) -> pd.Series:
    rows = zip(method, url, params, data, body, strict=True)
    return pd.Series([None if u is None else dedup_key(m, u, _gathered(p), _gathered(d), None if b is None else json.loads(b)) for m, u, p, d, b in rows], dtype=object)


#: Texts that the key's text quotes as they are.
_PLAIN = r"^[ -&(-\[\]-~]*$"


def _plain_pairs(pairs: Column) -> Column:
    """Whether pairs have different names and need no escapes, so that ``_said`` can spell them."""
    known = F.coalesce(pairs, F.expr("cast(array() as array<struct<k: string, v: string>>)"))
    names = F.transform(known, lambda p: p["k"])
    return (F.size(F.array_distinct(names)) == F.size(names)) & F.forall(known, lambda p: F.coalesce(p["k"].rlike(_PLAIN) & p["v"].rlike(_PLAIN), F.lit(False)))


def _said(pairs: Column) -> Column:
    """``key_text``'s spelling of a mapping, sorted by name; nothing for none."""
    each = F.transform(F.array_sort(pairs), lambda p: F.concat(F.lit("('"), p["k"], F.lit("', '"), p["v"], F.lit("')")))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))).otherwise("")


def request_key(method: Column, url: Column, params: Column, data: Column, body: Column) -> Column:
    """The key of each request row. Only rows with a JSON body, repeated names or characters
    that need escapes leave the JVM."""
    asked = _said(params)
    text = F.concat(method, F.lit(" "), url, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""), F.lit("|"), _said(data))
    plain = _plain_pairs(params) & _plain_pairs(data) & body.isNull()
    return F.when(plain, F.sha2(text, 256)).otherwise(series_udf(_full_keys, T.StringType())(method, url, params, data, body))


def link_json(selector: Column, grammar: Column, description: Column) -> Column:
    return F.to_json(F.struct(F.lit("link").alias("type"), selector.alias("selector"), grammar.alias("selector_type"), description.alias("description")))


def via_json(via: dict) -> str:
    """A link's or form's provenance as stored: ``type``, then its fields."""
    return json.dumps(via)


def link_via(selector: Selector, description: str) -> dict:
    return {"type": "link", "selector": selector.value, "selector_type": selector.grammar, "description": description}


def form_via(selector: Selector, submit: str | None, fields: dict, description: str) -> dict:
    return {"type": "form_submit", "form_selector": selector.value, "selector_type": selector.grammar, "submit_selector": submit, "field_data": fields, "description": description}


def read_via(raw: str) -> dict:
    """The inverse of ``via_json``. Rows without ``selector_type`` get it from the selector's
    first characters; an unknown type is a ``ValueError``."""
    said = json.loads(raw)
    kind = said.get("type")
    if kind not in ("link", "form_submit"):
        raise ValueError(f"unknown via type {kind!r}")
    name = "selector" if kind == "link" else "form_selector"
    selector = Selector.of(said[name], said.get("selector_type") or guess_grammar(said[name]))
    return link_via(selector, said["description"]) if kind == "link" else form_via(selector, said.get("submit_selector"), said["field_data"], said["description"])


VIA = "type STRING, selector STRING, form_selector STRING, selector_type STRING, submit_selector STRING, field_data STRING, description STRING"


def via_columns(raw: Column) -> Column:
    """``read_via`` over rows, as one struct with the fields of both kinds."""
    v = F.from_json(raw, VIA)
    name = F.coalesce(v["selector"], v["form_selector"])
    guessed = F.when(name.rlike(r"^(//|\./|\()"), "xpath").otherwise("css")
    kind = F.when(v["type"].isin("link", "form_submit"), v["type"]).otherwise(F.raise_error(F.concat(F.lit("unknown via type "), F.coalesce(v["type"], F.lit("null")))))
    return F.when(raw.isNotNull(), F.struct(kind.alias("type"), name.alias("selector"), F.coalesce(v["selector_type"], guessed).alias("selector_type"), v["submit_selector"].alias("submit_selector"), v["field_data"].alias("field_data"), v["description"].alias("description")))
