"""URLs: joining, requoting, query parameters, globs. Built-in functions where they have
the meaning, Arrow functions where the rules of RFC 3986 are needed."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import series_udf

# Characters that are never escaped, and those that a whole URL keeps as they are.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
KEPT = frozenset(UNRESERVED + "!#$%&'()*+,/:;=?@[]~")

_escape = re.compile(r"%([0-9A-Fa-f]{2})?")
_plain = re.compile(r"[^\x00-\x20\x7f-\U0010ffff\"<>\\^`{|}]*\Z")


def requote_text(url: str) -> str:
    """Escapes of unreserved characters decoded, other escapes kept, a stray ``%`` and all
    characters that may not stand in a URL escaped. Doing it twice changes nothing."""

    def settled(m: re.Match) -> str:
        if m[1] is None:
            return "%25"
        c = chr(int(m[1], 16))
        return c if c in UNRESERVED else m[0]

    url = _escape.sub(settled, url)
    if _plain.match(url):
        return url
    return "".join(c if c in KEPT else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def _requoted(url: pd.Series) -> pd.Series:
    return url.map(requote_text, na_action="ignore")


def requote(url: Column | str) -> Column:
    return series_udf(_requoted, T.StringType())(url)


def join_text(base: str | None, url: str | None) -> str | None:
    """``url`` as seen from ``base``; None for none, and where the two make no URL."""
    try:
        return None if url is None else urljoin(base or "", url)
    except ValueError:
        return None


def _joined(base: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([join_text(b, u) for b, u in zip(base, url, strict=True)], dtype=object)


def _join(base: Column, url: Column) -> Column:
    return series_udf(_joined, T.StringType())(base, url)


#: A path without dot segments, and a base with a host, join without Python.
_ROOTED = r"^/(?!/)(?!.*(?:^|/)\.\.?(?:[/?#]|$)).*$"


def join(base: Column, url: Column) -> Column:
    """``url`` as seen from ``base``; null where the two make no URL (``unjoined``). Absolute
    http URLs and plain rooted paths are joined in the JVM: Python sees a null for each."""
    site = F.regexp_extract(base, r"^(https?://[^/?#\[\]]+)", 1)
    whole = url.rlike(r"^https?://[^/?#\[\]]+/[^?#.]*$")
    rooted = (site != "") & url.rlike(_ROOTED)
    odd = F.when(whole | rooted, F.lit(None)).otherwise(url)
    return F.when(whole, url).when(rooted, F.concat(site, url)).otherwise(_join(base, odd))


def unjoined(url: Column, joined: Column) -> Column:
    """What went wrong with a URL that could not be joined, null if it could."""
    return F.when(url.isNotNull() & joined.isNull(), F.concat(F.lit("Not a URL: "), url))


def resolve(location: Column, url: Column) -> Column:
    """A request's URL from where it was found: requoted, then joined; null where that is none."""
    return _join(location, requote(url))


def query_pairs(url: Column) -> Column:
    """The query's (key, value) pairs in order; blank values are left out."""
    return form_pairs(F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit("")))


def form_pairs(text: Column) -> Column:
    """(key, value) pairs of form-encoded text; blank values are left out."""
    parts = F.filter(F.split(text, "&"), lambda p: p.rlike("^[^=]*=."))

    def pair(p: Column) -> Column:
        key = F.regexp_extract(p, "^([^=]*)=", 1)
        value = F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)
        return F.struct(_decoded(key).alias("k"), _decoded(value).alias("v"))

    return F.transform(parts, pair)


def _decoded(c: Column) -> Column:
    """Form-decoded; text with a broken escape stays as it is but for ``+``."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def glob_pattern(glob: str) -> str:
    """A case-sensitive glob as a regular expression for the whole text; ``*`` spans ``/``."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            shut = glob.find("]", at + 1 + (glob[at : at + 1] == "!"))
            if shut < 0:
                out.append(r"\[")
                continue
            inside = glob[at:shut].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            at = shut + 1
            out.append(f"[^{inside[1:]}]" if inside[0] == "!" else f"[{chr(92) if inside[0] == '^' else ''}{inside}]")
        else:
            out.append(re.escape(c))
    return f"^(?s:{''.join(out)})$"


def matches_glob(text: Column, glob: str) -> Column:
    return text.rlike(glob_pattern(glob))


def pairs_of(text: str) -> list[tuple[str, str]]:
    return parse_qsl(text)
