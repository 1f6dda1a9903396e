"""Links of pages as rows, and the requests that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, urls
from ..plans.grammar import Selector
from ..plans.treequery import needed_tags, query
from ..sources import dom
from .contracts import check_bounds, violations


def links(nodes: DataFrame, selector: Selector, contexts: DataFrame | None = None, *, key: str = "page_id") -> DataFrame:
    """``page, ctx, pos, href, url, text, selector, selector_type, error`` of each match, in
    document order; ``pos`` counts all matches, also those without a href. A href that is no
    URL has a null ``url`` and says so in ``error``. ``nodes`` have ``url`` and the content of
    what is matched."""
    found = query(nodes, selector, contexts, key=key)
    parts = _around_place(selector)
    found = found.withColumn("_joined", urls.join(F.col("url"), F.col("attrs")["href"]))
    return found.select(
        key,
        "ctx",
        "pos",
        F.col("attrs")["href"].alias("href"),
        F.col("_joined").alias("url"),
        F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)^\s+|\s+$", "").alias("text"),
        F.concat(F.lit(parts[0]), F.col("pos").cast("string"), F.lit(parts[1])).alias("selector"),
        F.lit(selector.grammar).alias("selector_type"),
        urls.unjoined(F.col("attrs")["href"], F.col("_joined")).alias("error"),
    )


def _around_place(selector: Selector) -> tuple[str, str]:
    """What stands before and after the place in the selector of one match."""
    one, two = selector.nth(1).value, selector.nth(22).value
    # both say the same but for the number: it begins where they part
    at = next(k for k, (a, b) in enumerate(zip(one, two, strict=False)) if a != b)
    return one[:at], one[at + 1 :]


def bad_links(found: DataFrame, *, key: str = "page_id") -> DataFrame:
    """An error row for each link whose href is no URL."""
    return found.filter("error is not null").select(key, "ctx", "pos", F.lit("AssumptionError").alias("class"), F.col("error").alias("message"))


def find_links(pages: DataFrame, selector: Selector, *, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """``links`` straight from pages. A selector of one filtered step needs its own tags
    only: nothing else leaves the parser, and there is no join."""
    tags = needed_tags(selector)
    return links(dom.shred(pages, key=key, html=html, url=url, tags=tags, content=tags), selector, key=key)


def missing_href(found: DataFrame, description: str, *, key: str = "page_id") -> DataFrame:
    """A breach for each context with a match that has no href; the count is of the links
    before the first one."""
    bare = found.filter("href is null or href = ''").groupBy(key, "ctx").agg((F.min("pos") - 1).alias("actual_count"))
    return bare.withColumn("class", F.lit("StructureError")).withColumn("description", F.lit(f"{description} missing href"))


def link_violations(pages: DataFrame, found: DataFrame, selector: Selector, description: str, least: int = 1, most: int | None = None, *, key: str = "page_id") -> DataFrame:
    """All breaches of a set of links: too few matches, a match without href, too many links."""
    check_bounds(least, most)
    counts = violations(pages.select(key), found, selector, description, least, most, keys=[key]).select(key, "class", "description", "actual_count")
    return counts.unionByName(missing_href(found, description, key=key).select(key, "class", "description", "actual_count"))


def follow(found: DataFrame, continuation: str, *, key: str = "page_id", priority: int | None = None) -> DataFrame:
    """A GET request for each link: parent, URL, deduplication key and provenance. Links whose
    href is no URL are left to ``bad_links``."""
    if not continuation:
        raise ValueError("a request needs a continuation")
    via = identity.link_json(F.col("selector"), F.col("selector_type"), F.concat(F.lit("link: "), F.col("text")))
    return found.filter("href is not null and href <> '' and url is not null").select(
        F.col(key).cast("string").alias("parent_id"),
        F.lit("GET").alias("method"),
        "url",
        F.lit(continuation).alias("continuation"),
        F.lit(priority).cast("int").alias("priority"),
        identity.bare_key(F.lit("GET"), F.col("url")).alias("dedup_key"),
        via.alias("via_json"),
    )
