"""What selectors found: counts and samples by query, as rows, trees and JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

SAMPLES = 3
SAMPLE_CHARS = 100


def sample(text: Column, most: int = SAMPLE_CHARS) -> Column:
    """White space made single, long text cut."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def roll_up(matches: DataFrame, keys: list[str], *, samples: int = SAMPLES) -> DataFrame:
    """``keys, match_count, sample_elements`` of matches (keys, seq, text): a query made again
    under the same parent adds to the first. Each task keeps ``samples`` texts only, so a
    query with any number of matches stays small."""
    one = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("match_count"))
    first = matches.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).filter(F.col("_at") <= samples)
    texts = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", sample(F.col("text")).alias("t")))).alias("_s"))
    return one.join(texts, keys, "left").withColumn("sample_elements", F.transform("_s", lambda s: s["t"])).drop("_s")


def status(n: Column, least: Column, most: Column) -> Column:
    return F.when((n < least) | F.coalesce(n > most, F.lit(False)), "✗").otherwise("✓")


def line(n: Column, least: Column, most: Column, selector: Column, description: Column) -> Column:
    """A query as one line: selector, description, whether its count is as expected."""
    said = F.concat(n.cast("string"), F.when(n == 1, " match").otherwise(" matches"), F.when(n < least, F.concat(F.lit(", expected "), least.cast("string"), F.lit("+"))).when(F.coalesce(n > most, F.lit(False)), F.concat(F.lit(", expected max "), most.cast("string"))).otherwise(""))
    return F.concat(selector, F.lit(' "'), description, F.lit('" '), status(n, least, most), F.lit(" ("), said, F.lit(")"))


QUERY = "request_id STRING, element_id STRING, parent_element_id STRING, selector STRING, selector_type STRING, description STRING, match_count BIGINT, expected_min INT, expected_max INT, sample_elements ARRAY<STRING>"


def _children(rows: list[dict]) -> dict[str | None, list[dict]]:
    known = {r["element_id"] for r in rows}
    out: dict[str | None, list[dict]] = {}
    for r in sorted(rows, key=lambda r: int(r["element_id"].rpartition("_")[2])):
        out.setdefault(r["parent_element_id"] if r["parent_element_id"] in known else None, []).append(r)
    return out


def tree_lines(rows: list[dict]) -> Iterable[str]:
    """The queries of one request as an indented tree, the first sample under each."""
    below = _children(rows)

    def walk(parent: str | None, depth: int) -> Iterable[str]:
        for r in below.get(parent, []):
            yield "  " * depth + "- " + r["line"]
            if r["match_count"] and len(r["sample_elements"] or ()) and r["sample_elements"][0]:
                yield "  " * (depth + 1) + f'→ "{r["sample_elements"][0]}"'
            yield from walk(r["element_id"], depth + 1)

    return walk(None, 0)


def query_dicts(rows: list[dict]) -> list[dict]:
    """The queries of one request as nested mappings, without links to their parents."""
    below = _children(rows)
    names = ("selector", "selector_type", "description", "match_count", "expected_min", "expected_max", "sample_elements", "element_id", "parent_element_id")

    def one(r: dict) -> dict:
        return {n: r[n] for n in names} | {"children": [one(c) for c in below.get(r["element_id"], [])]}

    return [one(r) for r in below.get(None, [])]


def absolute_text(chain: list[tuple[str, str]]) -> str | None:
    """The selectors from the root down to a query as one; None if grammars are mixed."""
    if len({grammar for grammar, _ in chain}) > 1:
        return None
    if chain[0][0] == "css":
        return " ".join(s for _, s in chain)
    out = chain[0][1]
    for _, s in chain[1:]:
        out += s[1:] if s.startswith(".") else f"//{s}"
    return out


def _of_requests(queries: DataFrame, columns: list[str], run: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``run`` gives for the queries of each request. A request's queries are as
    many as its step's code has, whatever the page; they are brought together in the JVM, and
    batches of requests go through Python."""
    ship(queries.sparkSession)
    whole = queries.groupBy("request_id").agg(F.collect_list(F.struct(*columns)).alias("q"))
    kinds = T.StructType.fromDDL(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(k, *row) for k, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in run(q)]
            columns = list(zip(*made, strict=True)) if made else [[]] * (len(kinds) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["request_id", *kinds.names])

    return whole.mapInArrow(rows, T.StructType([queries.schema["request_id"], *kinds.fields]))


def render(queries: DataFrame) -> DataFrame:
    """``request_id, tree, json`` of selector queries."""
    n, least, most = F.col("match_count"), F.col("expected_min"), F.col("expected_max")
    rows = queries.withColumn("line", line(n, least, most, F.col("selector"), F.col("description")))

    def run(own: list[dict]) -> Iterable[tuple]:
        yield "\n".join(tree_lines(own)), json.dumps(query_dicts(own), ensure_ascii=False)

    return _of_requests(rows, [c for c in rows.columns if c != "request_id"], run, "tree STRING, json STRING")


def absolute_selectors(queries: DataFrame) -> DataFrame:
    """``request_id, element_id, absolute_selector`` of each query."""

    def run(own: list[dict]) -> Iterable[tuple]:
        by = {r["element_id"]: r for r in own}
        for r in own:
            chain, at = [], r
            while at is not None:
                chain.append((at["selector_type"], at["selector"]))
                at = by.get(at["parent_element_id"])
            yield r["element_id"], absolute_text(chain[::-1])

    return _of_requests(queries, ["element_id", "parent_element_id", "selector", "selector_type"], run, "element_id STRING, absolute_selector STRING")
