"""Cardinality contracts of selectors, as rows of breaches or as a failure of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import expected_count
from ..plans.grammar import Selector


def check_bounds(least: int, most: int | None) -> None:
    if least < 0 or (most is not None and most < least):
        raise ValueError(f"bounds {least}..{most} are no interval")


def outside(n: Column, least: int, most: int | None) -> Column:
    return (n < least) | (n > most if most is not None else F.lit(False))


def counted(contexts: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """``contexts`` with ``actual_count``, their number of ``matches``; none is 0."""
    n = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual_count"))
    return contexts.join(n, keys, "left").withColumn("actual_count", F.coalesce("actual_count", F.lit(0)))


def violations(contexts: DataFrame, matches: DataFrame, selector: Selector, description: str, least: int = 1, most: int | None = None, *, keys: list[str] | None = None) -> DataFrame:
    """The contexts whose number of matches is out of bounds: their columns, the selector,
    the bounds, the count and a message. ``contexts`` has ``url`` if errors should name it."""
    check_bounds(least, most)
    keys = keys or ["page_id"]
    rows = counted(contexts, matches, keys).filter(outside(F.col("actual_count"), least, most))
    said = F.format_string(f"HTML structure mismatch for '{description}': expected {expected_count(least, most)}, found %d".replace("%d", "%s"), F.col("actual_count").cast("string"))
    return rows.withColumns(
        {
            "class": F.lit("StructureError"),
            "selector": F.lit(selector.value),
            "selector_type": F.lit(selector.grammar),
            "description": F.lit(description),
            "expected_min": F.lit(least),
            "expected_max": F.lit(most).cast("int"),
            "message": said,
        }
    )


def strict(contexts: DataFrame, matches: DataFrame, selector: Selector, description: str, least: int = 1, most: int | None = None, *, keys: list[str] | None = None) -> DataFrame:
    """``contexts`` with their counts; the plan fails at the first breach."""
    check_bounds(least, most)
    rows = counted(contexts, matches, keys or ["page_id"])
    said = F.concat(F.lit(f"StructureError: '{description}' ({selector.value}): expected {expected_count(least, most)}, found "), F.col("actual_count").cast("string"))
    return rows.withColumn("actual_count", F.when(outside(F.col("actual_count"), least, most), F.raise_error(said).cast("bigint")).otherwise(F.col("actual_count")))
