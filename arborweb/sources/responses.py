"""What a step reads from a response: JSON, text, the place of a file, captured bytes."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def charset(encoding: str) -> str:
    """A Python encoding's name as Spark knows it."""
    return codecs.lookup(encoding).name.upper().replace("ISO8859-1", "ISO-8859-1").replace("ASCII", "US-ASCII").replace("US-US-", "US-")


def text_of(responses: DataFrame, encoding: str = "utf-8") -> Column:
    """The text, or else the content in ``encoding``; malformed bytes fail the plan."""
    return F.coalesce(F.when(F.col("text") != "", F.col("text")), F.decode("content", charset(encoding)))


def readable_text(responses: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """``responses`` with ``text`` filled and ``error``: content that cannot be decoded is an
    error row, not a failure. UTF-8 only is checked in the JVM."""
    bad = F.coalesce(F.col("text"), F.lit("")) == ""
    if charset(encoding) == "UTF-8":
        bad = bad & ~F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(True))
        found = F.coalesce(F.when(F.col("text") != "", F.col("text")), F.make_valid_utf8(F.col("content").cast("string")))
    else:
        bad, found = F.lit(False), text_of(responses, encoding)
    said = F.when(bad, F.lit(f"Failed to decode content as {encoding}"))
    return responses.withColumn("error", said).withColumn("text", F.when(~bad, found))


def json_of(responses: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """``responses`` with ``json VARIANT`` and ``error`` where the text is no JSON."""
    t = text_of(responses, encoding)
    v = F.try_parse_json(t)
    return responses.withColumn("json", v).withColumn("error", F.when(F.col("json").isNull(), F.lit("Failed to parse JSON")))


def local_path(responses: DataFrame) -> Column:
    """Where an archived file was put; null for other responses."""
    return F.when(F.col("is_archive"), F.col("file_url"))
