"""Parsers as table functions: a page in, its validated records out.

A parser declares the records it makes as a pydantic model. Registered under a name it is a
Spark table function, to be called with ``LATERAL`` in SQL or ``lateralJoin``: the columns
come from the model, a row for each record, a record that does not fit its model is a row with
its errors, and so is a page that breaks the parser's code. The same parser works on a string,
on a file and inside a step.
"""

from __future__ import annotations

import json
import types as kinds
import typing
from abc import ABC, abstractmethod
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from decimal import Decimal
from enum import Enum
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AssumptionError, ConfigError
from ..operators.validate import Deferred
from ..shipping import ship
from ..sources.dom import parse
from .page import Page

if TYPE_CHECKING:
    from pydantic import BaseModel

ERRORS = T.ArrayType(T.StructType([T.StructField("loc", T.StringType()), T.StructField("msg", T.StringType()), T.StructField("type", T.StringType())]))
#: What a parser's rows have besides the fields of its records.
ADDED = ("record", "valid", "errors", "raw")
#: Digits of a Decimal field, before and after the point.
DIGITS = (38, 18)

_PLAIN: dict[type, T.DataType] = {str: T.StringType(), bytes: T.BinaryType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), date: T.DateType(), datetime: T.TimestampType(), timedelta: T.DayTimeIntervalType(), Decimal: T.DecimalType(*DIGITS)}


class Parser(ABC):
    """Base of parsers. ``model`` is the record type; a call on a page gives one ``Deferred`` for
    each record, partial or whole, unchecked."""

    model: type[BaseModel]

    @abstractmethod
    def __call__(self, page: Page) -> list[Deferred]: ...

    def deferred(self, page: Page, **data: object) -> Deferred:
        """A record of this parser's model, from ``page``."""
        return Deferred(self.model, page.url, **data)

    @classmethod
    def from_string(cls, html: str | bytes, url: str = "") -> list[Deferred]:
        """The records of markup at hand; bytes are read as they declare."""
        return cls()(Page(parse(html), url))

    @classmethod
    def from_file(cls, path: str | Path, url: str = "") -> list[Deferred]:
        return cls.from_string(Path(path).read_bytes(), url)


def spark_type(kind: object) -> T.DataType:
    """The Spark type that holds a field's checked value: nested models are structs, lists, sets
    and tuples of one type are arrays, mappings with text keys are maps, choices of texts and
    everything else that has a text form are strings."""
    origin, inner = typing.get_origin(kind), typing.get_args(kind)
    if origin is typing.Annotated:
        return spark_type(inner[0])
    if origin in (typing.Union, kinds.UnionType):
        own = {x for x in inner if x is not type(None)}
        found = {spark_type(x).json(): spark_type(x) for x in own}
        return next(iter(found.values())) if len(found) == 1 else T.StringType()
    if origin in (list, set, frozenset) or (origin is tuple and (len(inner) == 2 and inner[1] is Ellipsis)):
        return T.ArrayType(spark_type(inner[0] if inner else str))
    if origin is tuple:
        return T.StructType([T.StructField(f"_{k}", spark_type(x)) for k, x in enumerate(inner, 1)])
    if origin is dict and isinstance(spark_type(inner[0]), T.StringType):
        return T.MapType(T.StringType(), spark_type(inner[1]))
    if isinstance(kind, type):
        if hasattr(kind, "model_fields"):
            return model_type(kind)
        for base, found in _PLAIN.items():
            if kind is base or (issubclass(kind, base) and not issubclass(kind, Enum) and not (base is int and issubclass(kind, bool)) and not (base is date and issubclass(kind, datetime))):
                return found
        if issubclass(kind, Enum):
            values = {type(e.value) for e in kind}
            return spark_type(values.pop()) if len(values) == 1 else T.StringType()
    return T.StringType()


def model_type(model: type[BaseModel]) -> T.StructType:
    """The struct of a record model. Fields are nullable: an invalid record has none of them."""
    return T.StructType([T.StructField(name, spark_type(f.annotation)) for name, f in model.model_fields.items()])


def spark_value(value: object, kind: T.DataType) -> object:
    """A checked value as Spark takes it for a column of ``kind``."""
    if value is None:
        return None
    if isinstance(value, Enum):
        value = value.value
    if isinstance(kind, T.StructType):
        if isinstance(value, (tuple, list)):
            return tuple(spark_value(v, f.dataType) for v, f in zip(value, kind.fields, strict=True))
        return tuple(spark_value(getattr(value, f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        items = sorted(value, key=repr) if isinstance(value, (set, frozenset)) else value
        return [spark_value(v, kind.elementType) for v in items]
    if isinstance(kind, T.MapType):
        return {str(k): spark_value(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.DecimalType):
        return value.quantize(Decimal(1).scaleb(-kind.scale)) if isinstance(value, Decimal) else Decimal(value)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return json.dumps(value, default=_said) if isinstance(value, (dict, list, tuple, set, frozenset)) or hasattr(value, "model_dump") else str(value)
    return value


def _said(value: object) -> object:
    if hasattr(value, "model_dump"):
        return value.model_dump(mode="json")
    return sorted(value, key=repr) if isinstance(value, (set, frozenset)) else str(value)


def _columns(parser: type[Parser]) -> T.StructType:
    fields = model_type(parser.model)
    clash = [f.name for f in fields if f.name.lower() in ADDED]
    if clash:
        raise ConfigError(f"{parser.__name__}: fields {clash} have the names of added columns")
    return T.StructType([T.StructField("record", T.IntegerType()), *fields.fields, T.StructField("valid", T.BooleanType()), T.StructField("errors", ERRORS), T.StructField("raw", T.StringType())])


def rows_of(parser: Parser, columns: T.StructType, html: str | bytes | None, url: str | None) -> Iterator[tuple]:
    """The rows of one page: its records in order from 1, each checked. Null and empty markup has
    none. A page that does not parse, or breaks the parser's code, ends in a row without
    a record number: it has the error alone, and what came before stays."""
    if not html:
        return
    fields = columns.fields[1:-3]
    none = [None] * len(fields)
    number = 0
    try:
        for number, made in enumerate(parser(Page(parse(html), url or "")), 1):
            record, errors = made.checked()
            raw = None if record is not None else json.dumps(made.raw, default=_said)
            yield (number, *([spark_value(getattr(record, f.name), f.dataType) for f in fields] if record is not None else none), record is not None, errors, raw)
    except ConfigError:
        raise
    except Exception as e:  # whatever a page does to the parser's code is the page's error
        kind = "page_parsing" if type(e) is AssumptionError else type(e).__name__
        yield (None, *none, False, [("__root__", e.message if isinstance(e, AssumptionError) else str(e), kind)], None)


def table_function(parser: type[Parser]) -> object:
    """``parser`` as a Spark table function of (html, url). ``analyze`` answers with the columns
    of its record model before anything runs."""
    from pyspark.sql.functions import udtf
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    columns = _columns(parser)

    class Records:
        @staticmethod
        def analyze(html: AnalyzeArgument, url: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not isinstance(html.dataType, (T.StringType, T.BinaryType, T.NullType)):
                raise ConfigError(f"a page is a text or bytes, not {html.dataType.simpleString()}")
            return AnalyzeResult(columns)

        def __init__(self) -> None:
            self.parser = parser()

        def eval(self, html: str | bytes | None, url: str | None = None) -> Iterator[tuple]:
            yield from rows_of(self.parser, columns, html, url)

    return udtf(Records)


def register(spark: SparkSession, parser: type[Parser], name: str | None = None) -> object:
    """Makes ``parser`` known to SQL under ``name``, its own by default:
    ``SELECT p.page_id, r.* FROM pages p, LATERAL name(p.html, p.url) r``."""
    ship(spark)
    made = table_function(parser)
    spark.udtf.register(name or parser.__name__, made)
    return made


def records(pages: DataFrame, parser: type[Parser], *, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """The records of all ``pages``: the key, the columns of ``parser``'s model, and ``record`` (its
    number on the page), ``valid``, ``errors`` and, for those that do not fit, ``raw``."""
    spark = pages.sparkSession
    ship(spark)
    found = table_function(parser)(F.col(html).outer(), F.col(url).outer())
    return pages.select(key, html, url).lateralJoin(found).select(key, *_columns(parser).names)


def split_records(found: DataFrame, *, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(valid records, error rows: key, record, class, message, raw)."""
    bad = found.filter("not valid")
    said = F.array_join(F.transform("errors", lambda e: F.concat(e["loc"], F.lit(": "), e["msg"])), ", ")
    broken = F.col("record").isNull()
    return found.filter("valid").drop("valid", "errors", "raw"), bad.select(key, "record", F.when(broken, "AssumptionError").otherwise("DataFormatError").alias("class"), said.alias("message"), "raw")


def row_of(record: BaseModel) -> Row:
    """A checked record as a Spark row."""
    kind = model_type(type(record))
    return Row(**dict(zip(kind.names, spark_value(record, kind), strict=True)))
