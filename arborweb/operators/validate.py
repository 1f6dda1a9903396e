"""Records held against a declared schema: a typed row if they fit, error rows if not."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataFormatError
from ..shipping import ship

ERRORS = "ARRAY<STRUCT<loc: STRING, msg: STRING, type: STRING>>"


@dataclass(frozen=True)
class Field:
    """A declared field. ``kind``: string, bigint, double, boolean, date or url."""

    name: str
    kind: str = "string"
    required: bool = True
    least: object = None
    most: object = None
    choices: Sequence[str] | None = None


def typed(value: Column, kind: str) -> Column:
    """The value as its kind, null where it is none."""
    if kind == "date":
        return F.try_to_date(value, "yyyy-MM-dd")
    if kind == "url":
        return F.when(F.try_parse_url(value, F.lit("PROTOCOL")).isin("http", "https"), value)
    return value if kind == "string" else F.trim(value).try_cast(kind)


def errors_of(fields: Sequence[Field], value: dict[str, Column]) -> Column:
    """All errors of a record, in the order of its fields."""

    def error(f: Field, msg: str, kind: str) -> Column:
        return F.struct(F.lit(f.name).alias("loc"), F.lit(msg).alias("msg"), F.lit(kind).alias("type"))

    found = []
    for f in fields:
        v = value[f.name]
        t = typed(v, f.kind)
        if f.required:
            found.append(F.when(v.isNull(), error(f, "Field required", "missing")))
        found.append(F.when(v.isNotNull() & t.isNull(), error(f, f"Input should be a valid {f.kind}", f"{f.kind}_parsing")))
        if f.least is not None:
            found.append(F.when(t < F.lit(f.least), error(f, f"Input should be greater than or equal to {f.least}", "greater_than_equal")))
        if f.most is not None:
            found.append(F.when(t > F.lit(f.most), error(f, f"Input should be less than or equal to {f.most}", "less_than_equal")))
        if f.choices is not None:
            found.append(F.when(~t.isin(*f.choices), error(f, f"Input should be one of {', '.join(f.choices)}", "enum")))
    return F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.expr(f"cast(array() as {ERRORS})")


def validate(records: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """``records`` with each field as its kind, ``valid`` and ``errors``. Fields that the table
    lacks are null. Nothing fails the plan."""
    raw = {f.name: F.col(f.name).cast("string") if f.name in records.columns else F.lit(None).cast("string") for f in fields}
    kept = [c for c in records.columns if c not in raw]
    rows = records.select(*kept, errors_of(fields, raw).alias("errors"), *[typed(raw[f.name], f.kind).alias(f.name) for f in fields])
    return rows.withColumn("valid", F.size("errors") == 0).select(*kept, *raw, "valid", "errors")


def summary(errors: Column) -> Column:
    """``loc: msg`` of all errors, joined."""
    return F.array_join(F.transform(errors, lambda e: F.concat(e["loc"], F.lit(": "), e["msg"])), ", ")


def validate_model(records: DataFrame, model: type, *, data: str = "data") -> DataFrame:
    """Records in the JSON column ``data`` held against a pydantic model, whose own validators
    run in Arrow batches: ``model``, ``valid``, ``errors`` and the checked ``data`` are added."""
    ship(records.sparkSession)
    at = records.columns.index(data)
    keep = [c for c in records.columns if c not in ("valid", "errors", "model", data)]
    places = [records.columns.index(c) for c in keep]
    kind = pa.list_(pa.struct([("loc", pa.string()), ("msg", pa.string()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, valid, errors = [], [], []
            for raw in batch.column(at).to_pylist():
                out, found = check(model, raw)
                texts.append(out)
                valid.append(not found)
                errors.append(found)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(p) for p in places), pa.array([model.__name__] * n, pa.string()), pa.array(texts, pa.string()), pa.array(valid, pa.bool_()), pa.array(errors, kind)], names=[*keep, "model", data, "valid", "errors"])

    schema = T.StructType([records.schema[c] for c in keep] + T.StructType.fromDDL(f"model STRING, {data} STRING, valid BOOLEAN, errors {ERRORS}").fields)
    return records.mapInArrow(run, schema)


def check(model: type, raw: str | None) -> tuple[str | None, list[dict]]:
    """(the record as the model writes it, errors); with errors the record as it came."""
    from pydantic import ValidationError

    try:
        return model.model_validate(json.loads(raw) if raw else {}).model_dump_json(), []
    except ValidationError as e:
        return raw, error_rows(e)
    except ValueError as e:
        return raw, [{"loc": "__root__", "msg": str(e), "type": "json_invalid"}]


def error_rows(e: object) -> list[dict]:
    """A pydantic ``ValidationError`` as rows of ``ERRORS``: paths joined by points."""
    return [{"loc": ".".join(map(str, x["loc"])) or "__root__", "msg": x["msg"], "type": x["type"]} for x in e.errors()]


class Deferred:
    """A record whose check is put off: ``confirm()`` gives the model or raises, ``raw`` is
    a copy of what came."""

    def __init__(self, model: type, url: str = "", **data: object):
        self.model, self.url, self._data = model, url, data

    @property
    def raw(self) -> dict:
        return dict(self._data)

    @property
    def model_name(self) -> str:
        return self.model.__name__

    def confirm(self) -> object:
        from pydantic import ValidationError

        try:
            return self.model(**self._data)
        except ValidationError as e:
            raise DataFormatError(self.model_name, error_rows(e), self.url) from e

    def checked(self) -> tuple[object | None, list[tuple[str, str, str]]]:
        """(the model, no errors), or (None, what does not fit as loc, msg, type)."""
        try:
            return self.confirm(), []
        except DataFormatError as e:
            return None, [(x["loc"], x["msg"], x["type"]) for x in e.errors]


@dataclass(frozen=True)
class DateRange:
    """Days from ``start`` to ``end``, both included."""

    start: date
    end: date

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError("end must not be before start")

    def test(self, column: Column) -> Column:
        return column.between(F.lit(self.start), F.lit(self.end))
