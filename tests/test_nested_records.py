"""Models compiled to columns against the models themselves."""

import json
import random
from datetime import date
from typing import Annotated, Literal, Optional

from annotated_types import Gt
from pydantic import BaseModel, Field, field_validator
from pyspark.sql import functions as F

from arborweb.operators import validate
from arborweb.plans import records


class Inner(BaseModel):
    size: int = Field(gt=0, le=100)
    share: Optional[float] = None
    name: str = Field(default="none", min_length=2, max_length=5)


class Outer(BaseModel):
    key: int
    ok: bool = True
    state: Literal["a", "b"]
    day: date | None = None
    parts: list[Inner] = Field(min_length=1)
    one: Inner | None = None
    rates: list[list[Annotated[float, Gt(0)]]] = []


class Coded(BaseModel):
    key: int
    tag: str

    @field_validator("tag")
    @classmethod
    def known(cls, v):
        if v != "x":
            raise ValueError("not x")
        return v


SCALARS = [0, 1, -3, 5, 99, 101, 2**40, 2**63, -(2**63), 10**30, 1.0, 2.5, -0.5, 1e300, True, False, None, "", "a", "b", "ab", "abcdef", "é\U0001f600", "5", " 7 ", "1.0", "true", "2024-02-29", "2023-02-29", "0000-01-01", "2024-1-5", "2024-01-05T00:00:00", "1704067200", "nan", [], {}, [1], {"size": 1}]


def drawn(draw, odd=0.12):
    """A record with, here and there, a value of another kind, a missing or an unknown field."""

    def value(right):
        return draw.choice(SCALARS) if draw.random() < odd else right

    def inner():
        return strip({"size": value(draw.randint(-3, 110)), "share": value(draw.random()), "name": value(draw.choice(["x", "xy", "xyz", "toolong"])), "more": 1})

    def strip(d):
        return {k: v for k, v in d.items() if draw.random() > odd}

    return strip({"key": value(draw.randint(0, 9)), "ok": value(True), "state": value(draw.choice("abc")), "day": value("2024-02-29"), "parts": value([value(inner()) for _ in range(draw.randint(0, 3))]), "one": value(inner()), "rates": value([value([value(0.5), value(-1.0)]), value([])]), 'odd "key"': 1})


def told(df):
    return {r["k"]: (r["valid"], [tuple(e) for e in r["errors"]]) for r in df.collect()}


def test_columns_say_what_the_model_says(spark):
    draw = random.Random(3)
    texts = [json.dumps(drawn(draw, odd)) for odd in (0.0, 0.02, 0.12, 0.4) for _ in range(250)]
    texts += [None, "", "{}", "[]", "3", "null", "{", '{"key": 1, "key": 2}', '{"key": NaN}', '{"key": 1, "state": "\\ud800", "parts": []}', '{"state": "a", "key": 1e400, "parts": [{"size": 1, "share": 1e400}]}', '{"key": 12345678901234567890123456789012345678901234567890, "state": "a", "parts": [{"size": 7}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "k INT, data STRING").repartition(4)
    got, want = told(records.validate_nested(df, Outer)), told(validate.validate_model(df, Outer))
    assert got == want
    assert {ok for ok, _ in want.values()} == {True, False} and len({e[2] for _, es in want.values() for e in es}) > 15
    # records of plain values never leave the JVM, whether they fit or not
    plain = spark.createDataFrame(list(enumerate(texts[:250])), "k INT, data STRING")
    n_odd = records.odd_records(plain, Outer).count()
    assert n_odd == sum(1 for t in texts[:250] if not json.loads(t)["parts"])


def test_the_record_is_typed(spark):
    text = json.dumps({"key": 7, "state": "b", "day": "2024-02-29", "parts": [{"size": 3, "share": 1}], "rates": [[0.5], []]})
    df = spark.createDataFrame([(1, text, "x"), (2, text.replace("7", '"7"'), "x"), (3, "{}", "x")], "k INT, data STRING, checked STRING")
    out = records.validate_nested(df, Outer)
    assert out.columns == ["k", "data", "checked", "record", "valid", "errors"] and out.schema["record"].dataType["parts"].dataType.elementType["size"].dataType.simpleString() == "bigint"
    rows = {r["k"]: r["record"] for r in out.collect()}
    assert rows[1] == rows[2] and rows[3] is None
    assert (rows[1]["key"], rows[1]["ok"], rows[1]["day"], rows[1]["parts"][0]["share"], rows[1]["parts"][0]["name"], rows[1]["rates"], rows[1]["one"]) == (7, True, date(2024, 2, 29), 1.0, "none", [[0.5], []], None)
    assert records.validate_nested(df.limit(0), Outer).count() == 0


def test_code_of_a_model_is_run(spark):
    df = spark.createDataFrame([(1, '{"key": 1, "tag": "x"}'), (2, '{"key": 1, "tag": "y"}'), (3, '{"tag": "x"}')], "k INT, data STRING")
    assert told(records.validate_nested(df, Coded)) == told(validate.validate_model(df, Coded))
    assert records.odd_records(df, Coded).count() == 3


class Line(BaseModel):
    number: int = Field(gt=0)
    share: float = Field(le=50)


class Plain(BaseModel):
    key: int
    state: Literal["a", "b"]
    day: date
    on: bool
    name: str = Field(min_length=2, max_length=4)
    lines: list[Line]
    rates: list[list[float]]


def test_plain_records_need_no_rule_a_value(spark, monkeypatch):
    """A rule was run for each value of each record: the rules are here of another model, and still all is
    right, as plain records do not ask them."""
    draw = random.Random(8)

    def line():
        return {"share": draw.choice([1, 2.5, 50, 51, 1e20, 60.25]), "number": draw.randint(0, 3)}

    def record():
        return {"on": draw.random() < 0.5, "lines": [line() for _ in range(draw.randint(0, 4))], "name": draw.choice(["x", "xy", "toolong"]), "rates": draw.choice([[], [[]], [[1, 2.5], []]]), "key": draw.randint(0, 9), "day": "2024-02-29", "state": draw.choice("ab")}

    def spoilt(r):
        at, what = draw.choice([(r, k) for k in r] + [(x, k) for x in r["lines"] for k in x] + [(r["rates"], k) for k in range(len(r["rates"]))]), draw.choice([*SCALARS, ...])
        where, k = at
        if what is ... and isinstance(where, dict):
            del where[k]
        else:
            where[k] = None if what is ... else what
        return r | ({"more": 1} if draw.random() < 0.1 else {})

    plain, odd = [record() for _ in range(200)], [spoilt(record()) for _ in range(600)]
    frame = lambda rows: spark.createDataFrame(list(enumerate(map(json.dumps, rows))), "k INT, data STRING").repartition(4)
    for rows in (plain, odd):
        df = frame(rows)
        got, want = records.validate_nested(df, Plain), validate.validate_model(df, Plain)
        assert told(got) == told(want)
        for r in [r for r in got.collect() if r["valid"]]:
            own = Plain.model_validate(rows[r["k"]])
            whole = r["record"].asDict(True)
            assert whole == own.model_dump() or abs(own.key) >= 2**63
    monkeypatch.setattr(records, "compiled", lambda model: records._odd(model))
    monkeypatch.setattr(records, "check", lambda model, text: (None, []))
    assert {k: e for k, (_, e) in told(records.validate_nested(frame(plain), Plain)).items()} == {k: e for k, (_, e) in told(validate.validate_model(frame(plain), Plain)).items()}
