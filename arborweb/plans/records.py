"""Record models compiled to columns: nested JSON held against a pydantic model in the JVM.

A model becomes a Spark type (``parsers.model_type``) and, for each of its fields, rules over the
parsed variant: what kind a value has, its bounds, the choices of a literal, the items of a
list, the fields of a model within. Errors have the paths, texts and types that the model
itself gives: texts are taken from it when the rules are made, by showing it a value that
breaks the rule.

Rules decide what is plain. What a model would convert (a number in a text, a date with a time, a
whole number written 5.0), checks by code of its own (validators, odd types, patterns), or
what no variant holds (malformed JSON, numbers past 64 bits, half surrogates) is odd: such a record,
and no other, is given to the model itself, in Arrow batches. So results are the model's for
every record, and Python sees only those that need it.

Most records need no rule a value: the type of the whole variant says that each value is of the kind
that is asked for, one cast reads them all, and only limits are tested (``_typed``). The rules above
are for the others.
"""

from __future__ import annotations

import re
import types as kinds
import typing
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..operators.rates import unused
from ..operators.validate import ERRORS, check
from ..shipping import ship
from .parsers import model_type, spark_type

if typing.TYPE_CHECKING:
    from pydantic import BaseModel

#: A half of a surrogate pair in JSON: Python's text may hold one, Spark's may not.
_HALF = r"\\[uU][dD][89abAB]"


def validate_nested(records: DataFrame, model: type[BaseModel], *, data: str = "data") -> DataFrame:
    """``records`` with ``record`` (the model's struct, null if it does not fit), ``valid`` and
    ``errors`` (loc, msg, type) of the JSON text in ``data``; null or empty text is a record
    without fields. A whole number past 64 bits, which a model takes, is null in ``record``."""
    ship(records.sparkSession)
    kind = model_type(model)
    seen = compiled(model)

    @F.pandas_udf(T.StructType([T.StructField("data", T.StringType()), T.StructField("errors", T._parse_datatype_string(ERRORS))]))
    def itself(texts: pd.Series) -> pd.DataFrame:
        told = [(None, None) if t is None else check(model, t) for t in texts]
        return pd.DataFrame({"data": [t for t, _ in told], "errors": [e for _, e in told]})

    text = F.coalesce(F.nullif(F.col(data), F.lit("")), F.lit("{}"))
    checked, odd, told, parsed, cast = unused(records.columns, "checked", "odd", "told", "parsed", "cast")
    judged = records.withColumn(parsed, F.try_parse_json(text))
    typed = _typed_model(model, ()) if _plain(model) else None
    if typed is None:
        judged = judged.withColumn(checked, seen(F.col(parsed)))
    else:
        judged = judged.withColumn(cast, typed.cast(F.col(parsed)))
        judged = judged.withColumn(checked, typed.judged(kind, F.col(cast), seen(F.col(parsed))))
    judged = judged.withColumn(odd, F.coalesce(F.col(f"{checked}.odd"), F.lit(True)) | text.rlike(_HALF))
    # only odd records leave the JVM: a Python function is run on all rows, whatever stands around it
    asked = judged.withColumn(told, itself(F.when(F.col(odd), text)))
    errors = F.when(F.col(odd), F.col(f"{told}.errors")).otherwise(F.col(f"{checked}.errors"))
    record = F.when(F.col(odd), F.from_json(F.col(f"{told}.data"), kind)).otherwise(F.col(f"{checked}.value"))
    done = asked.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).withColumn("record", F.when(F.col("valid"), record))
    return done.select(*[c for c in records.columns if c not in ("record", "valid", "errors")], "record", "valid", "errors")


def odd_records(records: DataFrame, model: type[BaseModel], *, data: str = "data") -> DataFrame:
    """Those of ``records`` that rules cannot decide, which ``validate_nested`` gives to the model."""
    text = F.coalesce(F.nullif(F.col(data), F.lit("")), F.lit("{}"))
    return records.filter(F.coalesce(compiled(model)(F.try_parse_json(text))["odd"], F.lit(True)) | text.rlike(_HALF))


def compiled(model: type[BaseModel]) -> Callable[[Column], Column]:
    """A model's rules, from a variant to a struct of ``errors``, ``odd`` and ``value``. Null, and anything
    but an object, is odd."""
    rules = _model(model, ())
    return lambda v: F.when(F.try_variant_get(v, "$", "map<string, variant>").isNotNull(), rules(v))


@dataclass(frozen=True)
class _Typed:
    """A kind's rules over values that were cast to it at once: ``shape`` is a pattern of the variant's type,
    ``read`` the type to cast to; the rules decide where ``fits`` is true. ``broken`` (whether a limit is;
    None without limits) and ``errors`` hold where it is."""

    shape: str
    read: str
    fits: Callable[[Column], Column]
    broken: Callable[[Column], Column] | None
    errors: Callable[[Column], Column]
    value: Callable[[Column], Column]

    def cast(self, v: Column) -> Column:
        """A variant's value, null for one of another shape."""
        return F.when(F.schema_of_variant(v).rlike(rf"\A{self.shape}\z"), F.try_variant_get(v, "$", self.read))

    def judged(self, of: T.DataType, x: Column, other: Column) -> Column:
        """The result for a value that was cast, ``other`` where that does not fit."""
        fast = _result(of, self.errors(x) if self.broken else _none(), F.lit(False), self.value(x))
        return F.when(F.coalesce(self.fits(x), F.lit(False)), fast).otherwise(other)


def _typed(kind: object, limits: list, within: tuple[type, ...]) -> _Typed | None:
    """The rules of a type over cast values, None for one that has none. The type of a list is that of all
    its items together, where nulls and fields that some leave out do not show: they are null when cast,
    and fit nothing."""
    origin, inner = typing.get_origin(kind), typing.get_args(kind)
    if origin is typing.Annotated:
        return _typed(inner[0], [*inner[1:], *limits], within)
    if origin is list and len(inner) == 1 and not limits:
        item = _typed(inner[0], [], within)
        if item is None:
            return None
        broken = item.broken and (lambda x: F.exists(x, item.broken))
        each = lambda x: F.flatten(F.transform(x, lambda e, k: F.when(item.broken(e), _below(k.cast("string"), item.errors(e))).otherwise(_none())))
        return _Typed(f"ARRAY<(?:VOID|{item.shape})>", f"array<{item.read}>", lambda x: x.isNotNull() & F.forall(x, lambda e: F.coalesce(item.fits(e), F.lit(False))), broken, lambda x: F.when(broken(x), each(x)).otherwise(_none()), lambda x: F.transform(x, item.value))
    if isinstance(kind, type) and hasattr(kind, "model_fields"):
        return None if limits else _typed_model(kind, within)
    if origin is typing.Literal and all(type(x) is str for x in inner) and not limits:
        return _typed_scalar(kind, [], "STRING", "string", lambda x: x.isin(*inner))
    if kind is str:
        return _typed_scalar(kind, limits, "STRING", "string", lambda x: x.isNotNull())
    if kind is int:
        return _typed_scalar(kind, limits, "BIGINT", "bigint", lambda x: x.isNotNull())
    if kind is float:
        return _typed_scalar(kind, limits, r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\))", "double", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    if kind is bool:
        return _typed_scalar(kind, limits, "BOOLEAN", "boolean", lambda x: x.isNotNull())
    if kind is date:
        return _typed_scalar(kind, limits, "STRING", "string", _day, lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    return None


def _typed_scalar(kind: object, limits: list, shape: str, read: str, fits: Callable[[Column], Column], value: Callable[[Column], Column] = lambda x: x) -> _Typed | None:
    try:
        tests = [_limit(kind, x) for x in limits]
    except (ConfigError, TypeError, ValueError):
        return None
    if None in tests:
        return None
    if not tests:
        return _Typed(shape, read, fits, None, lambda x: _none(), value)
    said = lambda x: F.filter(F.array(*[F.when(test(x), error) for test, error in tests]), lambda e: e.isNotNull())
    # past two limits: as in ``_scalar``
    few = fits if len(tests) == 1 else lambda x: fits(x) & (F.size(said(x)) < 2)
    return _Typed(shape, read, few, lambda x: _any([test(x) for test, _ in tests]), said, value)


def _typed_model(model: type[BaseModel], within: tuple[type, ...]) -> _Typed | None:
    if model in within or not _plain(model) or not model.model_fields:
        return None
    fields = {name: _typed(f.annotation, f.metadata, (*within, model)) for name, f in model.model_fields.items()}
    if not all(fields.values()):
        return None
    shape = ", ".join(f"{re.escape(n)}: {fields[n].shape}" for n in sorted(fields))
    read = ", ".join(f"`{n}`: {t.read}" for n, t in fields.items())
    limited = {n: t for n, t in fields.items() if t.broken}

    def fits(x: Column) -> Column:
        return reduce(Column.__and__, [F.coalesce(t.fits(x[n]), F.lit(False)) for n, t in fields.items()])

    def errors(x: Column) -> Column:
        return F.flatten(F.array(_none(), *[_below(F.lit(n), t.errors(x[n])) for n, t in limited.items()]))

    return _Typed(f"OBJECT<{shape}>", f"struct<{read}>", fits, (lambda x: _any([t.broken(x[n]) for n, t in limited.items()])) if limited else None, errors, lambda x: F.struct(*[t.value(x[n]).alias(n) for n, t in fields.items()]))


def _day(x: Column) -> Column:
    return x.rlike(r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(x, "yyyy-MM-dd").isNotNull()


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _none() -> Column:
    return F.expr(f"cast(array() as {ERRORS})")


def _result(kind: T.DataType, errors: Column, odd: Column, value: Column) -> Column:
    return F.struct(errors.alias("errors"), odd.alias("odd"), value.cast(kind).alias("value"))


def _error(kind: object, witness: object) -> Column:
    """The error that a value gives where a ``kind`` is asked for."""
    from pydantic import TypeAdapter, ValidationError

    try:
        TypeAdapter(kind).validate_python(witness)
    except ValidationError as e:
        found = e.errors()[0]
        return F.struct(F.lit("").alias("loc"), F.lit(found["msg"]).alias("msg"), F.lit(found["type"]).alias("type"))
    raise ConfigError(f"{kind} takes {witness!r}")


def _below(name: Column, errors: Column) -> Column:
    """Errors of a part as errors of the whole."""
    return F.transform(errors, lambda e: F.struct(F.when(e["loc"] == "", name).otherwise(F.concat(name, F.lit("."), e["loc"])).alias("loc"), e["msg"].alias("msg"), e["type"].alias("type")))


def _plain(model: type[BaseModel]) -> bool:
    """Whether a model is its fields and nothing else: no code of its own, no settings, no aliases."""
    from pydantic import BaseModel, RootModel

    own = model.__pydantic_decorators__
    code = own.validators, own.field_validators, own.root_validators, own.model_validators, own.field_serializers, own.model_serializers, own.computed_fields
    made = all(getattr(getattr(model, m), "__func__", getattr(model, m)) is getattr(getattr(BaseModel, m), "__func__", getattr(BaseModel, m)) for m in ("__get_pydantic_core_schema__", "__init__", "__new__"))
    return not any(code) and made and not model.model_config and not issubclass(model, RootModel) and model.model_post_init is BaseModel.model_post_init and not any(f.alias or f.validation_alias or f.discriminator for f in model.model_fields.values())


def _model(model: type[BaseModel], within: tuple[type, ...]) -> Callable[[Column], Column]:
    if model in within:
        raise ConfigError(f"{model.__name__} holds itself: it has no Spark type")
    if not _plain(model):
        return _odd(model)
    kind = model_type(model)
    fields = [(name, f, _kind(f.annotation, f.metadata, (*within, model))) for name, f in model.model_fields.items()]
    wrong = _error(model, 0)

    def field(v: Column, name: str, f: object, rules: Callable[[Column], Column]) -> Column:
        of = spark_type(f.annotation)
        if f.is_required():
            without = _result(of, F.array(_missing()), F.lit(False), F.lit(None))
        elif f.default_factory is None and not f.validate_default and (f.default is None or type(f.default) in (str, int, float, bool)):
            without = _result(of, _none(), F.lit(False), F.lit(f.default))
        else:
            without = _result(of, _none(), F.lit(True), F.lit(None))
        return F.when(v.isNull(), without).otherwise(rules(v)).alias(name)

    def judge(members: Column) -> Column:
        parts = F.struct(*[field(F.try_element_at(members, F.lit(name)), name, f, rules) for name, f, rules in fields])
        return _let(parts, lambda p: _result(kind, F.flatten(F.array(_none(), *[_below(F.lit(n), p[n]["errors"]) for n, _, _ in fields])), _any([p[n]["odd"] for n, _, _ in fields]), F.struct(*[p[n]["value"].alias(n) for n, _, _ in fields])))

    return lambda v: _let(F.try_variant_get(v, "$", "map<string, variant>"), lambda m: F.when(m.isNotNull(), judge(m)).otherwise(_result(kind, F.array(wrong), F.lit(False), F.lit(None))))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out |= t
    return out


def _missing() -> Column:
    from pydantic import create_model

    error = _error(create_model("Any", x=(int, ...)), {})
    return error.withField("loc", F.lit(""))


def _odd(kind: object) -> Callable[[Column], Column]:
    """The rules of what only the model can decide."""
    return lambda v: _result(spark_type(kind), _none(), F.lit(True), F.lit(None))


def _kind(kind: object, limits: list, within: tuple[type, ...]) -> Callable[[Column], Column]:
    """The rules of a field's type with its limits."""
    origin, inner = typing.get_origin(kind), typing.get_args(kind)
    if origin is typing.Annotated:
        return _kind(inner[0], [*inner[1:], *limits], within)
    if origin in (typing.Union, kinds.UnionType):
        own = [x for x in inner if x is not type(None)]
        if len(own) != 1 or len(inner) != 2:
            return _odd(kind)
        rules, of = _kind(own[0], limits, within), spark_type(kind)
        return lambda v: F.when(F.is_variant_null(v), _result(of, _none(), F.lit(False), F.lit(None))).otherwise(rules(v))
    if origin is list and len(inner) == 1:
        return _list(kind, inner[0], limits, within)
    if isinstance(kind, type) and hasattr(kind, "model_fields"):
        return _odd(kind) if limits else _model(kind, within)
    if origin is typing.Literal and all(type(x) is str for x in inner) and not limits:
        return _scalar(kind, [], lambda t, x: (t == "STRING") & x.isin(*inner), lambda t, x: F.lit(False), "string", 0)
    if kind is str:
        return _scalar(kind, limits, lambda t, x: t == "STRING", lambda t, x: F.lit(False), "string", 0)
    if kind is int:
        return _scalar(kind, limits, lambda t, x: t == "BIGINT", lambda t, x: _one_of(t, "STRING", "BOOLEAN", "DOUBLE", "FLOAT", "DECIMAL"), "bigint", None)
    if kind is float:
        finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf"))
        return _scalar(kind, limits, lambda t, x: _one_of(t, "BIGINT", "DOUBLE", "FLOAT", "DECIMAL") & finite(x), lambda t, x: _one_of(t, "STRING", "BOOLEAN", "BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "double", None)
    if kind is bool:
        return _scalar(kind, limits, lambda t, x: t == "BOOLEAN", lambda t, x: _one_of(t, "STRING", "BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "boolean", None)
    if kind is date:
        return _scalar(kind, limits, lambda t, x: (t == "STRING") & _day(x), lambda t, x: _one_of(t, "STRING", "BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "string", [], T.DateType())
    return _odd(kind)


def _one_of(t: Column, *names: str) -> Column:
    return _any([t.startswith(n) for n in names])


def _limit(kind: object, limit: object) -> tuple[Callable[[Column], Column], Column] | None:
    """(when a value breaks a limit, the error that it gives), None for limits of other sorts."""
    import annotated_types as a

    given = typing.Annotated[kind, limit]
    if kind in (int, float):
        for sort, attr, broken, by in ((a.Gt, "gt", lambda x, b: x <= b, 0), (a.Ge, "ge", lambda x, b: x < b, -1), (a.Lt, "lt", lambda x, b: x >= b, 0), (a.Le, "le", lambda x, b: x > b, 1)):
            if isinstance(limit, sort):
                bound = getattr(limit, attr)
                if type(bound) not in (int, float) or not abs(bound) < 2**53:
                    return None
                return (lambda x: broken(x, F.lit(bound))), _error(given, kind(int(bound) + 2 * by if by else bound))
    if kind is str:
        if isinstance(limit, a.MinLen):
            return (lambda x: F.length(x) < limit.min_length), _error(given, "x" * (limit.min_length - 1))
        if isinstance(limit, a.MaxLen):
            return (lambda x: F.length(x) > limit.max_length), _error(given, "x" * (limit.max_length + 1))
    return None


def _scalar(kind: object, limits: list, fits: Callable, may: Callable, read: str, witness: object, of: T.DataType | None = None) -> Callable[[Column], Column]:
    """Rules of a single value: it ``fits``, the model ``may`` take it all the same, or it is wrong as the
    ``witness`` is. A value past two limits is left to the model, which names one."""
    try:
        tests = [_limit(kind, x) for x in limits]
        wrong = _error(kind, witness)
    except (ConfigError, TypeError, ValueError):
        return _odd(kind)
    if None in tests:
        return _odd(kind)
    of = of or spark_type(kind)

    def judge(t: Column, x: Column) -> Column:
        broken = F.filter(F.array(*[F.when(test(x), error) for test, error in tests]), lambda e: e.isNotNull()) if tests else _none()
        fit = F.coalesce(fits(t, x), F.lit(False))
        value = F.try_to_date(x, "yyyy-MM-dd") if isinstance(of, T.DateType) else x
        plain = _let(broken, lambda e: _result(of, e, F.size(e) > 1, value)) if tests else _result(of, _none(), F.lit(False), value)
        return F.when(fit, plain).otherwise(_let(may(t, x), lambda m: _result(of, F.when(m, _none()).otherwise(F.array(wrong)), m, F.lit(None))))

    return lambda v: _let(F.struct(F.schema_of_variant(v).alias("t"), F.try_variant_get(v, "$", read).alias("x")), lambda s: judge(s["t"], s["x"]))


def _list(kind: object, item: object, limits: list, within: tuple[type, ...]) -> Callable[[Column], Column]:
    import annotated_types as a

    if not all(isinstance(x, (a.MinLen, a.MaxLen)) for x in limits):
        return _odd(kind)
    rules, of, wrong = _kind(item, [], within), spark_type(kind), _error(kind, 0)

    def judge(items: Column) -> Column:
        # a list of a wrong length: which of its errors are named is the model's to say
        length = _any([F.size(items) < x.min_length if isinstance(x, a.MinLen) else F.size(items) > x.max_length for x in limits])
        each = F.transform(items, lambda v: rules(v))
        return _let(each, lambda r: _result(of, F.flatten(F.transform(r, lambda x, k: _below(k.cast("string"), x["errors"]))), length | F.exists(r, lambda x: x["odd"]), F.transform(r, lambda x: x["value"])))

    return lambda v: _let(F.try_variant_get(v, "$", "array<variant>"), lambda m: F.when(m.isNotNull(), judge(m)).otherwise(_result(of, F.array(wrong), F.lit(False), F.lit(None))))

