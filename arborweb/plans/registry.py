"""Scrapers: steps and entries declared in Python, listed as catalogue tables, run in Arrow batches.

A step is a generator over one response. It names what it wants as parameters, and only
that is made: an HTML tree is parsed for ``page`` alone. What it yields goes back as
rows: data, requests, or nothing. What breaks on one response is a row as well, and so are
the selectors that a step tried; a job fails for faults of the scraper only.
"""

from __future__ import annotations

import inspect
import json
import typing
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields, is_dataclass
from datetime import date
from datetime import time as dtime
from enum import Enum
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AssumptionError, ConfigError, HaltRun, SkipRequest, TransientError
from ..model import DEFAULT_PRIORITY
from ..operators.observe import QUERY
from ..operators.speculate import SpeculativeRange
from ..operators.validate import error_rows
from ..shipping import ship
from ..sources.dom import parse, to_text
from ..storage import stored
from .page import Data, Follow, Observer, Page

INJECTED = ("response", "request", "previous_request", "accumulated_data", "json_content", "tree", "page", "text", "local_filepath")
QUERY_COLUMNS = [c.split()[0] for c in QUERY.split(", ") if not c.startswith("request_id")]
OUTPUT = "request_id STRING, seq INT, kind STRING, payload STRING, error_class STRING, error STRING"


@dataclass(frozen=True)
class StepInfo:
    name: str
    priority: int = DEFAULT_PRIORITY
    encoding: str = "utf-8"
    preprocess: Callable[[str], str] | None = None
    wants: tuple[str, ...] = ()
    await_list: tuple = ()
    auto_await_timeout: float | None = None


@dataclass(frozen=True)
class WaitForSelector:
    """Conditions that a browser transport waits for before a page is read; others ignore them."""

    selector: str
    state: str = "visible"
    timeout: int | None = None


@dataclass(frozen=True)
class WaitForLoadState:
    state: str = "load"
    timeout: int | None = None


@dataclass(frozen=True)
class WaitForURL:
    url: str
    timeout: int | None = None


@dataclass(frozen=True)
class WaitForTimeout:
    timeout: int


def step(fn: Callable | None = None, *, priority: int = DEFAULT_PRIORITY, encoding: str = "utf-8", preprocess: Callable[[str], str] | None = None, await_list: tuple = (), auto_await_timeout: float | None = None) -> Callable:
    """Declares a step."""

    def mark(f: Callable) -> Callable:
        wants = tuple(p for p in inspect.signature(f).parameters if p in INJECTED)
        f._step = StepInfo(f.__name__, priority, encoding, preprocess, wants, tuple(await_list), auto_await_timeout)
        return f

    return mark(fn) if fn is not None else mark


@dataclass(frozen=True)
class EntryInfo:
    """An entry: the record type it leads to, its parameters by name, and which of them, if
    any, is a range to be probed."""

    name: str
    returns: type
    params: dict[str, object]

    @property
    def speculative(self) -> str | None:
        return next((k for k, t in self.params.items() if isinstance(t, type) and issubclass(t, SpeculativeRange)), None)

    @cached_property
    def model(self) -> type:
        from pydantic import ConfigDict, create_model

        return create_model(self.name, __config__=ConfigDict(extra="forbid", arbitrary_types_allowed=False), **{k: (t, ...) for k, t in self.params.items()})

    def validate(self, kwargs: dict) -> dict:
        """Typed parameters; a missing, surplus or wrong one is pydantic's ``ValidationError``.
        Days are given as ISO text."""
        for k, t in self.params.items():
            if t is date and k in kwargs and not isinstance(kwargs[k], (str, date)):
                raise ValueError(f"{k}: a day is written YYYY-MM-DD")
        made = self.model.model_validate(kwargs)
        return {k: getattr(made, k) for k in self.params}


def entry(returns: type) -> Callable:
    """Declares an entry; its parameters must have types that can be checked, at most one of
    them a range. Faults are ``TypeError`` at once."""

    def mark(f: Callable) -> Callable:
        try:
            hints = typing.get_type_hints(f)
        except NameError as e:
            raise TypeError(f"{f.__name__}: {e}") from e
        params = {}
        for name in list(inspect.signature(f).parameters)[1:]:
            if name not in hints:
                raise TypeError(f"{f.__name__}: parameter {name!r} has no type")
            if hints[name] is tuple:
                raise TypeError(f"{f.__name__}: parameter {name!r} needs the types of its items")
            params[name] = hints[name]
        info = EntryInfo(f.__name__, returns, params)
        if sum(isinstance(t, type) and issubclass(t, SpeculativeRange) for t in params.values()) > 1:
            raise TypeError(f"{f.__name__}: only one range can be probed")
        try:
            _ = info.model
        except Exception as e:
            raise TypeError(f"{f.__name__}: a parameter's type cannot be checked: {e}") from e
        f._entry = info
        return f

    return mark


class Scraper:
    """Base of scrapers. Attributes describe the site; methods marked ``step`` and ``entry``
    are found by name."""

    court_ids: set[str] = set()
    court_url = ""
    data_types: set[str] = set()
    status = "in_development"
    version = ""
    last_verified = ""
    oldest_record: date | None = None
    requires_auth = False
    rate_limits: list | None = None
    default_headers: dict[str, str] | None = None
    #: Of ``model.DRIVER_REQUIREMENTS``.
    driver_requirements: list[str] = []
    http_code_types: dict[int, str] | None = None

    def _marked(self, mark: str) -> Iterator[tuple[str, Callable]]:
        for name in sorted(dir(type(self))):
            if name.startswith("_"):
                continue
            try:
                found = getattr(self, name)
            except Exception as e:
                raise ConfigError(f"{type(self).__name__}.{name} cannot be read: {e}") from e
            if callable(found) and hasattr(found, mark):
                yield name, found

    def list_steps(self) -> list[StepInfo]:
        return [f._step for _, f in self._marked("_step")]

    def list_entries(self) -> list[EntryInfo]:
        return [f._entry for _, f in self._marked("_entry")]

    def list_speculative_entries(self) -> list[EntryInfo]:
        return [e for e in self.list_entries() if e.speculative]

    def continuation(self, name: str) -> Callable:
        found = dict(self._marked("_step")).get(name)
        if found is None:
            raise ConfigError(f"{type(self).__name__} has no step {name!r}")
        return found

    def actually_successful(self, response: dict) -> bool:
        """False for an answer of status 2xx that holds an error."""
        return True

    def get_entry(self) -> Iterator[Follow]:
        raise NotImplementedError

    def initial_seed(self, params: list[dict]) -> tuple[list[Follow], list[tuple[str, int, dict]]]:
        """(requests, templates) of ``[{entry: kwargs}, ...]``: an entry with a range is kept
        as a template to be probed, any other gives its requests."""
        if not params:
            raise ValueError("nothing to seed")
        known = {f._entry.name: f for _, f in self._marked("_entry")}
        requests: list[Follow] = []
        templates: list[tuple[str, int, dict]] = []
        for item in params:
            for name, kwargs in item.items():
                if name not in known:
                    raise ValueError(f"unknown entry {name!r}; there are {sorted(known)}")
                info = known[name]._entry
                made = info.validate(kwargs)
                if info.speculative:
                    templates.append((name, sum(t[0] == name for t in templates), made))
                else:
                    requests += list(known[name](**made))
        return requests, templates

    def schema(self) -> dict:
        """The entries as JSON Schema: parameters by entry, shared types under ``$defs``."""
        defs: dict = {}
        entries = {}
        for e in self.list_entries():
            said = e.model.model_json_schema()
            defs |= said.pop("$defs", {})
            entries[e.name] = {"parameters": said, "returns": getattr(e.returns, "__name__", str(e.returns)), "speculative": e.speculative}
        return {"scraper": type(self).__name__, "entries": entries, "$defs": defs}

    # the catalogue as tables

    def steps_table(self, spark: SparkSession) -> DataFrame:
        rows = [(type(self).__name__, s.name, s.priority, s.encoding, json.dumps(list(s.wants)), json.dumps([{'type': type(a).__name__, **vars(a)} for a in s.await_list]), s.auto_await_timeout) for s in self.list_steps()]
        return spark.createDataFrame(rows, "scraper STRING, name STRING, priority INT, encoding STRING, wants STRING, await_list STRING, auto_await_timeout DOUBLE")

    def entries_table(self, spark: SparkSession) -> DataFrame:
        rows = [(type(self).__name__, e.name, getattr(e.returns, "__name__", str(e.returns)), e.speculative, json.dumps(e.model.model_json_schema(), sort_keys=True)) for e in self.list_entries()]
        return spark.createDataFrame(rows, "scraper STRING, func_name STRING, returns STRING, speculative_param STRING, param_schema STRING")

    def about(self, spark: SparkSession) -> DataFrame:
        row = (type(self).__name__, sorted(self.court_ids), self.court_url, sorted(self.data_types), self.status, self.version, self.last_verified, self.requires_auth, list(self.driver_requirements))
        return spark.createDataFrame([row], "scraper STRING, court_ids ARRAY<STRING>, court_url STRING, data_types ARRAY<STRING>, status STRING, version STRING, last_verified STRING, requires_auth BOOLEAN, driver_requirements ARRAY<STRING>")


def _plain(value: object) -> object:
    """A record as JSON has it: models and dataclasses as mappings, days and times as ISO text,
    sets sorted, decimals, identifiers and whatever else JSON lacks as text."""
    if hasattr(value, "model_dump"):
        return value.model_dump(mode="json")
    if is_dataclass(value) and not isinstance(value, type):
        return {f.name: _plain(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, Mapping):
        return {k if isinstance(k, str) else str(_plain(k)): _plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((_plain(v) for v in value), key=repr)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, Enum):
        return _plain(value.value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    return value.isoformat() if isinstance(value, (date, dtime)) else str(value)


def _given(info: StepInfo, response: dict, observer: Observer) -> dict[str, object]:
    """What a step asks for by the names of its parameters."""
    given: dict[str, object] = {}
    wants = set(info.wants)
    if "response" in wants:
        given["response"] = response
    for k in ("request", "previous_request"):
        if k in wants:
            given[k] = response.get(k)
    if "accumulated_data" in wants:
        given["accumulated_data"] = json.loads(response.get("accumulated_data") or "{}")
    if "local_filepath" in wants:
        given["local_filepath"] = response.get("file_url") if response.get("is_archive") else None
    text, content = response.get("text") or None, response.get("content")
    if wants & {"json_content", "text"} or info.preprocess:
        plain = text if text is not None else bytes(content or b"").decode(info.encoding)
        if "json_content" in wants:
            given["json_content"] = json.loads(plain)
        if info.preprocess and wants & {"text", "tree", "page"}:
            plain = info.preprocess(plain)
        if "text" in wants:
            given["text"] = plain
    if wants & {"tree", "page"}:
        document = plain if info.preprocess else (to_text(bytes(content)) if content else text or "")
        parsed = parse(document)
        if "tree" in wants:
            given["tree"] = parsed
        if "page" in wants:
            given["page"] = Page(parsed, response.get("url") or "", 0, observer)
    return given


def execute(scraper: Scraper, name: str, response: dict, observe: bool = False) -> Iterator[dict]:
    """The rows that one response gives in a step, by ``kind``: data, request, and at the end, if
    there is one, how it broke off: error, halt (stop the run) or skip (leave out this
    response). With ``observe`` a row ``query`` follows for each selector that was tried.

    Whatever a response does to the step's code is that response's error, of the exception's
    class; unreadable text or JSON is an ``AssumptionError``. Only a ``ConfigError``, a
    fault of the scraper itself, is raised.
    """
    fn = scraper.continuation(name)
    observer, seq = Observer(), 0

    def row(kind: str, payload: object = None, error_class: str | None = None, error: str | None = None) -> dict:
        nonlocal seq
        seq += 1
        return {"seq": seq - 1, "kind": kind, "payload": None if payload is None else json.dumps(payload), "error_class": error_class, "error": error}

    try:
        for out in fn(**_given(fn._step, response, observer)):
            if isinstance(out, Follow):
                yield row("request", out.row())
            elif out is not None:
                yield row("data", _plain(out.unwrap() if isinstance(out, Data) else out))
    except ConfigError:
        raise
    except (HaltRun, SkipRequest) as e:
        yield row("halt" if isinstance(e, HaltRun) else "skip", error_class=type(e).__name__, error=str(e))
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        yield row("error", error_class="AssumptionError", error=f"{type(e).__name__}: {e}")
    except Exception as e:
        yield row("error", error_class=type(e).__name__, error=str(e))
    if observe:
        for made in observer.made.values():
            yield row("query", made)


def split_outputs(outputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(data, requests, errors) of the rows of ``run_step``. Store the rows first: else each
    part runs the step again."""
    data = outputs.filter("kind = 'data'").select("request_id", "seq", F.col("payload").alias("data"))
    pairs = "ARRAY<STRUCT<k: STRING, v: STRING>>"
    fields = F.from_json("payload", f"url STRING, continuation STRING, method STRING, priority INT, archive BOOLEAN, dedup_key STRING, permanent STRING, accumulated_data STRING, params {pairs}, data {pairs}, via_json STRING")
    more = outputs.filter("kind = 'request'").select(F.col("request_id").alias("parent_id"), "seq", fields.alias("r")).select("parent_id", "seq", "r.*")
    errors = outputs.filter("kind = 'error'").select("request_id", F.col("error_class").alias("class"), F.col("error").alias("message"))
    return data, more, errors


def queries_of(outputs: DataFrame) -> DataFrame:
    """``observer.QUERY`` rows of the selectors that steps tried, for ``operators.observe``."""
    made = F.from_json("payload", QUERY)
    return outputs.filter("kind = 'query'").select("request_id", made.alias("q")).select("request_id", *[f"q.{c}" for c in QUERY_COLUMNS])


def actions(outputs: DataFrame, info: StepInfo, *, retries: int = 3, attempt: str | None = None, waited: str | None = None) -> DataFrame:
    """``request_id, action`` of each response of a step that broke off: retry (a transient class,
    before the last of ``retries`` attempts), await (a missing structure, where the step
    awaits it and has ``waited`` fewer seconds than it may), halt, skip or error. ``attempt``
    and ``waited`` name columns of ``outputs``."""
    transient = [c.__name__ for c in _subclasses(TransientError)]
    tried = F.col(attempt) if attempt else F.lit(1)
    waiting = F.lit(False)
    if info.auto_await_timeout is not None:
        waiting = (F.col("error_class") == "StructureError") & ((F.col(waited) if waited else F.lit(0.0)) < info.auto_await_timeout)
    action = F.when(F.col("kind").isin("halt", "skip"), F.col("kind")).when(F.col("error_class").isin(*transient) & (tried < retries), "retry").when(waiting, "await").otherwise("error")
    return outputs.filter(F.col("kind").isin("error", "halt", "skip")).select("request_id", action.alias("action"))


def _subclasses(of: type) -> list[type]:
    return [of, *(x for c in of.__subclasses__() for x in _subclasses(c))]


def run_step(responses: DataFrame, scraper: type[Scraper], name: str, *, observe: bool = False) -> DataFrame:
    """``request_id, seq, kind (data, request, error, halt, skip, query), payload (JSON),
    error_class, error`` of ``responses`` in a step. An unknown step is a fault of the scraper,
    found at once."""
    made = scraper()
    made.continuation(name)
    ship(responses.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scraper()
        for whole in batches:
            for lo in range(0, len(whole), 256):
                pdf = whole.iloc[lo : lo + 256]
                rows = [{"request_id": r["request_id"], **out} for r in pdf.to_dict("records") for out in execute(own, name, r, observe)]
                yield pd.DataFrame(rows, columns=["request_id", "seq", "kind", "payload", "error_class", "error"])

    return responses.mapInPandas(run, OUTPUT)


SEED = "entry STRING, kind STRING, seq INT, param_index INT, payload STRING, error_class STRING, errors ARRAY<STRUCT<loc: STRING, msg: STRING, type: STRING>>"


def seed_rows(scraper: Scraper, name: str | None, params: str | None) -> Iterator[tuple]:
    """(entry, kind, seq, payload, error class, errors) of one invocation: its requests, or its
    template, or what is wrong with it. An entry whose code breaks keeps the requests before."""
    known = {f._entry.name: f for _, f in scraper._marked("_entry")}

    def bad(kind: str, errors: list[tuple[str, str, str]], seq: int = 0) -> tuple:
        return (name, "error", seq, None, kind, errors)

    if name not in known:
        yield bad("ConfigError", [("__root__", f"unknown entry {name!r}; there are {sorted(known)}", "unknown_entry")])
        return
    info = known[name]._entry
    try:
        given = json.loads(params) if params else {}
        if not isinstance(given, dict):
            raise ValueError("parameters are a mapping")
        made = info.validate(given)
    except ValueError as e:  # pydantic's is one as well
        found = error_rows(e) if hasattr(e, "errors") else [{"loc": "__root__", "msg": str(e), "type": "json_invalid" if isinstance(e, json.JSONDecodeError) else "value_error"}]
        yield bad("DataFormatError", [(x["loc"], x["msg"], x["type"]) for x in found])
        return
    if info.speculative:
        of = made[info.speculative]
        others = {k: _plain(v) for k, v in made.items() if k != info.speculative}
        yield (name, "template", 0, json.dumps({"min": of.min, "soft_max": of.soft_max, "gap": of.gap * of.should_advance, "params": others}), None, None)
        return
    seq = 0
    try:
        for seq, request in enumerate(known[name](**made), 1):
            yield (name, "request", seq, json.dumps(request.row()), None, None)
    except ConfigError:
        raise
    except Exception as e:
        yield bad(type(e).__name__, [("__root__", str(e), type(e).__name__)], seq + 1)


def seed_table(invocations: DataFrame, scraper: type[Scraper], *, entry: str = "entry", params: str = "params", key: str | None = None) -> DataFrame:
    """A table of invocations (an entry's name, its parameters as a JSON text) made requests and
    templates, each row by itself: ``key`` and ``SEED``. A row that does not fit its entry is a
    row of kind error; the others are not touched by it. Templates of an entry are numbered
    in the order of ``key``, or of their parameters."""
    ship(invocations.sparkSession)
    kept = [key] if key else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scraper()
        for pdf in batches:
            rows = [(*head, n, kind, seq, None, payload, cls, errors) for *head, name, given in pdf.itertuples(index=False, name=None) for n, kind, seq, payload, cls, errors in seed_rows(own, name, given)]
            yield pd.DataFrame(rows, columns=[*kept, *(x.split(" ")[0] for x in SEED.split(", ")[:7])])

    schema = T.StructType([invocations.schema[k] for k in kept] + T.StructType.fromDDL(SEED).fields)
    made = invocations.select(*kept, entry, F.col(params).cast("string")).mapInPandas(run, schema)
    return _numbered(made, key or "payload")


def _numbered(made: DataFrame, order: str) -> DataFrame:
    """``param_index`` of templates: their place among those of their entry, from 0. Ranges of the
    order are counted by themselves, and the counts before each range added."""
    columns = made.columns
    made = stored(made)
    ranged = stored(made.filter("kind = 'template'").repartitionByRange("entry", order, "payload").withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", "entry").orderBy(order, "payload")
    counts = ranged.groupBy("_part", "entry").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("entry").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = ranged.withColumn("_at", F.row_number().over(own) - 1).join(before, ["_part", "entry"]).withColumn("param_index", (F.col("_before") + F.col("_at")).cast("int"))
    return made.filter("kind <> 'template'").unionByName(placed.select(*columns))


def split_seeds(seeded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, templates for ``speculate`` and ``frontier.Probing``, error rows) of ``seed_table``.
    Store the rows first."""
    kept = [c for c in seeded.columns if c not in {x.split(" ")[0] for x in SEED.split(", ")}]
    pairs = "ARRAY<STRUCT<k: STRING, v: STRING>>"
    asked = F.from_json("payload", f"url STRING, continuation STRING, method STRING, priority INT, archive BOOLEAN, dedup_key STRING, permanent STRING, accumulated_data STRING, params {pairs}, data {pairs}, via_json STRING")
    ranges = F.from_json("payload", "min BIGINT, soft_max BIGINT, gap INT, params STRING")
    requests = seeded.filter("kind = 'request'").select(*kept, "entry", "seq", asked.alias("r")).select(*kept, "entry", "seq", "r.*")
    templates = seeded.filter("kind = 'template'").select(*kept, "entry", "param_index", ranges.alias("t")).select(*kept, "entry", "param_index", "t.*")
    said = F.array_join(F.transform("errors", lambda e: F.concat(e["loc"], F.lit(": "), e["msg"])), ", ")
    return requests, templates, seeded.filter("kind = 'error'").select(*kept, "entry", F.col("error_class").alias("class"), said.alias("message"), "errors")
