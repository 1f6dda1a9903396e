"""Requests as rows: resolving, inheritance, priority, deduplication, deferred values."""

from __future__ import annotations

import asyncio
import inspect
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity, urls
from ..model import ARCHIVE_PRIORITY, DEFAULT_PRIORITY, DEFAULT_TIMEOUT, METHODS, REQUESTS
from ..shipping import series_udf
from ..storage import stored


def build(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Requests from mappings of their fields. ``params`` and ``data`` may be mappings (a list
    for repeated names) or (name, value) pairs; what is left out gets its default."""
    made = []
    for r in rows:
        r = {"method": "GET", "allow_redirects": True, "stream": False, "verify": "true", **r}
        if r["method"] not in METHODS:
            raise ValueError(f"unknown method {r['method']!r}")
        timeout = r.pop("timeout", DEFAULT_TIMEOUT)
        both = timeout if isinstance(timeout, tuple) else (timeout, timeout)
        r["connect_timeout"], r["read_timeout"] = map(float, both)
        for name in ("params", "data"):
            given = r.get(name)
            if isinstance(given, dict):
                given = [(k, x) for k, v in given.items() for x in (v if isinstance(v, list) else [v])]
            if given is not None:
                r[name] = [{"k": str(k), "v": str(v)} for k, v in given]
        for name in ("json", "permanent", "accumulated_data"):
            if r.get(name) is not None and not isinstance(r[name], str):
                r[name] = json.dumps(r[name])
        made.append(json.dumps(r))
    return spark.createDataFrame(made, "string").select(F.from_json("value", REQUESTS).alias("r")).select("r.*")


def with_default_headers(requests: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """A site's default headers under those of each request, names compared in any case."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else F.expr("cast(map() as map<string, string>)")
    own = F.coalesce("headers", F.expr("cast(map() as map<string, string>)"))
    names = F.transform(F.map_keys(own), lambda k: F.lower(k))
    return requests.withColumn("headers", F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(names, F.lower(k))), own))


def merge_permanent_text(parent: str | None, child: str | None) -> str | None:
    """What holds for a whole chain of requests: the child's over the parent's, headers and
    cookies name by name."""
    if parent is None or child is None:
        return child if parent is None else parent
    up, own = json.loads(parent), json.loads(child)
    out = up | own
    for name in ("headers", "cookies"):
        if isinstance(up.get(name), dict) and isinstance(own.get(name), dict):
            out[name] = up[name] | own[name]
    return json.dumps(out, sort_keys=True)


def _merged(parent: pd.Series, child: pd.Series) -> pd.Series:
    return pd.Series([merge_permanent_text(p, c) for p, c in zip(parent, child, strict=True)], dtype=object)


def merge_permanent(parent: Column, child: Column) -> Column:
    return F.when(parent.isNull(), child).when(child.isNull(), parent).otherwise(series_udf(_merged, T.StringType())(parent, child))


def with_permanent(permanent: Column, name: str, own: Column) -> Column:
    """The permanent headers or cookies under the request's own, which win."""
    base = F.from_json(F.get_json_object(permanent, f"$.{name}"), "map<string, string>")
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return F.when(base.isNull(), own).when(own.isNull(), base).otherwise(F.map_concat(kept, own))


def auto_key(url: Column = None) -> Column:
    """The key that a request gets if it is given none."""
    return identity.request_key(F.col("method"), F.col("url") if url is None else url, F.col("params"), F.col("data"), F.col("json"))


def complete(requests: DataFrame) -> DataFrame:
    """Fills what a new request leaves open: a priority for archive files, permanent
    headers and cookies, the deduplication key. A continuation is a must."""
    named = F.when(F.coalesce(F.col("continuation"), F.lit("")) == "", F.raise_error(F.lit("a request needs a continuation")).cast("string")).otherwise(F.col("continuation"))
    return requests.withColumns(
        {
            "continuation": named,
            "priority": F.coalesce("priority", F.when(F.col("archive"), F.lit(ARCHIVE_PRIORITY))),
            "headers": with_permanent(F.col("permanent"), "headers", F.col("headers")),
            "cookies": with_permanent(F.col("permanent"), "cookies", F.col("cookies")),
            "dedup_key": F.coalesce("dedup_key", F.when(~F.coalesce(F.col("skip_dedup"), F.lit(False)), auto_key())),
        }
    )


def resolve_from(requests: DataFrame, parents: DataFrame) -> DataFrame:
    """``requests`` as seen from the responses of their parents (request_id, url, permanent):
    the URL made absolute, the location noted, permanent values inherited, and a key that was
    automatic made anew; a key that was chosen stays. All other columns are kept. Where
    location and URL make none, the row stays with a null URL (``without_url``)."""
    up = parents.select(F.col("request_id").alias("parent_id"), F.col("url").alias("_location"), F.col("permanent").alias("_permanent"))
    met = requests.join(up, "parent_id")
    met = met.withColumn("_automatic", F.coalesce(F.col("dedup_key") == auto_key(), F.lit(False)))
    met = met.withColumns({"current_location": F.col("_location"), "url": urls.resolve(F.col("_location"), F.col("url")), "permanent": merge_permanent(F.col("_permanent"), F.col("permanent")), "dedup_key": F.when(~F.col("_automatic"), F.col("dedup_key"))})
    return complete(met).select(*requests.columns)


def without_url(requests: DataFrame) -> DataFrame:
    """An error row for each request whose URL could not be made: no fetcher can send it."""
    return requests.filter("url is null").select("parent_id", F.lit("AssumptionError").alias("class"), F.concat(F.lit("Not a URL, as seen from "), F.coalesce("current_location", F.lit("nowhere"))).alias("message"))


def effective_priority(steps: DataFrame | None = None) -> Column:
    """A request's place in the queue, lower first: its own, else its step's, else the default."""
    return F.coalesce(F.col("priority"), *([F.col("step_priority")] if steps is not None else []), F.lit(DEFAULT_PRIORITY))


#: Steps that are broadcast; a table of more, which no catalogue is, is joined as Spark sees fit.
BROADCAST_STEPS = 100_000


def _catalogue(steps: DataFrame) -> DataFrame:
    return F.broadcast(steps) if steps.limit(BROADCAST_STEPS + 1).count() <= BROADCAST_STEPS else steps


def inherit_priority(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """Requests without a priority get that of the step they go on to (name, priority)."""
    of = _catalogue(steps.select(F.col("name").alias("continuation"), F.col("priority").alias("_step")))
    return requests.join(of, "continuation", "left").withColumn("priority", F.coalesce("priority", "_step")).select(*requests.columns)


def missing_steps(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """Requests whose continuation is no step: faults of the scraper."""
    return requests.join(_catalogue(steps.select(F.col("name").alias("continuation"))), "continuation", "left_anti").withColumn("class", F.lit("ConfigError"))


def dedup(requests: DataFrame, visited: DataFrame | None = None, *, seq: str = "seq") -> DataFrame:
    """The first request of each key by ``seq`` (those without one last), without those in
    ``visited``; requests that skip deduplication, and those without a key, all stay. Keys
    are reduced before the shuffle, so a key with a third of all rows costs one row from
    each task."""
    open_ = F.col("dedup_key").isNull()
    if "skip_dedup" in requests.columns:
        open_ = open_ | F.coalesce(F.col("skip_dedup"), F.lit(False))
    keyed = requests.filter(~open_)
    if visited is not None:
        keyed = keyed.join(visited.select("dedup_key").distinct(), "dedup_key", "left_anti")
    return first_of_key(keyed, seq).unionByName(requests.filter(open_))


def first_of_key(keyed: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each ``dedup_key``: the first by ``seq``, rows without one last."""
    others = [c for c in keyed.columns if c != "dedup_key"]
    first = keyed.groupBy("dedup_key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.struct(F.col(seq).isNull(), F.col(seq))).alias("_row"))
    return first.select("dedup_key", "_row.*").select(*[F.col(f"`{c}`") for c in keyed.columns])


def next_batch(frontier: DataFrame, size: int, *, seq: str = "seq") -> DataFrame:
    """The ``size`` requests to send next: by priority, then in the order they came."""
    return frontier.orderBy(effective_priority(), seq).limit(size)


def speculative(requests: DataFrame, entry: str, param_index: int, n: Column) -> DataFrame:
    """Requests marked as probes number ``n`` of an entry's template."""
    return requests.withColumn("is_speculative", F.lit(True)).withColumn("speculation_id", F.struct(F.lit(entry).alias("entry"), F.lit(param_index).alias("param_index"), n.cast("bigint").alias("n")))


DEFERRED = "\x00deferred:"


def deferred(name: str) -> str:
    """Stands for a field's value that the resolver ``name`` will give."""
    return DEFERRED + name


def resolve_deferred(requests: DataFrame, resolvers: dict[str, Callable]) -> DataFrame:
    """Deferred values in params, data and provenance replaced by what their resolvers give.

    Each is a function without arguments that returns an awaitable of a text or a list of
    texts; it is awaited once. A key that was automatic is made anew.
    """

    async def all_() -> dict[str, list[str]]:
        out = {}
        for name, fn in resolvers.items():
            made = fn()
            if not inspect.isawaitable(made):
                raise TypeError(f"resolver {name!r} returned {type(made).__name__}, not an awaitable")
            value = await made
            values = [value] if isinstance(value, str) else value
            if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
                raise TypeError(f"resolver {name!r} must give str or list[str], not {type(value).__name__}")
            out[name] = values
        return out

    found = asyncio.run(all_())
    if not found:
        return requests
    rows = requests.withColumn("_automatic", F.coalesce(F.col("dedup_key") == auto_key(), F.lit(False)))
    values = F.create_map(*[x for k, v in found.items() for x in (F.lit(deferred(k)), F.array(*[F.lit(s) for s in v]))])
    for c in ("params", "data"):
        rows = rows.withColumn(c, F.flatten(F.transform(c, lambda p: F.transform(F.coalesce(F.try_element_at(values, p["v"]), F.array(p["v"])), lambda v: F.struct(p["k"].alias("k"), v.alias("v"))))))
    via = F.col("via_json")
    for k, v in found.items():
        via = F.replace(via, F.lit(json.dumps(deferred(k))[1:-1]), F.lit(json.dumps(v[0] if len(v) == 1 else v)[1:-1]))
    rows = rows.withColumn("via_json", via)
    return rows.withColumn("dedup_key", F.when(F.col("_automatic"), auto_key()).otherwise(F.col("dedup_key"))).select(*requests.columns)


def archive_decisions(requests: DataFrame, archive: DataFrame) -> DataFrame:
    """``request_id, download, file_url`` of archive requests: a file that ``archive`` (url,
    file_url) has is used again, any other is downloaded. Where both have a ``dedup_key``, that
    says whether a file is the request's own: of one URL there may be several files."""
    key = "dedup_key" if "dedup_key" in requests.columns and "dedup_key" in archive.columns else "url"
    files = archive.groupBy(key).agg(F.min("file_url").alias("file_url"))
    return requests.filter("archive").join(files, key, "left").select("request_id", F.col("file_url").isNull().alias("download"), "file_url")


#: An ancestor of one row in so many or more is known to all tasks: at most as many are.
HOT = 1000


def met_above(up: DataFrame, other: DataFrame) -> DataFrame:
    """``up`` joined to what ``other`` has for its ``above``, one row each, if anything. In the end all rows
    of a tree have its root above them, so the ancestors of many (at most ``HOT``) are broadcast, and
    their rows stay where they are; the rest, none of them hot, is shuffled. Inputs are read
    more than once."""
    n = up.count()
    many = up.filter("above is not null").groupBy("above").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HOT >= max(n, HOT * HOT))
    hot = stored(many.select("above", F.lit(True).alias("_hot")).join(other, "above", "left"))
    near = up.join(F.broadcast(hot), "above", "left")
    columns = near.drop("_hot").columns
    far = near.filter("_hot is null and above is not null").select(*up.columns).join(other.hint("merge"), "above", "left")
    return near.filter("_hot is not null or above is null").select(*columns).unionByName(far.select(*columns))


def chains(requests: DataFrame) -> DataFrame:
    """``request_id, depth, root_id`` by following parents. Each round doubles the reach of
    every row, so a chain of n requests takes log n joins. Where parents run in a circle
    there is no root: depth and root are null."""
    up = stored(requests.select("request_id", F.col("parent_id").alias("above"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("bigint").alias("depth")))
    most, reach = up.count(), 1
    while True:
        other = up.filter("above is not null").select(F.col("request_id").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        met = stored(met_above(up, other))
        if reach > most or met.filter("next is not null").isEmpty():
            break
        up = met.select("request_id", F.coalesce("next", "above").alias("above"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        reach *= 2
    # a chain has at most as many steps as there are requests: who has gone further goes round
    ended = F.col("next").isNull()
    return met.select("request_id", F.when(ended, F.col("depth")).alias("depth"), F.when(ended, F.coalesce("above", "request_id")).alias("root_id"))


def reseed_points(requests: DataFrame, failed: DataFrame) -> DataFrame:
    """``failed_id, reseed_id, error``: for each failed request, the nearest ancestor, itself
    included, that may be sent again (``reseedable`` true); a false one stops the search, an
    open one is passed over. Each round doubles the reach of every open request, so n open
    ancestors take log n joins. A request below a circle of open ones has none, and an error."""
    passed = F.col("reseedable").isNull() & F.col("parent_id").isNotNull()
    up = requests.select("request_id", F.when(passed, F.col("parent_id")).alias("above"), F.when(F.col("reseedable"), F.col("request_id")).alias("reseed_id"))
    most, reach = requests.count(), 1
    while True:
        up = stored(up)
        if reach > most or up.filter("above is not null").isEmpty():
            break
        other = up.select(F.col("request_id").alias("above"), F.col("above").alias("next"), F.col("reseed_id").alias("found"))
        up = met_above(up, other).select("request_id", F.col("next").alias("above"), F.coalesce("reseed_id", "found").alias("reseed_id"))
        reach *= 2
    found = failed.select(F.col("request_id").alias("failed_id")).join(up.withColumnRenamed("request_id", "failed_id"), "failed_id", "left")
    circle = F.when(F.col("above").isNotNull(), F.lit("the parents run in a circle"))
    return found.select("failed_id", "reseed_id", circle.alias("error"))


def numbered(requests: DataFrame, *order: str) -> DataFrame:
    """``seq`` within each parent, in the given order."""
    return requests.withColumn("seq", F.row_number().over(Window.partitionBy("parent_id").orderBy(*order)))
