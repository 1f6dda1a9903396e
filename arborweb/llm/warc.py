"""Resolution of not-modified revisits in web archives.

A revisit record says that a URL had not changed since an earlier capture. It is
joined as-of, by canonical URL, to the latest full response captured strictly before
it; validators of the two are compared; on a match the response's payload is taken and
its headers are updated with those that a 304 may change.

The as-of join never gathers a URL's records in one task. Captures are reduced to one
point for each URL and time, points are put in order within buckets of
``BUCKET_SECONDS``, and the last response of each bucket is carried to later ones. So a
URL with a third of all records costs a window over its own distinct seconds of one
bucket, and one over its buckets.

Records: ``record_id, url, captured BIGINT (seconds), kind, status, etag,
last_modified, headers MAP<STRING, STRING>, payload_digest``.

Defined results: one row for each revisit with a URL and a time; revisits without
either are ``no_response``. Of responses at the same second the greatest record_id
counts. A revisit without an earlier response is ``no_response``, one without a
validator in common ``no_validator``, one whose validators differ ``mismatch``; these
three keep their own headers and have no payload. Repeated revisits give repeated
rows. Extra columns are not read, whatever their names; values of any length are carried
whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, spooled

BUCKET_SECONDS = 3600

# Header fields that a 304 response may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port, fragment and ``utm_`` parameters gone."""
    plain = F.regexp_replace(url, r"#.*$", "")
    site = lower_ascii(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    site = F.regexp_replace(site, r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    rest = F.regexp_replace(rest, r"(?<=[?&])utm_[^&]*(&|$)", "")
    return F.concat(site, F.regexp_replace(rest, r"[?&]+$", ""))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last counts."""
    pairs = F.map_entries(headers)
    names = F.array_distinct(F.transform(pairs, lambda e: lower_ascii(e["key"])))
    values = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda e: lower_ascii(e["key"]) == n), -1)["value"])
    return F.map_from_arrays(names, values)


def merged(old: Column, new: Column) -> Column:
    """The stored response's headers with the permitted ones of the revisit in their place."""
    fresh = F.map_filter(lower_names(new), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(lower_names(old), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return F.map_concat(kept, fresh)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def as_of(responses: DataFrame, revisits: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``url, captured, source_id`` for each different (url, captured) of ``revisits``: the
    latest of ``responses`` (url, captured, record_id) strictly before it, if any."""
    points = responses.select("url", "captured", "record_id", F.lit(False).alias("asks")).unionByName(revisits.select("url", "captured", F.lit(None).cast(responses.schema["record_id"].dataType).alias("record_id"), F.lit(True).alias("asks")))
    points = points.groupBy("url", "captured").agg(F.max("record_id").alias("record_id"), F.max("asks").alias("asks"))
    points = spooled(points.withColumn("bucket", F.floor(F.col("captured") / bucket_seconds)))
    inside = Window.partitionBy("url", "bucket").orderBy("captured").rowsBetween(Window.unboundedPreceding, -1)
    own = points.withColumn("own", F.last("record_id", ignorenulls=True).over(inside)).filter("asks")
    across = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = points.groupBy("url", "bucket").agg(F.max(F.when(F.col("record_id").isNotNull(), F.struct("captured", "record_id"))).alias("end"))
    carried = ends.select("url", "bucket", F.last("end", ignorenulls=True).over(across)["record_id"].alias("carried"))
    return own.join(carried, ["url", "bucket"]).select("url", "captured", F.coalesce("own", "carried").alias("source_id"))


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``record_id, url, captured, source_id, status, payload_digest, headers`` of each
    revisit in ``records``; ``status`` is resolved, mismatch, no_validator or no_response."""
    rows = spooled(records.select("record_id", canonical_url(F.col("url")).alias("url"), "captured", "kind", "status", "etag", "last_modified", "headers", "payload_digest"))
    full = rows.filter("kind = 'response' and status = 200 and url is not null and captured is not null and record_id is not null")
    revisits = rows.filter("kind = 'revisit'").select("record_id", "url", "captured", "etag", "last_modified", "headers")
    found = spooled(as_of(full, revisits.filter("url is not null and captured is not null"), bucket_seconds))
    source = full.select(F.col("record_id").alias("source_id"), F.col("etag").alias("s_etag"), F.col("last_modified").alias("s_modified"), F.col("headers").alias("s_headers"), F.col("payload_digest").alias("s_digest")).dropDuplicates(["source_id"])
    pointed = spooled(revisits.join(found, ["url", "captured"], "left"))
    met = pointed.filter("source_id is not null").join(source, "source_id", "left")
    # those that point nowhere meet nothing: as nulls of one join key they would all go to one task
    met = met.unionByName(pointed.filter("source_id is null"), allowMissingColumns=True)
    status = (
        F.when(F.col("source_id").isNull(), "no_response")
        .when(F.col("etag").isNotNull() & F.col("s_etag").isNotNull(), F.when(_weak(F.col("etag")) == _weak(F.col("s_etag")), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull() & F.col("s_modified").isNotNull(), F.when(F.col("last_modified") == F.col("s_modified"), "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    ok = F.col("status") == "resolved"
    return met.withColumn("status", status).select(
        "record_id",
        "url",
        "captured",
        "source_id",
        "status",
        F.when(ok, F.col("s_digest")).alias("payload_digest"),
        F.when(ok, merged(F.col("s_headers"), F.col("headers"))).otherwise(lower_names(F.col("headers"))).alias("headers"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log made of ``pages``: of each page two full responses and three revisits at
    hashed times, one with an ETag (for one page in eight a different one), one with a
    modification time (for one in five none), one before the first response."""
    body = F.coalesce(F.col("html"), F.lit(""))
    h = F.md5(F.col("page_id").cast("string").cast("binary"))
    base = pages.select(
        "page_id",
        "url",
        h.alias("h"),
        F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"')).alias("one"),
        F.md5(body.cast("binary")).alias("digest"),
        F.md5(F.concat(body, F.lit("2")).cast("binary")).alias("two"),
    )

    def number(at: int, n: int) -> Column:
        return F.conv(F.substring("h", at, n), 16, 10).cast("long")

    base = base.withColumn("first", F.lit(1_700_000_000) + number(1, 6) % 1_000_000)
    base = base.withColumn("second", F.col("first") + 500_000 + number(7, 4) % 1000)
    first, second, one, digest, two = (F.col(c) for c in ("first", "second", "one", "digest", "two"))
    none = F.lit(None).cast("string")

    def record(n: int, kind: str, at: Column, etag: Column, modified: Column, payload: Column, extra: str) -> Column:
        pairs = F.array(
            F.struct(F.lit("Date").alias("k"), at.cast("string").alias("v")),
            F.struct(F.lit("ETag").alias("k"), etag.alias("v")),
            F.struct(F.lit("Last-Modified").alias("k"), modified.alias("v")),
            F.struct(F.lit("Content-Length").alias("k"), F.lit(extra).alias("v")),
            F.struct(F.lit("Cache-Control").alias("k"), F.lit(f"max-age={n}").alias("v")),
        )
        return F.struct(
            (F.col("page_id") * 5 + n).alias("record_id"),
            at.alias("captured"),
            F.lit(kind).alias("kind"),
            F.lit(200 if kind == "response" else 304).alias("status"),
            etag.alias("etag"),
            modified.alias("last_modified"),
            F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("headers"),
            payload.alias("payload_digest"),
        )

    rows = F.array(
        record(0, "response", first, one, first.cast("string"), digest, "100"),
        record(1, "response", second, none, second.cast("string"), two, "200"),
        record(2, "revisit", first + 250_000, F.when(number(11, 2) % 8 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), one)), none, none, "0"),
        record(3, "revisit", second + 250_000, none, F.when(number(13, 2) % 5 != 0, second.cast("string")), none, "0"),
        record(4, "revisit", first - 10, one, none, none, "0"),
    )
    return base.select("url", F.explode(rows).alias("r")).select("url", "r.*")
