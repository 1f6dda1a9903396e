from pyspark.sql import functions as F

from arborweb.llm import warc

SCHEMA = "record_id LONG, url STRING, captured LONG, kind STRING, status INT, etag STRING, last_modified STRING, headers MAP<STRING, STRING>, payload_digest STRING, source_id STRING"


def rec(i, url, at, kind="response", status=200, etag=None, modified=None, headers=None, digest=None):
    return (i, url, at, kind, status, etag, modified, headers if headers is not None else {"Date": str(at)}, digest, "clash")


ROWS = [
    rec(1, "HTTP://Ex.org:80/a?utm_source=x&b=1#top", 100, etag='"v1"', headers={"ETag": '"v1"', "Content-Length": "5", "Cache-Control": "max-age=1"}, digest="d1"),
    rec(2, "http://ex.org/a?b=1", 200, etag='"v2"', modified="m2", digest="d2"),
    rec(3, "http://ex.org/a?b=1", 200, etag='"v2x"', digest="d3"),
    rec(4, "http://ex.org/a?b=1", 300, status=404, etag='"v2x"', digest="d4"),
    rec(10, "http://ex.org/a?b=1", 50, "revisit", 304, '"v1"'),
    rec(11, "http://ex.org/a?b=1", 100, "revisit", 304, '"v1"'),
    rec(12, "http://ex.org/a?b=1", 150, "revisit", 304, 'W/"v1"', headers={"Cache-Control": "max-age=9", "Content-Length": "0", "Date": "150"}),
    rec(13, "http://ex.org/a?b=1", 250, "revisit", 304, '"v2"'),
    rec(14, "http://ex.org/a?b=1", 99999, "revisit", 304, '"v2x"'),
    rec(15, "http://ex.org/a?b=1", 99999, "revisit", 304, None, "m9"),
    rec(16, None, 100, "revisit", 304, '"v1"'),
    rec(17, "http://ex.org/a?b=1", None, "revisit", 304, '"v1"'),
    rec(20, "http://other.org/", 10, modified="m", digest="o"),
    rec(21, "http://other.org/", 4000, "revisit", 304, '"e"', "m"),
    rec(21, "http://other.org/", 4000, "revisit", 304, '"e"', "m"),
    rec(22, "http://other.org/", 4001, "revisit", 304, '"e"', "no"),
]


def test_resolution(spark):
    for bucket in (1, 60, 3600, 10**9):
        got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(ROWS, SCHEMA), bucket).collect()}
        assert {i: (r["status"], r["source_id"], r["payload_digest"]) for i, r in got.items()} == {
            10: ("no_response", None, None),
            11: ("no_response", None, None),
            12: ("resolved", 1, "d1"),
            13: ("mismatch", 3, None),
            14: ("resolved", 3, "d3"),
            15: ("no_validator", 3, None),
            16: ("no_response", None, None),
            17: ("no_response", None, None),
            21: ("resolved", 20, "o"),
            22: ("mismatch", 20, None),
        }
        assert got[12]["headers"] == {"cache-control": "max-age=9", "content-length": "5", "date": "150", "etag": '"v1"'}
        assert got[13]["headers"] == {"date": "250"}


def test_each_revisit_has_a_row(spark):
    got = warc.resolve_revisits(spark.createDataFrame(ROWS, SCHEMA))
    assert got.count() == sum(r[3] == "revisit" for r in ROWS)
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_canonical_url(spark):
    cases = {
        "HTTPS://Ex.ORG:443/A?x=1#f": "https://ex.org/A?x=1",
        "http://ex.org:8080/": "http://ex.org:8080/",
        "http://ex.org?utm_a=1": "http://ex.org",
        "http://ex.org/?a=1&utm_b=2&c=3": "http://ex.org/?a=1&c=3",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u STRING").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in df.collect()} == cases


def test_names_that_differ_in_case(spark):
    m = F.create_map(*[F.lit(x) for x in ("ETag", "1", "Date", "d", "etag", "2")])
    assert spark.range(1).select(warc.lower_names(m).alias("h")).first()["h"] == {"etag": "2", "date": "d"}


def test_default_port_of_a_long_authority(spark):
    name = "a" * 400
    df = spark.createDataFrame([(f"http://{name}:80/x",), (f"https://{name}:443",), (f"https://{name}:80/",)], "u STRING")
    assert [r["c"] for r in df.select(warc.canonical_url(F.col("u")).alias("c")).collect()] == [f"http://{name}/x", f"https://{name}", f"https://{name}:80/"]
