"""Keys of a stream that are sent once, again after failures, and forgotten."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from arborweb.storage import streamed
from arborweb.streaming.retries import KINDS, Rules, Sent, rocksdb, settled, stream_sends, told


def test_the_rules():
    r = Rules(retries=2, delay=10, keep=100)
    state, said = told(None, "request", 5, r)
    assert said == [("send", 1, 5)] and told(state, "request", 6, r) == (state, [])
    state, said = told(state, "failed", 7, r)
    assert (state, said) == (Sent(1, 7, 17), []) and told(state, "ok", 9, r) == (state, [])
    state, said = told(state, "failed", 20, r)
    assert (state, said) == (Sent(2, 20, 40), [("send", 2, 17)])
    state, said = told(state, "failed", 41, r)
    assert (state, said) == (Sent(3, 41, None, True), [("send", 3, 40), ("give up", 3, 41)])
    assert told(state, "request", 141, r) == (state, []) and told(state, "request", 142, r) == (Sent(1, 142), [("send", 1, 142)])
    assert told(None, "failed", 1, r) == (None, []) and settled(None, 1, r) == (None, [])
    for bad in ((-1, 1, 1), (0, 0, 1), (0, 1, 0)):
        with pytest.raises(ValueError):
            Rules(*bad)


def test_batches_do_not_matter(spark, tmp_path):
    """The same rows in one batch and in twelve: what is sent is what the rules say of all rows in order."""
    draw = random.Random(1)
    rows = sorted((draw.randint(0, 4_000_000), draw.choice("abcdef"), draw.choice(["request", "request", "failed", "ok"])) for _ in range(400))
    rules, want = Rules(1, 20_000, 60_000), []
    last = max(t for t, _, _ in rows)
    for key in "abcdef":
        state = None
        for t, _, kind in sorted((r for r in rows if r[1] == key), key=lambda r: (r[0], KINDS.index(r[2]))):
            state, said = told(state, kind, t, rules)
            want += [(key, *s) for s in said]
        # the watermark sends what is due by its time
        want += [(key, *s) for s in settled(state, last - 1000, rules)[1]]
    at = lambda t: datetime.fromtimestamp(t / 1000, timezone.utc).replace(tzinfo=None)
    table = [(k, kind, at(t)) for t, k, kind in rows]
    odd = [(None, "request", at(5)), ("a", None, at(5)), ("a", "else", at(5)), ("a", "request", None)]
    schema = "dedup_key STRING, kind STRING, at TIMESTAMP"
    size = -(-len(table) // 12)
    for n in range(12):
        part = table[n * size : (n + 1) * size] + (odd if n == 0 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "rows" / f"part={n:02}"))
    for files in (1, 100):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "rows"))
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        with rocksdb(spark):
            sends = streamed(stream_sends(source.select("dedup_key", "kind", "at"), retries=1, delay=20, keep=60, late="1 second"))
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
        got = [(r["dedup_key"], r["decision"], r["attempt"], r["ms"]) for r in sends.withColumn("ms", F.unix_millis("at")).collect()]
        assert sorted(got) == sorted(want) and len(got) > 100
