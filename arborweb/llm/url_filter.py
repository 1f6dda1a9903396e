"""URL verdicts: listed rules first, then the ratio of two character language models.

The models are variable-order Markov models of accepted and of rejected URLs over up
to ``ORDER`` characters, each order smoothed into the next lower one by Witten-Bell
weights. A URL's score is the mean log ratio over its characters, from the host to the
end of the fragment. DataFrame functions only.

Labels come from words, never from the rules, so no top-level domain or language folder
stands for a label: a URL is rejected if its host has one of ``SPAM``, any other is
accepted. One URL in ``FOLDS``, chosen by a hash of its text, is not counted: those
calibrate the threshold and give the error that ``held_out_error`` reports.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no
rule and is scored as the empty text. Without counted and calibrating URLs of both kinds
every score is 0 and the verdict is allow. A score equal to the threshold is allowed.
Equal URLs get equal verdicts; each row is returned, and a URL that holds many rows is
scored once. An empty table gives an empty result. URLs of any length are read whole;
columns other than the key and the URL are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, met_by_key, spooled

ORDER = 4
#: Characters that the lowest order shares its weight among.
ALPHABET = 256
#: One URL in so many calibrates and is not counted.
FOLDS = 5
#: Grams whose ratios are broadcast; with more, they meet the URLs by a shuffled join.
BROADCAST_GRAMS = 200_000
START, END = "\u0002", "\u0003"

# Words that mark spam hosts.
SPAM = ("casino", "poker", "bets", "betting", "pills", "pharma", "viagra", "cheap", "spam", "porn", "xxx", "adult", "loan", "replica", "track", "ads-", "adserver", "free-", "click", "win-")

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def address(url: Column) -> Column:
    """What follows the first ``://``; nothing if it is null or has none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
    Path: then up to ``?``, ``#`` or the end."""
    rest = address(url)
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; of equally long ones, the
    first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """Every character with the ``ORDER`` - 1 before it."""
    padded = F.concat(F.lit(START * (ORDER - 1)), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - (ORDER - 1)), lambda i: F.substring(padded, i, F.lit(ORDER)))


def ratios(grams: DataFrame) -> DataFrame:
    """``gram, llr`` from ``gram, a, r``: how often each gram stands in accepted and in
    rejected URLs. Counts of shorter grams are sums over their longer forms, as every
    character is counted once at each order, so all orders come from one grouping by suffix."""
    orders = F.explode(F.sequence(F.lit(1), F.lit(ORDER)))
    suffix = grams.select("gram", "a", "r", orders.alias("k")).withColumn("g", F.substring("gram", -F.col("k"), F.col("k")))
    own = suffix.groupBy("k", "g").agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("context", F.substring("g", F.lit(1), F.col("k") - 1))
    above = own.groupBy("k", "context").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"), F.count_if(F.col("a") > 0).alias("da"), F.count_if(F.col("r") > 0).alias("dr"))
    table = own.join(above, ["k", "context"]).select("k", "g", F.struct("k", "a", "r", "ta", "tr", "da", "dr").alias("level"))
    levels = suffix.select("gram", "k", "g").join(table, ["k", "g"]).groupBy("gram").agg(F.sort_array(F.collect_list("level")).alias("levels"))

    def smoothed(c: str) -> Column:
        def up(p: Column, x: Column) -> Column:
            return F.when(x[f"t{c}"] > 0, (x[c] + x[f"d{c}"] * p) / (x[f"t{c}"] + x[f"d{c}"])).otherwise(p)

        return F.aggregate("levels", F.lit(1.0 / ALPHABET), up)

    return levels.select("gram", (F.ln(smoothed("a")) - F.ln(smoothed("r"))).alias("llr"))


def _scored(pages: DataFrame, spam: tuple[str, ...], url: str) -> DataFrame:
    """``text, n, label (a, r), held, score`` of each different URL text; ``n``: its rows."""
    host, _ = host_path(F.col(url))
    rest = address(F.col(url))
    rows = pages.select(host.alias("host"), F.concat(host, F.substring(rest, F.length(host) + 1, F.length(rest))).alias("text"))
    spammy = F.lit(False)
    for word in spam:
        spammy = spammy | F.col("host").contains(word)
    held = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 6), 16, 10).cast("bigint") % FOLDS == 0
    # a URL counts as often as it stands in the table; equal ones are scored once
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.first("host").alias("host"))
    texts = spooled(texts.select("text", "n", F.when(spammy, F.lit("r")).otherwise(F.lit("a")).alias("label"), held.alias("held")))
    exploded = texts.select("text", "label", "n", "held", F.explode(_grams(F.col("text"))).alias("gram"))
    counted = exploded.groupBy("gram").agg(*[F.sum(F.when((F.col("label") == c) & ~F.col("held"), F.col("n")).otherwise(0)).alias(c) for c in ("a", "r")])
    table = spooled(ratios(spooled(counted)))
    few = table.count() <= BROADCAST_GRAMS
    met = exploded.select("text", "label", "n", "held", "gram").join(F.broadcast(table) if few else table, "gram")
    return spooled(met.groupBy("text", "label", "n", "held").agg(F.avg("llr").alias("score")))


def _threshold(scored: DataFrame) -> float | None:
    """Between the mean scores of both labels among the calibrating URLs, by their
    deviations; None if a label is missing there or among the counted ones."""
    n, s = F.col("n"), F.col("score")
    by = {(r["label"], r["held"]): r for r in scored.groupBy("label", "held").agg((F.sum(n * s) / F.sum("n")).alias("m"), (F.sum(n * s * s) / F.sum("n")).alias("q")).collect()}
    if len(by) < 4:
        return None
    m = {c: by[c, True]["m"] for c in "ar"}
    d = {c: max(by[c, True]["q"] - m[c] ** 2, 0.0) ** 0.5 + 1e-9 for c in "ar"}
    return (m["a"] * d["r"] + m["r"] * d["a"]) / (d["a"] + d["r"])


def held_out_error(pages: DataFrame, *, spam: tuple[str, ...] = SPAM, url: str = "url") -> DataFrame:
    """``label, n, wrong`` over the URLs that were not counted: how many of each label there
    are, and how many of them the models take for the other."""
    scored = _scored(pages, spam, url)
    t = _threshold(scored)
    wrong = F.lit(False) if t is None else (F.col("score") >= t) != (F.col("label") == "a")
    return scored.filter("held").groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("wrong"))


def judge(pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, spam: tuple[str, ...] = SPAM, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, score`` of each row."""
    scored = _scored(pages, spam, url)
    t = _threshold(scored)
    said = F.lit("allow") if t is None else F.when(F.col("score") >= t, F.lit("allow")).otherwise(F.lit("block"))
    scores = scored.select("text", "n", said.alias("said"), (F.lit(0.0) if t is None else F.col("score")).alias("score"))
    host, path = host_path(F.col(url))
    rest = address(F.col(url))
    rows = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"), F.concat(host, F.substring(rest, F.length(host) + 1, F.length(rest))).alias("text"))
    met = met_by_key(rows, scores, "text")
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    return met.select(F.col("id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("said")).alias("verdict"), "score")
