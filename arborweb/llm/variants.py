"""Groups of spelling variants: words one edit apart, by wildcard groups instead of pairs.

Words that differ in one replaced code point share the group (place, what stands before it,
what stands after it): a group keeps how many words it has and the two most frequent, so each
member knows how many others there are and the best of them. A word with a code point deleted
meets the vocabulary in the group of that spelling: the word found there and those it was
deleted from are near. A member of a group gets one row back, however many others the group has;
no pair of words is ever a row. A group holds at most one word for each place and letter, so
none is hot.

Words have numbers in code-point order, so groups carry numbers instead of words. Words of more
than ``LONG`` code points have groups that are named by two sums of products with fixed random
numbers instead of text, so that a word of a million letters has a million short rows.

Defined results: a null id counts as empty in the hash of a run; null texts have no words;
repeated rows count each. Texts and runs of any length are read whole. Of near words with equal
counts the first in code-point order is the form. An empty table gives an empty result.
Columns other than the key and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, map_arrow, stored

#: Code points and occurrences that a word has at least.
SHORTEST, LEAST = 7, 2
#: A form is so many times as frequent as the word.
TIMES = 10
#: A run's hash that this divides loses a code point.
ONE_IN = 31
#: Longer words have their groups named by sums.
LONG = 64
#: Stands for the replaced code point; no word has it.
WILD = "*"
REPLACED, DELETED, OWN = 0, 1, 2


def occurrences(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``word, n`` of all words of at least ``shortest`` code points: runs of letters with A-Z
    lower-cased, and some, by the hash of id and run, without one code point."""
    # a shorter run gives no word
    runs = docs.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), lower_ascii(F.col("run"))).otherwise(F.col("run"))
    runs = runs.select(low.alias("run"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % ONE_IN == 0, without(F.col("run"), at + 1)).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def without(word: Column, place: Column) -> Column:
    """``word`` without the code point at ``place``, from 1."""
    return F.concat(F.substr(word, F.lit(1), place - 1), F.substr(word, place + 1))


def numbered(words: DataFrame) -> DataFrame:
    """``id, word, n`` with ids that rise in code-point order. Both tables are written: the
    ranges are drawn from the first, the ids stay as they are in the second."""
    ranged = stored(words).repartitionByRange("word").sortWithinPartitions("word")
    return stored(ranged.select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def groups(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``id, n, kind, name``: the groups of each word: one for each place (``REPLACED``), one for
    each spelling with a code point deleted (``DELETED``), one of its own spelling (``OWN``)."""
    w, size = F.col("word"), F.length("word")
    places = F.sequence(F.lit(1), size)
    wild = F.transform(places, lambda k: F.concat(F.substr(w, F.lit(1), k - 1), F.lit(WILD), F.substr(w, k + 1)))
    cut = F.when(size > shortest, F.array_distinct(F.transform(places, lambda k: without(w, k)))).otherwise(F.expr("cast(array() as array<string>)"))

    def named(kind: int, names: Column) -> Column:
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    plain = words.filter(size <= LONG).select("id", "n", F.inline(F.concat(named(REPLACED, wild), named(DELETED, cut), named(OWN, F.array(w)))))
    return plain.unionByName(map_arrow(words.filter(size > LONG).select("id", "n", "word"), _long, T.StructType.fromDDL("id BIGINT, n BIGINT, kind INT, name STRING")))


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, word in enumerate(batch.column(2).to_pylist()):
            rows = list(long_groups(word))
            for lo in range(0, len(rows), 10_000):
                some = rows[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(some))), batch.column(1).take(pa.array([k] * len(some))), pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.string())], names=["id", "n", "kind", "name"])


def long_groups(word: str) -> Iterator[tuple[int, str]]:
    """(kind, name) of a word of more than ``LONG`` code points, in time linear in it. A sum has a
    term for each code point, its number times a random number of its place, so the sum of a
    changed word is told from the sums of the parts around the change."""
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = len(code)
    # two odd numbers for each place, the same however long the word
    draw = np.random.default_rng(62).integers(0, 1 << 63, (size, 2), np.uint64).T * np.uint64(2) + np.uint64(1)
    term = code * draw
    before = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(term, 1)], 1)
    whole = before[:, -1:]
    for k, (a, b) in enumerate(zip(*(whole - term).tolist(), strict=True)):
        yield REPLACED, f"{size}:{k}:{a:x}:{b:x}"
    # of a run of equal code points each deletion gives the same
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    if size - 1 > LONG:
        moved = np.cumsum(code[1:] * draw[:, :-1], 1)
        after = np.concatenate([np.zeros((2, 1), np.uint64), moved], 1)
        sums = before[:, :-1] + after[:, -1:] - after
        for a, b in zip(*sums[:, first].tolist(), strict=True):
            yield DELETED, f"{size - 1}:{a:x}:{b:x}"
    else:
        for k in first.tolist():
            yield DELETED, word[:k] + word[k + 1 :]
    yield OWN, f"{size}:{int(whole[0, 0]):x}:{int(whole[1, 0]):x}"


def best_near(grouped: DataFrame) -> DataFrame:
    """``id, n_near, best STRUCT<minus_n, id>`` of words that have near ones. One shuffle brings
    a group's rows together, at most a few thousand; each then knows how many others the group
    has and the best of them."""
    of = Window.partitionBy("name").orderBy("kind", F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("minus_n"), F.col("id"))
    rows = grouped.withColumns({"size": F.count(F.lit(1)).over(of), "first": F.first(entry).over(of), "second": F.nth_value(entry, 2).over(of), "own": F.max(F.when(F.col("kind") == OWN, entry)).over(of)})
    rows = rows.filter(F.col("size") > 1)
    deleted = F.col("kind") == DELETED
    near = F.when(deleted, F.when(F.col("own").isNotNull(), 1).otherwise(0)).otherwise(F.col("size") - 1)
    # the own spelling comes last in its group, after all that were cut down to it
    best = F.when(deleted, F.col("own")).when(F.col("first")["id"] == F.col("id"), F.col("second")).otherwise(F.col("first"))
    found = rows.select("id", near.cast("bigint").alias("near"), best.alias("best")).filter("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` of ``forms (id, form)`` by following forms to the last. A form is
    ``TIMES`` as frequent, so chains are short, and each round doubles their reach."""
    now = stored(forms.select("id", F.col("form").alias("root")))
    while True:
        above = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        met = now.join(above, "root", "left")
        if met.filter("next is not null").isEmpty():
            return now
        now = stored(met.select("id", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word with ``least`` occurrences."""
    words = numbered(occurrences(docs, key=key, text=text, shortest=shortest).filter(F.col("n") >= least))
    near = words.join(best_near(groups(words, shortest)), "id", "left")
    found = stored(
        near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(-F.col("best.minus_n") >= times * F.col("n"), F.struct(F.col("best.id").alias("id"), (-F.col("best.minus_n")).alias("n"))).alias("f"))
    )
    chained = roots(found.filter("f is not null").select("id", F.col("f.id").alias("form")))
    spelled = words.select("id", "word")
    ends = found.filter("f is not null").select("id", "f").join(chained, "id")
    ends = ends.join(spelled.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    ends = ends.join(spelled.select(F.col("id").alias("form_id"), F.col("word").alias("form")), F.col("f.id") == F.col("form_id"))
    ends = ends.select("id", "form", "root_word", F.col("f.n").alias("form_n"))
    return found.select("id", "word", "n", "n_near").join(ends, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
