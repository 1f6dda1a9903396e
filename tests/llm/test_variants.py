import random
import re
import zlib
from collections import Counter

from arborweb.llm import variants


def brute(rows, shortest=7, least=2, times=10):
    """Every pair of words compared."""
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                count[run] += 1
    known = {w: n for w, n in count.items() if n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w, n in known.items():
        others = [x for x in known if near(w, x)]
        best = min(others, key=lambda x: (-known[x], x), default=None)
        out[w] = [best if best is not None and known[best] >= times * n else None, None, n, len(others), None]
    for w, row in out.items():
        end = w
        while out[end][0] is not None:
            end = out[end][0]
        row[1], row[4] = end, known.get(row[0])
    return {w: tuple(r) for w, r in out.items()}


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id LONG, text STRING, word STRING, n INT")
    got = variants.variants(docs, **how)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {r["word"]: tuple(r)[1:] for r in got.collect()}


def test_against_all_pairs(spark):
    draw = random.Random(5)
    base = ["elephant", "elephants", "Élephant", "ELEPHANT", "eleph×nt", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "mmmmmmmx", "letters", "lettres", "settler"]
    words = []
    for w in base:
        for _ in range(6):
            k = draw.randrange(len(w))
            words.append(draw.choice([w, w, w[:k] + w[k + 1 :], w[:k] + draw.choice("abcé") + w[k:], w[:k] + draw.choice("abcé") + w[k + 1 :]]))
    rows = [(draw.randrange(40), draw.choice(" .-1_Ā").join(draw.choices(words, weights=[1 + 40 * (k % 6 == 0) for k in range(len(words))], k=60))) for _ in range(150)]
    rows += [(None, "elephant Elephant"), (None, None), (1, ""), (1, "  "), (2, "elephant"), (2, "elephant")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, times=2, least=1) == brute(rows, times=2, least=1)


def test_forms_are_followed_to_the_last(spark):
    rows = [(k, "abcdefgh") for k in range(400)] + [(k, "abcdefgx") for k in range(30)] + [(k, "abcdefyx") for k in range(2)]
    got = found(spark, rows)
    assert got == brute(rows) and got["abcdefyx"][:2] == ("abcdefgx", "abcdefgh")


def test_long_words(spark):
    """Words around the length from which groups are named by sums, and one of a million letters."""
    draw = random.Random(9)
    rows = []
    for size in (63, 64, 65, 66, 67, 130):
        w = "".join(draw.choice("abc") for _ in range(size))
        for v in (w, w[:5] + w[6:], w[:-1], w[:10] + "z" + w[10:], w[:20] + "q" + w[21:], w + "b"):
            rows += [(draw.randrange(1000), v) for _ in range(draw.choice((2, 3, 40)))]
    rows += [(k, "x" * 300) for k in range(3)] + [(k, "x" * 301) for k in range(40)]
    assert found(spark, rows) == brute(rows)
    long = "x" * 1_000_000
    got = found(spark, [(1, long), (2, long), (3, long[1:]), (4, long[1:])])
    assert {len(w): r[2:4] for w, r in got.items()} == {1_000_000: (2, 1), 999_999: (2, 1)}


def test_an_empty_table_and_texts_without_words(spark):
    assert found(spark, []) == {} == found(spark, [(1, None), (2, "short words 12345678 ????????")])
