"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of
labelled documents. It labels every byte position of every text; a document's
probabilities are the mean over its positions.

Texts are lower-cased and cut into segments of ``SEGMENT`` bytes that are run side
by side; the recurrent state starts at zero in each segment, in training as in
prediction, so a result depends on the document alone.

Defined results: a text that is null or has no letter is ``und`` with score 0. Ties
go to the language that sorts first. If no row can be learned from, every text is
``und``. Prediction reads the text only, never the label, source or id. Repeated rows are
judged each by itself, and alike; in the sample they count once. Texts of any length are
read whole, segment by segment. Other columns are not read, whatever their names; ``keep``
hands them on. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, remainder, slices, utf8

SEGMENT = 64
HIDDEN = 16
#: Segments run side by side.
WIDTH = 2048
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a text has a character of Unicode's letter categories: digits, fractions,
    numerals in circles and Roman numeral signs are none."""
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """Weights by direction (0 forward, 1 backward): ``x`` (3H, 256) input columns,
    ``u`` (3H, H) recurrent, ``c`` (H,) bias of the recurrent candidate; ``o`` (C, 2H)
    and ``b`` (C,) the output layer. Gate rows: update, reset, candidate."""

    langs: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    c: list[np.ndarray]
    o: np.ndarray
    b: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.x, *self.u, *self.c, self.o, self.b]


def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 42) -> Model:
    draw = np.random.default_rng(seed)

    def w(rows: int, cols: int, scale: float) -> np.ndarray:
        return (draw.standard_normal((rows, cols)) * scale).astype(np.float32)

    h, n = hidden, len(langs)
    return Model(
        langs,
        [w(3 * h, 256, 0.5) for _ in range(2)],
        [w(3 * h, h, h**-0.5) for _ in range(2)],
        [np.zeros(h, np.float32) for _ in range(2)],
        w(n, 2 * h, (2 * h) ** -0.5),
        np.zeros(n, np.float32),
    )


def _sigmoid(x: np.ndarray) -> None:
    """In place, from the exponential function, which numpy computes faster than tanh."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _step(m: Model, d: int, byte: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The next state of direction ``d``. The candidate's tanh is 2 sigmoid(2x) - 1."""
    n = h.shape[0]
    # a byte is never out of range: "clip" spares the test for it
    gx = np.take(m.x[d], byte, axis=1, mode="clip")
    gh = m.u[d] @ h
    gates = gx[: 2 * n]
    gates += gh[: 2 * n]
    _sigmoid(gates)
    z, r = gates[:n], gates[n:]
    inner = gh[2 * n :]
    inner += m.c[d][:, None]
    cand = gx[2 * n :]
    cand += r * inner
    cand *= 2
    _sigmoid(cand)
    cand *= 2
    cand -= 1
    new = h - cand
    new *= z
    new += cand
    if keep is not None:
        keep.append((h, z, r, inner, cand))
    return new


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def position_probabilities(m: Model, data: np.ndarray) -> np.ndarray:
    """For segments ``data`` (SEGMENT, n) of bytes, 0 where padded: probabilities of each
    position, (SEGMENT, C, n). A padded position lies after a text's end; the state is
    held at zero there, so the backward pass starts afresh at the last byte."""
    steps, n = data.shape
    hidden = m.u[0].shape[1]
    real = (data > 0).astype(np.float32)
    ahead = np.empty((steps, hidden, n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    for t in range(steps):
        ahead[t] = h = _step(m, 0, data[t], h)
    out = np.empty((steps, len(m.langs), n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    left, right = np.ascontiguousarray(m.o[:, :hidden]), np.ascontiguousarray(m.o[:, hidden:])
    for t in range(steps - 1, -1, -1):
        h = _step(m, 1, data[t], h)
        h *= real[t]
        out[t] = _softmax(left @ ahead[t] + right @ h + m.b[:, None])
    return out


def pooled(m: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, C): the mean over a text's bytes of their probabilities; zeros for no bytes."""
    sums = np.zeros((len(texts), len(m.langs)))
    # a zero byte inside a text counts as a space, as zero marks the padding
    texts = [t.replace(b"\0", b" ") for t in texts]
    pieces, owner, held = [], [], 0

    def flush() -> None:
        data = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, SEGMENT)
        own = np.concatenate(owner)
        for at in range(0, len(data), WIDTH):
            block = np.ascontiguousarray(data[at : at + WIDTH].T)
            p = position_probabilities(m, block)
            p *= (block > 0)[:, None, :]
            np.add.at(sums, own[at : at + WIDTH], p.sum(axis=0, dtype=np.float64).T)

    for k, t in enumerate(texts):
        segments = -(-len(t) // SEGMENT)
        if segments:
            pieces.append(t.ljust(segments * SEGMENT, b"\0"))
            owner.append(np.full(segments, k))
            held += segments
            if held >= WIDTH:
                flush()
                pieces, owner, held = [], [], 0
    if held:
        flush()
    return sums / np.maximum(1, [len(t) for t in texts])[:, None]


def _gradients(m: Model, data: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over all real positions, in the order of
    ``weights()``, by backpropagation through time."""
    steps, n = data.shape
    hidden, real = m.u[0].shape[1], (data > 0).astype(np.float32)
    total = real.sum()
    saved: list[list] = [[], []]
    states: list[list] = [[None] * steps, [None] * steps]
    for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
        h = np.zeros((hidden, n), np.float32)
        for t in order:
            h = _step(m, d, data[t], h, saved[d])
            if d:
                h *= real[t]
            states[d][t] = h
    target = np.eye(len(m.langs), dtype=np.float32)[label].T
    g_o, g_b = np.zeros_like(m.o), np.zeros_like(m.b)
    into: list[list] = [[None] * steps, [None] * steps]
    for t in range(steps):
        both = np.concatenate([states[0][t], states[1][t]])
        err = (_softmax(m.o @ both + m.b[:, None]) - target) * (real[t] / total)
        g_o += err @ both.T
        g_b += err.sum(axis=1)
        back = m.o.T @ err
        into[0][t], into[1][t] = back[:hidden], back[hidden:]
    g_x, g_u, g_c = [], [], []
    # the columns of all inputs are summed by byte in one go
    by_byte = np.argsort(data, axis=None, kind="stable")
    seen, begins = np.unique(data.ravel()[by_byte], return_index=True)
    inputs = np.empty((steps, n, 3 * hidden), np.float32)
    for d, order in ((0, range(steps - 1, -1, -1)), (1, range(steps))):
        gx, gu, gc = np.zeros((256, 3 * hidden), np.float32), np.zeros_like(m.u[d]), np.zeros_like(m.c[d])
        carry = np.zeros((hidden, n), np.float32)
        for t in order:
            h, z, r, inner, cand = saved[d].pop()
            dh = carry + into[d][t]
            if d:
                dh = dh * real[t]
            dz = dh * (h - cand) * z * (1 - z)
            dc = dh * (1 - z) * (1 - cand * cand)
            dr = dc * inner * r * (1 - r)
            di = dc * r
            inputs[t] = np.concatenate([dz, dr, dc]).T
            dg = np.concatenate([dz, dr, di])
            gu += dg @ h.T
            gc += di.sum(axis=1)
            carry = dh * z + m.u[d].T @ dg
        gx[seen] = np.add.reduceat(inputs.reshape(-1, 3 * hidden)[by_byte], begins)
        g_x.append(gx.T)
        g_u.append(gu)
        g_c.append(gc)
    return [*g_x, *g_u, *g_c, g_o, g_b]


def fit(samples: list[tuple[str, bytes]], steps: int = 300, batch: int = 192, rate: float = 0.01, seed: int = 42) -> Model | None:
    """Train on (language, text) pairs with Adam; the same pairs give the same model.
    Windows are drawn evenly over the languages."""
    by: dict[str, list[bytes]] = {}
    for lang, text in sorted(samples):
        if text.strip():
            by.setdefault(lang, []).append(text.replace(b"\0", b" "))
    if not by:
        return None
    langs = sorted(by)
    m, draw = fresh(langs, seed=seed), np.random.default_rng(seed)
    first, second = [np.zeros_like(w) for w in m.weights()], [np.zeros_like(w) for w in m.weights()]
    for k in range(1, steps + 1):
        label = draw.integers(0, len(langs), batch)
        windows = []
        for i in label:
            t = by[langs[i]][draw.integers(len(by[langs[i]]))]
            at = draw.integers(0, max(1, len(t) - SEGMENT // 2))
            windows.append(t[at : at + SEGMENT].ljust(SEGMENT, b"\0"))
        data = np.ascontiguousarray(np.frombuffer(b"".join(windows), np.uint8).reshape(batch, SEGMENT).T)
        grads = _gradients(m, data, label)
        size = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
        now = rate * (1 - 0.9 * k / steps)
        for w, g, a, b in zip(m.weights(), grads, first, second, strict=True):
            g = g / size
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= now * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-6)
    return m


def train(docs: DataFrame, *, per_lang: int = 400, max_langs: int = 64, chars: int = 512, key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 5, held: int = 0, steps: int = 300) -> Model | None:
    """Fit on a bounded sample of the labelled rows whose crc32(key) mod ``modulus`` is not
    ``held``: about ``per_lang`` rows of every language, chosen by a hash of key and text, so
    that rows of one key are drawn each by itself, and of each a passage of ``chars``
    characters at a hashed place; repeated rows count once. Above ``max_langs`` languages there
    are fewer rows of each, 16 at least, and more steps: up to 1,600 languages, about 13 MB of
    text reach the driver."""
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(F.col("t").isNotNull() & F.col("l").isNotNull() & (remainder(F.col("k"), modulus) != held))
    counts = known.groupBy("l").count().collect()
    if not counts:
        return None
    if len(counts) > max_langs:
        per_lang = min(per_lang, max(16, per_lang * max_langs // len(counts)))
        steps = -(-steps * len(counts) // max_langs)
    h = F.pmod(F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit("")), F.col("t"), F.lit(7)), F.lit(1 << 40))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["l"], min(1.0, per_lang / r["count"]))])
    place = F.pmod(F.xxhash64("t", F.lit(11)), F.greatest(F.lit(1), F.length("t") - F.lit(chars))).cast("int")
    drawn = known.filter(h < share[F.col("l")] * float(1 << 40)).select("l", F.substring(F.col("t"), place + 1, F.lit(chars)).alias("t")).distinct()
    # in one order, however the rows came
    rows = sorted((r["l"], r["t"]) for r in drawn.collect())
    return fit([(lang, utf8(t.lower())) for lang, t in rows], steps=steps)


def _judge(m: Model | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    if m is None:
        return out
    with_letter = [k for k, t in enumerate(texts) if t and has_letter(t)]
    p = pooled(m, [utf8(texts[k].lower()) for k in with_letter])
    for k, row in zip(with_letter, p, strict=True):
        best = int(row.argmax())
        out[k] = (m.langs[best], min(1.0, float(row[best])))
    return out


def predict(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text", modulus: int = 5, held: int = 0) -> DataFrame:
    """``key, held_out, lang_pred, score`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            said = _judge(sent.value, batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "held_out", "lang_pred", "score"])

    schema = T.StructType([docs.schema[key], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(docs.select(key, (remainder(F.col(key), modulus) == held).alias("held_out"), text), run, schema)


def keep(docs: DataFrame, model: Model | None, *, least: float = 0.3, langs: list[str] | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a known language with a score of
    ``least`` or more, and one of ``langs`` if given."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            said = _judge(sent.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least and (langs is None or lang in langs) for lang, score in said], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
