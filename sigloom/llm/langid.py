"""Language ID by a bidirectional gated recurrent network over UTF-8 bytes.

Both directions read every byte of a text; a softmax over their joined states
labels every position, and a document's probabilities are the mean over its
positions. The network is trained here, in numpy, by backpropagation through
time on a bounded sample of labelled windows. Gates use the softsign
x / (1 + |x|) in place of tanh (and half of one plus it in place of the logistic
function): the same shape without exponentials, which dominate at one byte a step.
States start afresh every ``SPAN`` bytes, so long texts are read as many
independent windows, whole and in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = 8
SPAN = 128
#: The training sample: so many documents of each language, and windows of so many characters from each.
PER_LANGUAGE, WINDOWS, WINDOW = 500, 4, 64
STEPS, BATCH, RATE = 900, 64, 0.02
LETTER = regex.compile(r"\p{L}")
BLOCK = 2048
UNDETERMINED = "und"


@dataclass
class Direction:
    x: np.ndarray  # (256, 3h): what each byte adds to update, reset and candidate
    u: np.ndarray  # (h, 3h)
    b: np.ndarray  # (3h,)
    c: np.ndarray  # (h,): inside the reset of the candidate


@dataclass
class Model:
    langs: list[str]
    sides: list[Direction]
    out: list[np.ndarray]  # two of (h, classes)
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [p for d in self.sides for p in (d.x, d.u, d.b, d.c)] + [*self.out, self.bias]


def new_model(langs: list[str], hidden: int, seed: int, dtype=np.float32) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(dtype)
    sides = [Direction(draw(256, 3 * hidden, scale=0.5), draw(hidden, 3 * hidden, scale=hidden**-0.5), np.zeros(3 * hidden, dtype), np.zeros(hidden, dtype)) for _ in range(2)]
    return Model(langs, sides, [draw(hidden, len(langs), scale=0.5) for _ in range(2)], np.zeros(len(langs), dtype))


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _forward(d: Direction, x: np.ndarray) -> tuple[np.ndarray, list]:
    """x (T, B) bytes -> states (T, B, h) and what the backward pass needs."""
    n = d.u.shape[0]
    h = np.zeros((x.shape[1], n), d.u.dtype)
    states, kept = np.empty((*x.shape, n), d.u.dtype), []
    for t, row in enumerate(x):
        g, m = d.x[row] + d.b, h @ d.u
        zs, rs = _soft(g[:, :n] + m[:, :n]), _soft(g[:, n : 2 * n] + m[:, n : 2 * n])
        z, r = (1 + zs) / 2, (1 + rs) / 2
        inner = m[:, 2 * n :] + d.c
        c = _soft(g[:, 2 * n :] + r * inner)
        kept.append((row, h, zs, rs, z, r, inner, c))
        h = z * h + (1 - z) * c
        states[t] = h
    return states, kept


def _backward(d: Direction, kept: list, grad: np.ndarray) -> list[np.ndarray]:
    """grad (T, B, h) of the loss by the states -> gradients of x, u, b, c."""
    n = d.u.shape[0]
    gx, gu, gb, gc = (np.zeros_like(p) for p in (d.x, d.u, d.b, d.c))
    dh = np.zeros_like(grad[0])
    for t in range(len(kept) - 1, -1, -1):
        row, h, zs, rs, z, r, inner, c = kept[t]
        dh = dh + grad[t]
        da = dh * (1 - z) * (1 - np.abs(c)) ** 2
        dz = dh * (h - c) * (1 - np.abs(zs)) ** 2 / 2
        dr = da * inner * (1 - np.abs(rs)) ** 2 / 2
        di = da * r
        into = np.concatenate([dz, dr, da], 1)
        back = np.concatenate([dz, dr, di], 1)
        np.add.at(gx, row, into)
        gb += into.sum(0)
        gc += di.sum(0)
        gu += h.T @ back
        dh = dh * z + back @ d.u.T
    return [gx, gu, gb, gc]


def loss_and_gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of x (T, B); y (B,) classes."""
    f, kf = _forward(m.sides[0], x)
    b, kb = _forward(m.sides[1], x[::-1])
    b = b[::-1]
    logits = f @ m.out[0] + b @ m.out[1] + m.bias
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    cols = np.arange(x.shape[1])
    loss = -np.log(np.maximum(p[:, cols, y], 1e-30)).mean()
    p[:, cols, y] -= 1
    p /= x.size
    flat = lambda s: s.reshape(-1, s.shape[-1])
    grads = [*_backward(m.sides[0], kf, p @ m.out[0].T), *_backward(m.sides[1], kb, (p @ m.out[1].T)[::-1])]
    return float(loss), [*grads, flat(f).T @ flat(p), flat(b).T @ flat(p), flat(p).sum(0)]


def train(samples: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 11) -> Model | None:
    """Fit on (window, language) pairs, each language drawn equally often; None without any."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    model = new_model(langs, hidden, seed)
    if len(langs) == 1:
        return model
    rows = {k: [np.frombuffer(t.encode("utf-8", "replace")[:WINDOW].ljust(WINDOW), np.uint8) for t, g in samples if g == k] for k in langs}
    pools = [np.stack(rows[k]) for k in langs]
    params = model.params()
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), BATCH)
        x = np.stack([pools[k][rng.integers(len(pools[k]))] for k in y]).T
        _, grads = loss_and_gradients(model, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1))) * min(1, 1 / max(norm, 1e-9))
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return model


def _states(d: Direction, x: np.ndarray, states: np.ndarray, order: range) -> None:
    """The forward pass without what training keeps, in place and one gate at a time."""
    n = d.u.shape[0]
    tables = [np.ascontiguousarray(d.x[:, i * n : i * n + n] + d.b[i * n : i * n + n]) for i in range(3)]
    mats = [np.ascontiguousarray(d.u[:, i * n : i * n + n]) for i in range(3)]
    h = np.zeros(states.shape[1:], np.float32)
    z, r, c, m, size = (np.empty_like(h) for _ in range(5))
    for t in order:
        for table, mat, g in zip(tables, mats, (z, r)):
            np.take(table, x[t], axis=0, out=g, mode="clip")
            g += np.matmul(h, mat, out=m)
            np.abs(g, out=size)
            size += 1
            g /= size
            g += 1
            g *= 0.5
        np.matmul(h, mats[2], out=m)
        m += d.c
        m *= r
        np.take(tables[2], x[t], axis=0, out=c, mode="clip")
        c += m
        np.abs(c, out=size)
        size += 1
        c /= size
        h -= c
        h *= z
        h += c
        states[t] = h


def probabilities(model: Model, texts: list[bytes], span: int = SPAN) -> np.ndarray:
    """(documents, classes): the mean of the positions' probabilities; zeros for an empty text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    per = -(-size // span)
    doc = np.repeat(np.arange(len(texts)), per)
    data = np.frombuffer(b"".join(t.ljust(n * span) for t, n in zip(texts, per.tolist())), np.uint8).reshape(-1, span)
    valid = np.minimum(span, size[doc] - span * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)))
    total = np.zeros((len(texts), len(model.langs)))
    for i in range(0, len(data), BLOCK):
        x = np.ascontiguousarray(data[i : i + BLOCK].T).astype(np.intp)
        f, b = (np.empty((*x.shape, model.out[0].shape[0]), np.float32) for _ in range(2))
        _states(model.sides[0], x, f, range(span))
        _states(model.sides[1], x, b, range(span - 1, -1, -1))
        logits = f @ model.out[0]
        logits += b @ model.out[1]
        logits += model.bias
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        logits *= (np.arange(span)[:, None] < valid[i : i + BLOCK])[..., None]
        sums = logits.sum(0, dtype=np.float64)
        for k in range(sums.shape[1]):
            total[:, k] += np.bincount(doc[i : i + BLOCK], sums[:, k], len(texts))
    return total / np.maximum(size, 1)[:, None]


def learnable():
    """Rows to learn from: a language is given, and crc32 of the id leaves a remainder other than 0 by 5."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS) -> list[tuple[str, str]]:
    """At most ``per_language`` documents a language, chosen by a hash of the id, ``windows`` pieces of each."""
    known = docs.where(learnable()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    if not counts:
        return []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * per_language / n))).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / float(1 << 53)
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    piece = lambda i: F.substring("text", F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(i)), room).cast("int"), F.lit(WINDOW))
    got = known.select("doc_id", "lang", draw.alias("u"), F.array(*[piece(i) for i in range(windows)]).alias("pieces"), share.alias("share")).where("u < share")
    by: dict[str, list] = {}
    for r in sorted(got.drop("share").collect(), key=lambda r: (r.lang, r.u, r.doc_id, r.pieces)):
        by.setdefault(r.lang, []).append(r.pieces)
    return [(p, lang) for lang, rows in by.items() for pieces in rows[:per_language] for p in pieces if LETTER.search(p)]


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred and score added; both read only ``text``.

    A text that is null or has no letter is ``und`` with score 0, as is every text
    where nothing could be learned. Columns of these names are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    names = [*kept.columns, "lang_pred", "score"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                texts = batch.column(at).to_pylist()
                lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                rows = [k for k, t in enumerate(texts) if model and t and LETTER.search(t)]
                part, chars = [], 0
                for j, k in enumerate(rows):
                    part.append(k)
                    chars += len(texts[k])
                    if j + 1 == len(rows) or chars > 1 << 22:
                        p = probabilities(model, [texts[q].encode("utf-8", "replace") for q in part])
                        best = p.argmax(1)
                        for q, c, row in zip(part, best.tolist(), p):
                            lang[q], score[q] = model.langs[c], float(min(1.0, row[c]))
                        part, chars = [], 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs(doc_id, text, lang, ...)``.

    held_out says that crc32 of the id is a multiple of 5 (false for a null id);
    those rows, rows without a language and null texts are not learned from.
    """
    model = train(training_sample(docs), steps=steps)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "text")
    return label(rows, model).drop("text")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
