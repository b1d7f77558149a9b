"""Quality classifier: a factorisation machine over hashed words, structure statistics and size metadata.

    y(x) = w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

The bracket is the sum-of-squares identity for all pairwise interactions <v_i, v_j> x_i x_j, so a
document is scored in time linear in its features. Word features have the value one over the
root of the number of distinct words; statistics (shares of character classes, lengths, repeated words and
lines) are standardised on the fitting sample. Fitted by gradient descent on at most
``FIT_ROWS`` labelled documents outside the held-out fold; scored over whole texts.

Defined results: a text without words is scored by its statistics (an empty one has all at zero);
repeated rows get equal scores; without labelled rows all scores are 0.5; rows of null id are
scored, never learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.llm.kit import as_bytes, labelled_sample, prepare, scan, table, word_codes
from sigmaflow.llm.toxicity import held_out

FIT_ROWS = 5000
FIT_BATCH = 256
BITS = 18
FACTORS = 8
STEPS = 250
RATE = 0.03
LEAST_DOCS = 5
CUT = 0.3
FOLDS, HELD = 5, 0
STATS = ("lower", "upper", "digit", "space", "line_feed", "stop", "mark", "other_ascii", "bar", "non_ascii",
         "log_bytes", "log_words", "log_lines", "word_length", "line_words", "distinct_words", "common_word", "doubled_words", "distinct_lines", "upper_stop", "mark_words")
_CLASS = np.full(256, 7)
for _i, _set in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), (0x20,), (0x0A,), b".,", b"!?#$%&*+=<>@^_~\\/")):
    _CLASS[list(_set)] = _i
_CLASS[ord("|")] = 8
_CLASS[0x80:] = 9
_LINES = bytes(32 if b == 10 else 31 if b == 32 else b for b in range(256))


@dataclass
class Machine:
    bias: float
    w: np.ndarray  # word buckets, then statistics
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _distinct(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) pairs with their counts."""
    order = np.lexsort((codes, row))
    codes, row = codes[order], row[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], codes[at], np.diff(np.append(at, len(codes)))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each distinct word, and the statistics of each row."""
    n = len(texts)
    codes, counts = word_codes(texts)
    row = np.repeat(np.arange(n), counts)
    size = np.fromiter(map(len, texts), np.int64, n)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    cls = np.bincount(np.repeat(np.arange(n) * 10, size) + _CLASS[raw], minlength=10 * n).reshape(n, 10)
    u_row, u_code, u_count = _distinct(codes, row)
    line, lines = word_codes(texts, _LINES)
    l_row, _, _ = _distinct(line, np.repeat(np.arange(n), lines))
    most = np.zeros(n)
    np.maximum.at(most, u_row, u_count)
    double = np.bincount(row[1:][(codes[1:] == codes[:-1]) & (row[1:] == row[:-1])], minlength=n)
    words, some, rows = np.maximum(counts, 1), np.maximum(size, 1), np.maximum(lines, 1)
    letters = cls[:, 0] + cls[:, 1] + cls[:, 9]
    stats = np.column_stack([
        cls / some[:, None], np.log1p(size), np.log1p(counts), np.log1p(lines), np.log1p(letters / words), np.log1p(counts / rows),
        np.bincount(u_row, minlength=n) / words, most / words, double / words, np.bincount(l_row, minlength=n) / rows,
        cls[:, 1] / np.maximum(cls[:, 5], 1) / 50, np.minimum(cls[:, 6] / words, 4)])
    return u_row, (u_code >> np.uint64(64 - BITS)).astype(np.int64), stats


def _batches(texts: list[bytes]):
    for i in range(0, len(texts), FIT_BATCH):
        row, bucket, stats = features(texts[i : i + FIT_BATCH])
        yield (row + i).astype(np.int32), bucket.astype(np.int32), stats


def _standard(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((stats - mean) / scale, -4, 4)


def logits(m: Machine, texts: list[bytes]) -> np.ndarray:
    row, bucket, stats = features(texts)
    return m.bias + _pairs(row, bucket, _standard(stats, m.mean, m.scale), m.w, m.v)[0]


def _pairs(row, bucket, dense, w, v):
    """Linear term plus interactions, and the factor sums."""
    n, k = len(dense), dense.shape[1]
    x = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
    wd, vd = w[-k:], v[-k:]
    total, square, linear = dense @ vd, (dense**2) @ (vd**2), dense @ wd
    linear = linear + np.bincount(row, w[bucket] * x, n)
    for f in range(v.shape[1]):
        vx = v[bucket, f] * x
        total[:, f] += np.bincount(row, vx, n)
        square[:, f] += np.bincount(row, vx * vx, n)
    return linear + 0.5 * (total**2 - square).sum(axis=1), total, x


def fit(texts: list[bytes], y: np.ndarray, steps: int = STEPS, rate: float = RATE) -> Machine:
    size, k = 1 << BITS, len(STATS)
    machine = Machine(0.0, np.zeros(size + k), np.zeros((size + k, FACTORS)), np.zeros(k), np.ones(k))
    if not len(texts):
        return machine
    n = len(y)
    row, bucket, stats = (np.concatenate(x) for x in zip(*_batches(texts), strict=True))
    machine.mean, machine.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    dense = _standard(stats, machine.mean, machine.scale)
    good = np.bincount(bucket, y[row].astype(np.float32), size) + 0.5
    docs = np.bincount(bucket, minlength=size) + 1.0
    n1 = y.sum() + 1
    z = (np.log(good / (n1 - good + 0.5)) - np.log((docs - good) / (n + 2 - n1 - docs + good + 0.5))) / np.sqrt(1 / good + 1 / (docs - good))
    used = np.flatnonzero((docs >= LEAST_DOCS) & (np.abs(z) > np.sqrt(np.log(n + 1))))  # worth the BIC price; the others keep weight 0
    place = np.full(size, len(used))
    place[used] = np.arange(len(used))
    at = place.astype(np.int32)[bucket]
    rng = np.random.default_rng(7)
    w, v = np.zeros(len(used) + 1 + k), rng.normal(0, 0.02, (len(used) + 1 + k, FACTORS))
    v[len(used)] = 0
    bias, moments = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}

    def move(name, value, grad, t):
        m, s = moments.get(name, (0.0, 0.0))
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        moments[name] = (m, s)
        return value - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)

    live = at < len(used)
    r, b = row[live], at[live]
    x = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[r]
    del row, bucket, at, live
    for t in range(1, steps + 1):
        wb, vd = w[b], v[-k:]
        total, square = dense @ vd, (dense**2) @ (vd**2)
        linear = dense @ w[-k:] + np.bincount(r, wb * x, n)
        vx = v[b] * x[:, None]
        for f in range(FACTORS):
            total[:, f] += np.bincount(r, vx[:, f], n)
            square[:, f] += np.bincount(r, vx[:, f] ** 2, n)
        out = bias + linear + 0.5 * (total**2 - square).sum(axis=1)
        d = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y) / n
        gw, gv = np.zeros_like(w), np.zeros_like(v)
        gw[-k:] = dense.T @ d
        gv[-k:] = dense.T @ (d[:, None] * total) - vd * ((dense**2).T @ d)[:, None]
        dx = d[r] * x
        gw[: len(used)] = np.bincount(b, dx, len(used))[: len(used)]
        for f in range(FACTORS):
            gv[: len(used), f] = np.bincount(b, dx * (total[r, f] - vx[:, f]), len(used))[: len(used)]
        prior = 1 / n
        w, v, bias = move("w", w, gw + prior * w, t), move("v", v, gv + 5 * prior * v, t), move("b", bias, d.sum(), t)
    machine.bias = float(bias)
    machine.w[used], machine.v[used] = w[: len(used)], v[: len(used)]
    machine.w[-k:], machine.v[-k:] = w[-k:], v[-k:]
    return machine


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    """Fit on a bounded sample; docs: doc_id, text; labels: doc_id, quality."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD, rows).collect()
    return fit([r.text.encode() for r in sample], np.array([r.y for r in sample]))


def score(docs: DataFrame, machine: Machine, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with quality (0 to 1)."""
    prepare(docs.sparkSession)
    docs = docs.drop(*({"quality", "_score"} - {text}))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        return {"_score": 1 / (1 + np.exp(-np.clip(logits(shared.value, texts), -500, 500)))}

    return scan(docs, run, [("_score", T.DoubleType())], docs.columns).withColumnRenamed("_score", "quality")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= CUT).cast("int").alias("predicted"))
