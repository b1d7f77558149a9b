"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence s has logit z_s = b + sum of the weights of its hashed words and of their
first 4 to 7 bytes (so that inflected and compound forms share what their stem teaches); it is toxic with
probability sigmoid(z_s), and a document is toxic if any sentence is (noisy-or):
P = 1 - prod(1 - p_s) = 1 - exp(-sum softplus(z_s)). Weights are fitted by
gradient descent on the log-likelihood of document labels alone, over at most
``FIT_ROWS`` labelled documents outside the held-out fold, one text an id, in bounded bytes. Scoring is one pass over whole texts and
also locates the sentences that make a document toxic.

Defined results: a text without words has score 0; repeated rows get equal scores; without
any labelled row all scores are below 1e-9; rows of null id are scored, never learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.llm.kit import as_bytes, labelled_sample, prepare, scan, table, word_spans

FIT_ROWS = 6000
FIT_BATCH = 256
BITS = 20
STEPS = 300
RATE = 0.05
PREFIXES = (4, 5, 6, 7)
LEAST_DOCS = 2
CUT = 0.3
FOLDS, HELD = 4, 2
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True  # line feed ! . ?


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and prefixes; where each sentence's words begin; its text's number; where its first and last words begin in the text."""
    codes, counts, at, begin = word_spans(texts, prefixes=PREFIXES)
    if not len(codes):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), none, none, none, none
    ends = np.flatnonzero(_ENDS[np.frombuffer(b" ".join(texts), np.uint8)])
    row = np.repeat(np.arange(len(texts)), counts)
    number = np.searchsorted(ends, at)
    new = np.ones(len(codes), bool)
    new[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(codes)) - 1
    return (codes >> np.uint64(64 - BITS)).astype(np.int64), first, row[first], at[first] - begin[row[first]], at[last] - begin[row[first]]


def _telling(texts: list[bytes], y: np.ndarray, size: int) -> np.ndarray:
    """Buckets that stand in clearly more toxic documents than chance puts them in."""
    counts = np.full((2, size), 0.5)
    for i in range(0, len(texts), FIT_BATCH):
        word, first, row, _, _ = sentences(texts[i : i + FIT_BATCH])
        at = np.repeat(row, np.diff(np.append(first, len(word))))
        seen = np.unique(word.ravel() * FIT_BATCH + np.repeat(at, word.shape[1]))
        for toxic in (0, 1):
            counts[toxic] += np.bincount(seen[(y[i + seen % FIT_BATCH] > 0.5) == toxic] // FIT_BATCH, minlength=size)
    b, a = counts
    n1, n0 = (y > 0.5).sum() + 1, (y <= 0.5).sum() + 1
    z = (np.log(a / (n1 - a)) - np.log(b / (n0 - b))) / np.sqrt(1 / a + 1 / b)
    return np.flatnonzero((z > np.sqrt(np.log(len(y) + 1))) & (a >= LEAST_DOCS))  # the gain exceeds the BIC price of a weight


def fit(texts: list[bytes], y: np.ndarray, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights of the buckets, the bias last; full-batch Adam on the noisy-or likelihood with a Gaussian prior."""
    size = 1 << BITS
    w = np.zeros(size + 1)
    w[-1] = -50.0
    used = _telling(texts, y, size) if len(texts) else np.zeros(0, np.int64)
    if not len(used):
        return w
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    found, sentence, row, n_sentences = [], [], [], 0
    for i in range(0, len(texts), FIT_BATCH):  # only telling buckets are kept
        word, first, of, _, _ = sentences(texts[i : i + FIT_BATCH])
        at = place[word]
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
        sentence.append(np.broadcast_to(number[:, None], at.shape)[at >= 0] + n_sentences)
        found.append(at[at >= 0])
        row.append(of + i)
        n_sentences += len(first)
    at, sentence, row, n = np.concatenate(found), np.concatenate(sentence), np.concatenate(row), len(y)
    alive, sentence = np.unique(sentence, return_inverse=True)  # sentences with a telling bucket
    plain = np.bincount(row, minlength=n) - np.bincount(row[alive], minlength=n)
    row = row[alive]
    v, bias = np.zeros(len(used)), np.log(0.5 * max(y.mean(), 1e-3) / max(1.0, n_sentences / n))
    m, s, mb, sb = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(sentence, v[at], len(alive)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.bincount(row, np.logaddexp(0, z), n) + plain * np.logaddexp(0, bias)
        slope = np.where(y > 0.5, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / n
        dz = slope[row] * p
        g = np.bincount(at, dz[sentence], len(v)) + v / n
        gb = dz.sum() + (slope * plain).sum() / (1 + np.exp(-bias))
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-8)
    w[used], w[-1] = v, bias
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> np.ndarray:
    """Fit on a bounded sample; docs: doc_id, text; labels: doc_id, toxic."""
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD, rows).collect()
    return fit([r.text.encode() for r in sample], np.array([r.y for r in sample])).astype(np.float32)


def _scorer(shared, text: str):
    def run(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        w = shared.value
        word, first, row, start, end = sentences(texts)
        z = np.add.reduceat(w[word].sum(axis=1), first) + w[-1] if len(word) else np.zeros(0)
        total = np.bincount(row, np.logaddexp(0, z), len(texts))
        spans = [[] for _ in texts]
        for i in np.flatnonzero(z > 0):  # probability over a half
            t = texts[row[i]]
            stop = next((j for j in range(end[i], len(t)) if _ENDS[t[j]]), len(t))
            lo = len(t[: start[i]].decode("utf-8", "replace"))
            spans[row[i]].append({"start": lo, "end": lo + len(t[start[i] : stop].decode("utf-8", "replace")), "score": float(1 / (1 + np.exp(-z[i])))})
        return {"_score": -np.expm1(-total), "_found": spans}
    return run


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, weights: np.ndarray, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with toxicity (0 to 1) and toxic_sentences (code points, score)."""
    prepare(docs.sparkSession)
    docs = docs.drop(*({"toxicity", "toxic_sentences", "_score", "_found"} - {text}))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    out = scan(docs, _scorer(shared, text), [("_score", T.DoubleType()), ("_found", SPANS)], docs.columns)
    return out.withColumnsRenamed({"_score": "toxicity", "_found": "toxic_sentences"})


def drop_toxic(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` scored below ``cut``; same columns."""
    prepare(docs.sparkSession)
    weights = train(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    return score(packed, weights, text="_text").filter(F.col("toxicity") < cut).select("_row.*")


def held_out(folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(FOLDS, HELD).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= CUT).cast("int").alias("predicted"), F.size("toxic_sentences").cast("long").alias("n_toxic_sentences"))
