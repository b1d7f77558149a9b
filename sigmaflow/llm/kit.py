"""Helpers shared by the operators: word codes over whole texts, Arrow scans, staged tables."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Rows of one Arrow batch; a batch of average documents is a few MB.
BATCH_ROWS = 1000
#: Bytes of the labelled texts that a model learns from.
SAMPLE_BYTES = 64 << 20
#: Bytes hashed at once.
SLICE = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> None:
    """Shared folder, package on the executors, Arrow batches of bounded size."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner delete finished shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a step to the shared folder and read it back; free what the step shuffled. The options are the Parquet writer's."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").options(**options).parquet(path)
    free(spark)
    out = spark.read.parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete stored steps that only finished, stored steps were made from."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_table() -> bytes:
    """Byte map: A-Z to a-z, ASCII digits, letters and bytes of other characters kept, the rest a space."""
    t = bytearray(b" " * 256)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        t[b] = b
    for b in range(0x41, 0x5B):
        t[b] = b + 32
    return bytes(t)


WORDS = word_table()
LETTER = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_power: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power
    if len(_power[0]) < n:
        size = max(n, SLICE + 1)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        _power = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_MULT, inverse))
    return _power


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit codes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slices(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):  # cut at a separator, so that no word is split
            cut = data.rfind(b" ", at, end)
            end = cut if cut > at else (data.find(b" ", end) if data.find(b" ", end) > 0 else len(data))
        yield data[at:end]
        at = end


def word_codes(texts: list[bytes], byte_map: bytes = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all words of all texts in order, and the words of each text.

    A word is a maximal run of bytes that ``byte_map`` doesn't turn into a space.
    """
    return word_spans(texts, byte_map)[:2]


def word_spans(texts: list[bytes], byte_map: bytes = WORDS, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """As ``word_codes``, with where each word begins in the texts joined by one byte, and where each text does.

    With ``prefixes``, the codes have a column for the whole word and one for its first bytes of each length.
    """
    data = b" ".join(texts).translate(byte_map)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths + 1) - lengths - 1
    codes, starts, at = [], [], 0
    for piece in _slices(data):
        raw = np.frombuffer(piece, np.uint8)
        inside = np.empty(len(raw) + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = raw != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edge[::2], edge[1::2]
        power, inverse = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(LETTER[raw] * power[: len(raw)], out=total[1:])
        made = [mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))]
        for k in prefixes:
            made.append(mix((total[np.minimum(last, first + k)] - total[first]) * inverse[first] - np.uint64(k)))
        codes.append(np.stack(made, axis=1) if prefixes else made[0])
        starts.append(first + at)
        at += len(raw)
    if not codes:
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), np.zeros(len(texts), np.int64), np.zeros(0, np.int64), begin
    where = np.concatenate(starts)
    return np.concatenate(codes), np.diff(np.searchsorted(where, np.append(begin, len(data)))), where, begin


def shingle_codes(codes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``width`` words; a text of fewer words, but not none, is one run."""
    n_shingles = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.cumsum(counts) - counts
    first = np.repeat(begin - (np.cumsum(n_shingles) - n_shingles), n_shingles) + np.arange(n_shingles.sum())
    left = np.repeat(begin + counts, n_shingles) - first
    out = np.zeros(len(first), np.uint64)
    padded = np.concatenate([codes, np.zeros(width, np.uint64)])
    for j in range(width):
        out = out * _MULT + np.where(left > j, padded[first + j], np.uint64(j + 1))
    return mix(out), n_shingles


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def bounded(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``most`` bytes, or of one row."""
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from bounded(batch.slice(0, half), most)
        yield from bounded(batch.slice(half), most)
    elif batch.num_rows:
        yield batch


def scan(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], fields: list[tuple[str, T.DataType]], keep: list[str]) -> DataFrame:
    """``mapInArrow`` that keeps columns and adds what ``fn`` makes of each batch."""
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in fields)])
    from pyspark.sql.pandas.types import to_arrow_schema
    new = to_arrow_schema(T.StructType([T.StructField(n, t) for n, t in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole):
                made = fn(batch)
                old = [batch.schema.get_field_index(c) for c in keep]
                cols = [batch.column(i) for i in old] + [made[f.name].cast(f.type) if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in new]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([*(batch.schema.field(i) for i in old), *new]))

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the columns ``by``."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in by:
            v = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if kept and kept[-1].column(kept[-1].schema.get_field_index(c))[-1].as_py() != v[0]:
                change[0] = True
        at = np.flatnonzero(change)
        if len(at):
            last = int(at[-1])
            done = [*kept, batch.slice(0, last)]
            if sum(b.num_rows for b in done):
                yield pa.Table.from_batches(done)
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def packed(df: DataFrame, keep: list[str], text: str = "_text") -> DataFrame:
    """The columns ``keep`` and the texts, compressed one by one, since they are about to be shuffled."""

    def run(batch: pa.RecordBatch) -> dict:
        texts, codec = as_bytes(batch.column(batch.schema.get_field_index(text))), pa.Codec("zstd")
        return {"_packed": [codec.compress(t, asbytes=True) for t in texts], "_size": list(map(len, texts))}

    return scan(df, run, [("_packed", T.BinaryType()), ("_size", T.LongType())], keep)


def unpacked(batch: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch of ``packed`` rows."""
    codec = pa.Codec("zstd")
    both = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_packed", "_size"))
    return [codec.decompress(t, decompressed_size=n, asbytes=True) for t, n in zip(*both, strict=True)]


def text_keys(text="text") -> list:
    """Two 64-bit columns that together stand for a whole text."""
    return [F.xxhash64(F.col(text)).alias("x0"), F.xxhash64(F.lit(7), F.col(text)).alias("x1")]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, rows: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, y) of labelled documents outside the held-out fold, those of the smallest hashes: at most ``rows`` rows and ``most_bytes`` bytes.

    docs: doc_id, text. The fold of a document is crc32 of its id as text, modulo ``fold``; ``held`` is held out.
    An id with several labels has the largest, one with several texts the one of least hash; texts of more than a
    sixteenth of ``most_bytes`` are not learnt from.
    """
    key = F.col("doc_id").cast("string")
    y = labels.groupBy(key.alias("k")).agg(F.max(label).alias("y")).filter("y IS NOT NULL AND k IS NOT NULL").filter(F.crc32("k") % fold != held)
    y = y.withColumn("h", F.xxhash64("k") / F.lit(float(1 << 63)))
    share = min(1.0, 1.2 * rows / max(1, y.count()))  # about the sample before the sort
    chosen = y.filter(F.col("h") <= 2 * share - 1).orderBy("h").limit(rows)
    texts = docs.select(key.alias("k"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes // 16)
    one = texts.join(chosen, "k").groupBy("k").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"), F.first("h").alias("h"))
    one = stage(one, "labelled")
    upto = F.sum(F.octet_length("text")).over(W.orderBy("h", "k"))  # at most ``rows`` rows
    within = one.select("k", upto.alias("upto")).filter(F.col("upto") <= most_bytes).select("k")
    return one.join(within, "k").orderBy("h", "k").select("text", F.col("y").cast("double"))
