"""Training-order materialisation: token sequences in a keyed, global, repeatable order.

Texts become token ids, cut into sequences of ``length`` ids (the last ends with EOS and is padded). Sequences
are numbered 0..N-1 by key, text hash and part; a Feistel network keyed by ``seed``, with
cycle-walking (apply again until the value is below N), maps each number to its global slot, a bijection.
Slots are cut into ranges of ``rows`` sequences; a shard is one range and one uncompressed file, its sequences of
equal stride laid one after another, so slot s stands in the file of shard s // rows at byte (s % rows) * stride, and
a reader resumes at any slot. A narrow Parquet index beside the files, a range of shards to each of its parts, has
the keys. Files are written by the tasks under a name of their own and renamed when whole, in any store that
``pyarrow.fs`` reaches by the path's URI (file, hdfs, s3, gs).

Without a tokenizer file, ids are the UTF-8 bytes; 0xFE and 0xFF never stand in UTF-8 and are EOS and PAD. With the path
of a ``tokenizers`` JSON file, its ids are used, its size and one above are EOS and PAD.
Ids are written in the smallest unsigned type that holds them.

Defined results: a null or empty text is one sequence, EOS alone; rows equal in key and text get slots of
their own; an empty table gives no shards; null keys come first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.llm.kit import BATCH_ROWS, as_bytes, discard, free, packed, prepare, scan, stage, table, unpacked

LENGTH = 2048
#: Sequences of a shard: files of 64 MiB, so that 100 TB are some millions of files, each the work of one short task.
ROWS = 32 * 1024
#: Copies of one row that go to one task; further ones are dealt over other tasks.
COPIES = 256
ROUNDS = 6
SEED = "order-1"


def round_keys(seed: str) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "big") % (1 << 31) for i in range(ROUNDS)]


def slots(number: np.ndarray, n: int, seed: str = SEED) -> np.ndarray:
    """The slots of sequence numbers; a permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    if half > 28:
        raise ValueError("more than 2**56 sequences")
    keys, mask, m31 = round_keys(seed), (1 << half) - 1, (1 << 31) - 1
    out = number.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            y = (((right + k) & m31) * 1103515245 + 12345) & m31
            y = ((y ^ (y >> 15)) * 1664525 + 1013904223) & m31
            left, right = right, left ^ ((y >> 3) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out


class Encoder:
    """Token ids of texts; made on the executors from what the driver read."""

    def __init__(self, model: str | None):
        self.tokenizer = None
        self.size = 254
        if model:
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_str(model)
            self.tokenizer.encode_special_tokens = True
            self.size = self.tokenizer.get_vocab_size()
        self.eos, self.pad = self.size, self.size + 1
        self.kind = np.dtype("<u1" if self.pad < 1 << 8 else "<u2" if self.pad < 1 << 16 else "<u4")

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.tokenizer is None:
            return [np.frombuffer(t, np.uint8) for t in texts]
        made = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.asarray(e.ids, self.kind) for e in made]


def _packed_sequences(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: str = SEED, length: int = LENGTH, rows: int = ROWS,
                      tokenizer: str | None = None) -> DataFrame:
    """slot, shard, offset, key, part, n_tokens, and compressed tokens; a range of shards to each partition, sorted by slot."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.read.text(tokenizer, wholetext=True).first()[0] if tokenizer else None
    shared = spark.sparkContext.broadcast(model)
    both = [F.col(key), F.coalesce(F.col(text), F.lit(""))]
    df = docs.select(F.col(key).alias("_key"), both[1].alias("_text"), F.xxhash64(*both).alias("k0"), F.xxhash64(F.lit(7), *both).alias("k1"))

    def count(batch: pa.RecordBatch) -> dict:
        size = np.fromiter(map(len, Encoder(shared.value).ids(as_bytes(batch.column(batch.schema.get_field_index("_text"))))), np.int64, batch.num_rows)
        return {"_n": size // length + 1}

    if tokenizer:
        counted = scan(df, count, [("_n", T.LongType())], ["_key", "k0", "k1"])
    else:
        counted = df.select("_key", "k0", "k1", (F.floor(F.octet_length("_text") / length) + 1).alias("_n"))
    keys = counted.groupBy("_key", "k0", "k1").agg(F.first("_n").alias("_n"), F.count("*").alias("_m"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = stage(keys.repartitionByRange(parts, "_key", "k0", "k1").withColumn("_p", F.spark_partition_id()), "order-keys")
    within = W.partitionBy("_p").orderBy("_key", "k0", "k1")
    sums = keys.groupBy("_p").agg(F.sum(F.col("_n") * F.col("_m")).alias("_s"))  # one row per partition
    before = sums.withColumn("_before", F.sum("_s").over(W.orderBy("_p")) - F.col("_s"))
    total = sums.agg(F.sum("_s")).first()[0] or 0
    first = F.sum(F.col("_n") * F.col("_m")).over(within) - F.col("_n") * F.col("_m")
    first = keys.withColumn("_in", first).join(F.broadcast(before), "_p").select("k0", "k1", "_m", (F.col("_in") + F.col("_before")).alias("_first"))
    texts = packed(df, ["_key", "k0", "k1"])
    most = keys.agg(F.max("_m")).first()[0] or 1
    if most == 1:
        df = texts.join(first, ["k0", "k1"]).withColumn("_copy", F.lit(0).cast("long"))
    else:
        df = _copies(texts, first, most)

    def emit(batch: pa.RecordBatch) -> dict:
        e, codec = Encoder(shared.value), pa.Codec("zstd")
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        made = e.ids(unpacked(batch))
        n = np.fromiter(map(len, made), np.int64, len(made)) // length + 1
        begin = np.repeat(get("_first") + get("_copy") * n, n)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = slots(begin + part, total, seed).tolist()
        out, i = [], 0
        for ids, k in zip(made, n.tolist(), strict=True):
            flat = np.full(k * length, e.pad, e.kind)
            flat[: len(ids)] = ids
            flat[len(ids)] = e.eos
            out.append([{"slot": at[i + j], "part": j, "n_tokens": min(length, len(ids) + 1 - j * length), "_packed": codec.compress(flat[j * length : (j + 1) * length].tobytes(), asbytes=True)} for j in range(k)])
            i += k
        return {"_made": out}

    made = T.ArrayType(T.StructType([T.StructField("slot", T.LongType()), T.StructField("part", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("_packed", T.BinaryType())]))
    out = scan(df, emit, [("_made", made)], ["_key"]).select("_key", F.explode("_made").alias("s")).select("_key", "s.*")
    stride = length * Encoder(model).kind.itemsize
    out = out.withColumn("shard", F.floor(F.col("slot") / rows)).withColumn("offset", (F.col("slot") % rows) * stride).withColumn("_size", F.lit(stride).cast("long"))
    shards = max(1, -(-total // rows))
    parts = min(parts, shards)
    out = out.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("slot")
    out = out.select("slot", "shard", "offset", F.col("_key").alias(key), "part", "n_tokens", "_packed", "_size")
    out.stored_keys = keys
    return out


def _copies(texts: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """A row with its own ``_copy`` for each of the ``_m`` copies; equal rows are one before the shuffle, and many copies are made in many tasks."""
    others = ["_key", "_packed", "_size"]
    texts = texts.groupBy("k0", "k1").agg(*(F.first(c).alias(c) for c in others))
    begin = F.sequence(F.lit(0).cast("long"), F.col("_m") - 1, F.lit(COPIES).cast("long"))
    parts = texts.join(first, ["k0", "k1"]).withColumn("_from", F.explode(begin))
    if most > COPIES:  # one more shuffle, of compressed texts, a row for each range of copies
        parts = parts.repartition("k0", "k1", "_from")
    last = F.least(F.col("_from") + COPIES, F.col("_m")) - 1
    return parts.withColumn("_copy", F.explode(F.sequence("_from", last))).drop("_from")


def sequences(docs: DataFrame, **options) -> DataFrame:
    """slot, shard, offset, key, part, n_tokens (with EOS), tokens (``length`` ids as bytes), partitioned by ranges of shards and sorted by slot."""
    df = _packed_sequences(docs, **options)
    out = scan(df, lambda batch: {"tokens": unpacked(batch)}, [("tokens", T.BinaryType())], df.columns[:-2])
    out.stored_keys = df.stored_keys
    return out


def shard_file(path: str, shard: int) -> str:
    return f"{path}/shards/{shard:09d}.bin"


def _store(uri: str) -> tuple:
    """The file system of a qualified path, and the path in it."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri[5:].lstrip("/"))
    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hpath).toUri().toString()


class _Shard:
    """One file, under a name of its own until it is whole; a task that runs again writes the same bytes."""

    def __init__(self, uri: str, shard: int):
        self.fs, root = _store(uri)
        self.shard, self.size, self.name = shard, 0, shard_file(root, shard)
        self.fs.create_dir(f"{root}/shards", recursive=True)
        self.own = f"{root}/shards/.{shard:09d}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own, buffer_size=1 << 20)

    def add(self, offset: int, tokens: bytes) -> None:
        if offset != self.size:
            raise ValueError(f"shard {self.shard}: byte {self.size} written, {offset} expected")
        self.out.write(tokens)
        self.size += len(tokens)

    def close(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.own, self.name)
        except OSError:  # a store that doesn't rename over the file of an earlier attempt
            if self.fs.get_file_info(self.name).size != self.size:
                raise
            self.fs.delete_file(self.own)

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.own)


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write a file of fixed stride for each shard, then the index, under ``path``; the written table, read by offset.

    The sorted sequences are stored in between, so that what was shuffled is freed before the files take their space.
    """
    spark = docs.sparkSession
    uri = _qualified(spark, path)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    if hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        raise FileExistsError(uri)
    made = sequences(docs, **options)
    sorted_ = stage(made.withColumn("_size", F.octet_length("tokens").cast("long")), "order-sorted", compression="zstd")
    discard(made.stored_keys)
    files = sorted_.inputFiles()  # one of each partition: whole shards, in order of slots
    held = sorted_.agg(F.sum("_size")).first()[0] or 0
    free(spark)  # again, now that listeners have let go of the finished query

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet
        for i in (i for batch in batches for i in batch.column(0).to_pylist()):
            fs, name = _store(files[i])
            now, done = None, []
            try:
                with fs.open_input_file(name) as source:
                    for batch in parquet.ParquetFile(source).iter_batches(BATCH_ROWS, columns=["shard", "offset", "tokens"]):
                        for shard, offset, tokens in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "tokens")), strict=True):
                            if now is None or now.shard != shard:
                                if now is not None:
                                    now.close()
                                now = _Shard(uri, shard)
                                done.append(now)
                            now.add(offset, tokens)
                if now is not None:
                    now.close()
            except BaseException:
                if now is not None and not now.out.closed:
                    now.drop()
                raise
            yield pa.RecordBatch.from_pydict({"size": pa.array([x.size for x in done], pa.int64())})

    sizes = spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(write, "size long")
    written = sizes.agg(F.sum("size")).first()[0] or 0
    if written != held:
        raise RuntimeError(f"{written} bytes of {held} written to {uri}")
    index = sorted_.drop("tokens").repartitionByRange(max(1, len(files)), "shard").sortWithinPartitions("slot")
    index.write.mode("errorifexists").parquet(f"{path}/index")
    discard(sorted_)
    return read_shards(spark, path)


def _with_tokens(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Rows of the index and their tokens, each read at its offset in the file of its shard."""
    uri = _qualified(spark, path)

    def seek(batch: pa.RecordBatch) -> dict:
        fs, root = _store(uri)
        out, now, file = [], None, None
        for shard, offset, size in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "_size")), strict=True):
            if shard != now:
                if file is not None:
                    file.close()
                now, file = shard, fs.open_input_file(shard_file(root, shard))
            out.append(file.read_at(size, offset))
            if len(out[-1]) != size:
                raise ValueError(f"shard {shard} ends before byte {offset + size}")
        if file is not None:
            file.close()
        return {"tokens": out}

    return scan(index, seek, [("tokens", T.BinaryType())], [c for c in index.columns if c != "_size"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The written table, as ``sequences`` gives it."""
    return _with_tokens(spark, path, spark.read.parquet(f"{path}/index"))


def read_from(spark: SparkSession, path: str, slot: int = 0) -> DataFrame:
    """Sequences from a slot on, in order of slots; only the index is filtered and sorted, and no file of an earlier shard is opened."""
    return _with_tokens(spark, path, spark.read.parquet(f"{path}/index").filter(F.col("slot") >= slot).orderBy("slot"))


def digests(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a written table of byte sequences holds: one row per sequence."""
    body = F.expr("substring(tokens, 1, cast(n_tokens - IF(last, 1, 0) AS int))")
    ends = F.expr("substring(tokens, cast(n_tokens AS int), 1) = X'FE'")
    return shards.withColumn("last", ends).select(key, "part", "slot", "shard", "offset", "n_tokens", F.sha2(body, 256).alias("text_sha256"))


def op9_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all sequences of ``documents``, read back from the written shards."""
    from sigmaflow.session import scratch_path
    prepare(spark)
    return digests(write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "order-shards")))


OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), p AS (
  SELECT doc_id, b, unnest(range(0, octet_length(b) // {length} + 1)) AS part FROM d
), q AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, part) - 1 AS i, count(*) OVER () AS n FROM p
), h AS (
  SELECT *, greatest(1, (CAST(ceil(log2(greatest(n, 2))) AS BIGINT) + 1) // 2) AS half FROM q
), f AS (
  SELECT doc_id, part, i, i AS x, n, half, false AS moved FROM h
  UNION ALL
  SELECT doc_id, part, i, list_reduce([{keys}], lambda a, k:
      (a % (1::BIGINT << half)) * (1::BIGINT << half) + xor(a // (1::BIGINT << half),
        (((xor(((((a % (1::BIGINT << half)) + k) % 2147483648) * 1103515245 + 12345) % 2147483648,
               (((((a % (1::BIGINT << half)) + k) % 2147483648) * 1103515245 + 12345) % 2147483648) // 32768) * 1664525 + 1013904223) % 2147483648) // 8) % (1::BIGINT << half)),
      x), n, half, true
  FROM f WHERE NOT moved OR x >= n
)
SELECT f.doc_id, f.part, f.x AS slot, f.x // {rows} AS shard, (f.x % {rows}) * {length} AS "offset",
       CAST(least({length}, octet_length(h.b) + 1 - f.part * {length}) AS BIGINT) AS n_tokens,
       sha256(h.b[f.part * {length} + 1 : (f.part + 1) * {length}]) AS text_sha256
FROM f JOIN h USING (i) WHERE f.moved AND f.x < f.n
""".format(length=LENGTH, rows=ROWS, keys=", ".join(f"{k}::BIGINT" for k in round_keys(SEED)))
