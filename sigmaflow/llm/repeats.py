"""Removal of repeated byte strings with a run-length compressed suffix index.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere in the corpus goes.
Which texts must be compared is found by winnowing: a window of ``LENGTH`` bytes is
represented by the ``GRAM``-byte string of least hash inside it, its anchor, so equal windows
share the anchor's hash. An anchor stands for a stretch of consecutive windows; the bytes they span
are its context. Anchors whose hash occurs once are done with. Contexts that occur twice, by 128 bits of BLAKE2b over their bytes, are
repeated throughout. What is left are contexts that share an anchor but differ, mostly the edges of copied passages.

These are gathered by anchor into buckets of bounded size, one of each distinct context. A bucket's
contexts are joined into one string and its Burrows-Wheeler transform is kept as runs, with text
positions sampled at the run ends. The matching statistic of a position (the longest match that
starts there and elsewhere) can only exceed that of the position before, less one, at a run
end; so common prefixes are computed at run ends alone and the statistics stream from them in text
order. Windows whose statistic reaches ``LENGTH`` are marked. Pieces of one text that overlap are joined
first, so no place can match itself.

An anchor with more than ``GROUP`` distinct contexts (a very common line) would outgrow a bucket; there the
windows themselves are counted by 128-bit hash, which needs no gathering.

Defined results: null is the empty text; a text below ``LENGTH`` bytes loses nothing; rows equal in text lose
everything from ``LENGTH`` bytes on; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.llm.kit import LETTER, as_bytes, discard, mix, packed, powers, prepare, scan, stage, table, text_keys, unpacked, whole_groups

LENGTH = 400
GRAM = 128
GROUP = 2000
BUCKET_BYTES = 2 << 20
CHUNK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_SECOND = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _sums(raw: np.ndarray, letters: np.ndarray = LETTER) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any stretch follows, and the factors that take out its place."""
    power, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * power[: len(raw)], out=total[1:])
    return total, inverse


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from running minima inside blocks of w."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of texts (row, where in the text, size) laid together; long texts in overlapping stretches."""
    row, at, size, total = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - length + 1, 0), CHUNK):
            n = min(len(t) - a, CHUNK + length - 1)
            if total and total + n > 2 * CHUNK - 1:
                yield _joined(texts, row, at, size)
                row, at, size, total = [], [], [], 0
            row.append(i)
            at.append(a)
            size.append(n)
            total += n
    if total:
        yield _joined(texts, row, at, size)


def _joined(texts, row, at, size):
    raw = np.frombuffer(b"".join(texts[r][a : a + n] for r, a, n in zip(row, at, size, strict=True)), np.uint8)
    return raw, np.array(row), np.array(at), np.array(size)


def _digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each stretch, as two words: equal for equal bytes alone, also in texts made to collide."""
    view = memoryview(raw)
    found = b"".join(blake2b(view[s:e], digest_size=16).digest() for s, e in zip(begin.tolist(), end.tolist(), strict=True))
    return np.frombuffer(found, np.uint64).reshape(-1, 2)


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """row, h (anchor hash), c and d (context digest), a and b (first and last window start) of all anchors."""
    out: dict[str, list] = {"row": [], "h": [], "c": [], "d": [], "a": [], "b": []}
    for raw, row, at, size in _chunks(texts, length):
        total, inverse = _sums(raw)
        n = len(raw)
        h = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
        least = _sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1)  # leftmost of equal hashes
        begin = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(size)), size)[: len(least)]
        place = np.arange(len(least))
        whole = place <= (begin + size - length)[piece]
        place, piece = place[whole], piece[whole]
        p = (least[whole] & _PLACE).astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        a, b, of = place[first], place[last], piece[first]
        out["row"].append(row[of])
        out["h"].append(h[p[first]])
        digest = _digests(raw, a, b + length)
        out["c"].append(digest[:, 0])
        out["d"].append(digest[:, 1])
        out["a"].append(a - begin[of] + at[of])
        out["b"].append(b - begin[of] + at[of])
    return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in "hcd" else np.int64) for k, v in out.items()}


def _lists(row: np.ndarray, rows: int, fields: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each row; row is sorted."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _anchor_lists(batch: pa.RecordBatch) -> dict:
    got = anchors(as_bytes(batch.column(batch.schema.get_field_index("_text"))))
    ints = {"h": got["h"].view(np.int64), "c": got["c"].copy().view(np.int64), "d": got["d"].copy().view(np.int64), "a": got["a"], "b": got["b"]}
    return {"anchors": _lists(got["row"], batch.num_rows, {k: pa.array(v, pa.int64()) for k, v in ints.items()})}


def _long(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in names]))


class RunIndex:
    """Run-length compressed BWT of joined pieces: run heads, and text positions sampled at both ends of each run."""

    def __init__(self, pieces: list[bytes]):
        self.text = np.frombuffer(b"\xff".join(pieces) + b"\xff" * 9, np.uint8)  # 0xFF never stands in UTF-8
        self.size = len(self.text) - 8
        self.ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        self.ranks = self._ranks(max(map(len, pieces)) + 1)
        order = np.argsort(self.ranks[-1][1], kind="stable")
        last = self.text[order - 1]  # the transform; the first position follows a separator
        self.boundary = np.flatnonzero((last[1:] != last[:-1]) | (last[1:] == 0xFF)) + 1
        self.heads = last[np.append(0, self.boundary)]
        self.run_last, self.run_first = order[self.boundary - 1], order[self.boundary]  # samples at run ends

    def _ranks(self, depth: int) -> list[tuple[int, np.ndarray]]:
        """(k, rank of each suffix by its first k bytes), k doubling."""
        key = np.zeros(self.size, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | self.text[j : j + self.size]
        rank, k = np.unique(key, return_inverse=True)[1].astype(np.int64), 8
        out = [(8, rank.astype(np.int32))]
        while k < depth and rank.max() < self.size - 1:
            after = np.full(self.size, -1, np.int64)
            after[:-k] = rank[k:]
            rank = np.unique(rank * (self.size + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
            k *= 2
            out.append((k, rank.astype(np.int32)))
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs, by the ranks of all depths."""
        out = np.zeros(len(i), np.int64)
        for k, rank in reversed(self.ranks):
            while True:
                a, b = i + out, j + out
                inside = np.maximum(a, b) < self.size
                same = np.zeros(len(i), bool)
                same[inside] = rank[a[inside]] == rank[b[inside]]
                # equal ranks at the last depth may only be trusted for k bytes
                out += k * same
                if not same.any() or k != self.ranks[-1][0]:
                    break
        for _ in range(7):
            a, b = i + out, j + out
            inside = np.maximum(a, b) < self.size
            out[inside] += self.text[a[inside]] == self.text[b[inside]]
        return out

    def statistics(self) -> np.ndarray:
        """Longest match of each position with any other position, within its piece."""
        best = np.zeros(self.size, np.int64)
        length = self.common(self.run_last, self.run_first)
        np.maximum.at(best, self.run_last, length)
        np.maximum.at(best, self.run_first, length)
        place = np.arange(self.size)
        stream = np.maximum.accumulate(best + place) - place
        return np.minimum(stream, self.ends[np.searchsorted(self.ends, place)] - place)


def _bucket_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64()) for n in ("x0", "x1", "a", "e")])
    for t in whole_groups(batches, ["bucket"]):
        number = t["bucket"].to_numpy()
        start = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number))
        for lo, hi in zip(start[:-1], start[1:], strict=True):
            marks = repeated_windows(t.slice(lo, hi - lo).select(["x0", "x1", "a", "b", "asked", "bytes"]).to_pylist())
            if marks:
                yield pa.RecordBatch.from_pylist(marks, schema=schema)


def repeated_windows(rows: list[dict], length: int = LENGTH) -> list[dict]:
    """Covered stretches [a, e) of the asked contexts of a bucket."""
    rows.sort(key=lambda r: (r["x0"], r["x1"], r["a"], r["b"]))
    pieces: list[bytearray] = []
    where: list[tuple] = []  # text, place in the text
    owner: list[int] = []
    for r in rows:  # overlapping contexts of one text become one piece
        text = (r["x0"], r["x1"])
        if where and where[-1][0] == text and r["a"] <= where[-1][1] + len(pieces[-1]):
            pieces[-1] += r["bytes"][where[-1][1] + len(pieces[-1]) - r["a"] :]
        else:
            pieces.append(bytearray(r["bytes"]))
            where.append((text, r["a"]))
        owner.append(len(pieces) - 1)
    index = RunIndex([bytes(p) for p in pieces])
    found = index.statistics() >= length
    begin = np.concatenate([[0], index.ends[:-1] + 1])
    out = []
    for r, o in zip(rows, owner, strict=True):
        if r["asked"]:
            at = begin[o] + r["a"] - where[o][1]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], found[at : at + r["b"] - r["a"] + 1].view(np.int8), [0]])))
            out += [{"x0": r["x0"], "x1": r["x1"], "a": r["a"] + int(s), "e": r["a"] + int(e) - 1 + length} for s, e in zip(edge[::2], edge[1::2], strict=True)]
    return out


def _extract(batch: pa.RecordBatch) -> dict:
    """Bytes of the contexts that go to buckets, and hashes of all windows of the others."""
    texts = unpacked(batch)
    wanted = batch.column(batch.schema.get_field_index("wanted")).to_pylist()
    pieces, row, place, one, two = [], [], [], [], []
    for i, (t, ws) in enumerate(zip(texts, wanted, strict=True)):
        pieces.append([{**w, "bytes": t[w["a"] : w["b"] + LENGTH]} for w in ws if w["bucket"] is not None])
        for w in ws:
            if w["bucket"] is None:
                raw = np.frombuffer(t[w["a"] : w["b"] + LENGTH], np.uint8)
                n = len(raw) - LENGTH + 1
                for out, letters in ((one, LETTER), (two, _SECOND)):
                    total, inverse = _sums(raw, letters)
                    out.append(mix((total[LENGTH:] - total[:-LENGTH]) * inverse[:n]).view(np.int64))
                row.append(np.full(n, i))
                place.append(w["a"] + np.arange(n))
    none = [np.zeros(0, np.int64)]
    windows = _lists(np.concatenate(row or none), len(texts), {k: pa.array(np.concatenate(v or none), pa.int64()) for k, v in (("a", place), ("w0", one), ("w1", two))})
    return {"pieces": pieces, "windows": windows}


def _with_text(rows: DataFrame, docs: DataFrame, first: DataFrame) -> DataFrame:
    """rows (x0, x1, wanted) with the text, from one document of each text."""
    rows = rows.join(first, ["x0", "x1"]).withColumnsRenamed({"x0": "y0", "x1": "y1"})
    same = (F.col("x0") == F.col("y0")) & (F.col("x1") == F.col("y1")) & F.col("_key").eqNullSafe(F.col("first"))
    return docs.join(rows, same).select("x0", "x1", "wanted", "_packed", "_size")


def repeats(docs: DataFrame) -> DataFrame:
    """(x0, x1, marks): stretches [a, e) of whole windows that occur elsewhere, stored; docs: _key, _text, x0, x1."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = scan(docs.filter(F.octet_length("_text") >= LENGTH), _anchor_lists, [("anchors", _long("h", "c", "d", "a", "b"))], ["x0", "x1"])
    every = stage(every.select("x0", "x1", F.explode("anchors").alias("r")).select("x0", "x1", "r.*"), "repeat-anchors")
    shared = every.groupBy("h").agg(F.count("*").alias("n"), *(f(x).alias(f"{x}_{f.__name__}") for x in "cd" for f in (F.min, F.max)))
    shared = shared.filter("n > 1").select("h", ((F.col("c_min") != F.col("c_max")) | (F.col("d_min") != F.col("d_max"))).alias("mixed"))
    # both sides are stored, so that Spark can split an anchor that many rows share
    hashes = stage(shared, "repeat-hashes")
    rows = stage(every.join(hashes, "h"), "repeat-shared")
    discard(every, hashes)
    alike = rows.filter("NOT mixed").select("x0", "x1", "a", (F.col("b") + LENGTH).alias("e"))

    mixed = rows.filter("mixed")
    contexts = stage(mixed.groupBy("h", "c", "d").agg(F.count("*").alias("n"), F.min(F.struct("x0", "x1", "a", "b")).alias("r")).select("h", "c", "d", "n", "r.*"), "repeat-contexts")
    twins = mixed.join(contexts.filter("n > 1").select("h", "c", "d"), ["h", "c", "d"]).select("x0", "x1", "a", (F.col("b") + LENGTH).alias("e"))
    groups = contexts.groupBy("h").agg(F.count("*").alias("k"), F.max((F.col("n") == 1).cast("int")).alias("open")).filter("open = 1").select("h", "k")
    left = stage(contexts.join(groups, "h").withColumn("asked", F.col("n") == 1), "repeat-open")
    first = docs.groupBy("x0", "x1").agg(F.min("_key").alias("first"))
    texts = packed(docs, ["_key", "x0", "x1"])

    small = F.col("k") <= GROUP
    size = left.filter(small).agg(F.sum(F.col("b") - F.col("a") + LENGTH)).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    bucket = F.when(small, F.pmod(F.xxhash64("h"), F.lit(buckets)))
    wanted = left.groupBy("x0", "x1").agg(F.collect_list(F.struct(bucket.alias("bucket"), "a", "b", "asked")).alias("wanted"))
    piece = T.ArrayType(T.StructType([T.StructField("bucket", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("asked", T.BooleanType()), T.StructField("bytes", T.BinaryType())]))
    cut = stage(scan(_with_text(wanted, texts, first), _extract, [("pieces", piece), ("windows", _long("a", "w0", "w1"))], ["x0", "x1"]), "repeat-pieces")
    pieces = cut.select("x0", "x1", F.explode("pieces").alias("p")).select("x0", "x1", "p.*")
    indexed = pieces.repartition(max(1, min(parts, buckets)), "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_marks, "x0 long, x1 long, a long, e long")
    windows = cut.select("x0", "x1", F.explode("windows").alias("w")).select("x0", "x1", "w.*").distinct()
    twice = windows.groupBy("w0", "w1").count().filter("count > 1").select("w0", "w1")
    counted = windows.join(twice, ["w0", "w1"]).select("x0", "x1", "a", (F.col("a") + LENGTH).alias("e"))
    stored = [rows, contexts, left, cut, stage(indexed, "repeat-indexed"), stage(counted, "repeat-counted")]
    out = alike.unionByName(twins).unionByName(stored[-2]).unionByName(stored[-1])

    marks = stage(out.groupBy("x0", "x1").agg(F.collect_set(F.struct("a", "e")).alias("marks")), "repeat-marks")
    discard(*stored)
    return marks


def _cut(batch: pa.RecordBatch) -> dict:
    texts = unpacked(batch)
    spans = batch.column(batch.schema.get_field_index("marks")).to_pylist()
    out: dict[str, list] = {"spans": [], "kept": []}
    for t, marks in zip(texts, spans, strict=True):
        merged: list[list[int]] = []
        for m in sorted((m["a"], m["e"]) for m in marks or ()):
            if merged and m[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], m[1])
            else:
                merged.append([m[0], m[1]])
        cuts = [0, *(x for m in merged for x in m), len(t)]
        out["spans"].append([{"start": s, "end": e} for s, e in merged])
        out["kept"].append(b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
    return out


def cut_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, removed (byte spans, ends exclusive) and kept (bytes) of every document."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    docs = docs.select("_key", "_text", *text_keys("_text"))
    fields = [("spans", _long("start", "end")), ("kept", T.BinaryType())]
    texts = packed(docs, ["_key", "x0", "x1"]).withColumn("n_bytes", F.col("_size"))
    out = scan(texts.join(repeats(docs), ["x0", "x1"], "left"), _cut, fields, ["_key", "n_bytes"])
    return out.select(F.col("_key").alias(key), "n_bytes", F.col("spans").alias("removed"), "kept")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated strings of 400 bytes."""
    out = cut_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT rid, s, md5(b[s + 1 : s + 400]) AS m FROM (SELECT rid, b, unnest(range(0, octet_length(b) - 399)) AS s FROM d WHERE octet_length(b) >= 400)
), dup AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1
), runs AS (
  SELECT rid, s, CASE WHEN s - lag(s) OVER (PARTITION BY rid ORDER BY s) <= 400 THEN 0 ELSE 1 END AS new FROM dup
), spans AS (
  SELECT rid, min(s) AS a, max(s) + 400 AS e FROM (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS g FROM runs) GROUP BY rid, g
), gaps AS (
  SELECT d.rid, coalesce(lag(e) OVER w, 0) AS lo, a AS hi FROM spans JOIN d USING (rid) WINDOW w AS (PARTITION BY d.rid ORDER BY a)
  UNION ALL SELECT d.rid, coalesce(max(e), 0), octet_length(any_value(d.b)) FROM d LEFT JOIN spans USING (rid) GROUP BY d.rid
), kept AS (
  SELECT rid, unhex(string_agg(hex(b[lo + 1 : hi]), '' ORDER BY lo)) AS k FROM gaps JOIN d USING (rid) GROUP BY rid
), n AS (SELECT rid, count(*) AS spans, sum(e - a) AS removed FROM spans GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(k) AS kept_sha256
FROM d JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""
