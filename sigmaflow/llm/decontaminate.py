"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items.

Each item gives its windows of ``width`` consecutive words (one shorter window
for an item of fewer words). Symbols of the search are words, as 64-bit codes.
Windows of one length form a pattern set: the SHIFT table tells, for the block of
words that ends at a position, how far no window can end; a zero shift leads to
the bucket of windows with that suffix block, whose words are compared one by one.
All texts of a batch are searched at once, one lane for each stretch of 512 words.

Repeated items count once. The items are taken in blocks of bounded size. Is there more than one, the documents are
stored with a row number, each block is broadcast in a pass of its own that stores the hits by row number,
and is given up before the next one, so neither the driver nor a task holds a large benchmark whole.

Defined results: a null or empty text has no words and no hits; an item without
words has no window; an item with null id counts as the id ''; rows are scored one
by one, so repeated rows repeat; an empty benchmark hits nothing; input columns
that share a result's name are replaced.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.llm.kit import as_bytes, discard, prepare, scan, stage, table, word_codes

WIDTH = 10
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 16 << 20
LANE = 512
_SHIFT_BITS = 17
_TURN = np.uint64(0xD6E8FEB86659FD93)


class WindowSet:
    """SHIFT table and suffix buckets of all windows of one length."""

    def __init__(self, windows: np.ndarray, ids: np.ndarray):
        self.length = windows.shape[1]
        self.block = min(2, self.length)
        order = np.lexsort((ids, *windows.T))
        windows, ids = windows[order], ids[order]
        new = np.ones(len(windows), bool)
        new[1:] = (windows[1:] != windows[:-1]).any(axis=1)
        self.windows = windows[new]
        self.item_at = np.append(np.flatnonzero(new), len(ids))
        self.items = ids
        span = self.length - self.block
        self.shift = np.full(1 << _SHIFT_BITS, span + 1, np.int16)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self._slot(self.blocks(self.windows, end)), self.length - 1 - end)
        suffix = self.blocks(self.windows, self.length - 1)
        self.by_suffix = np.argsort(suffix, kind="stable")
        self.suffix, at = np.unique(suffix[self.by_suffix], return_index=True)
        self.bucket = np.append(at, len(suffix))

    def blocks(self, words: np.ndarray, end: int) -> np.ndarray:
        code = words[:, end].copy()
        if self.block == 2:
            code = code * _TURN + words[:, end - 1]
        return code

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return ((block * _TURN) >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)

    def search(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last positions and window numbers of all occurrences inside [begin, end) stretches."""
        block = codes.copy()
        if self.block == 2:
            block[1:] = codes[1:] * _TURN + codes[:-1]
        slot = self._slot(block)
        first, stop = begin + self.length - 1, end
        lanes = np.maximum(0, -(-(stop - first) // LANE))
        base = np.repeat(first - (np.cumsum(lanes) - lanes) * LANE, lanes) + np.arange(lanes.sum()) * LANE
        limit = np.minimum(base + LANE, np.repeat(stop, lanes))
        at, found_at, found = base, [], []
        while len(at):
            jump = self.shift[slot[at]].astype(np.int64)
            hit = at[jump == 0]
            if len(hit):
                where = np.searchsorted(self.suffix, block[hit])
                real = where < len(self.suffix)
                real[real] = self.suffix[where[real]] == block[hit[real]]
                hit, where = hit[real], where[real]
                many = self.bucket[where + 1] - self.bucket[where]
                pos = np.repeat(hit, many)
                window = self.by_suffix[np.repeat(self.bucket[where] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                for j in range(self.length):  # word by word from the front; few survive the first
                    same = codes[pos - self.length + 1 + j] == self.windows[window, j]
                    pos, window = pos[same], window[same]
                found_at.append(pos)
                found.append(window)
            at = at + np.maximum(jump, 1)
            more = at < limit
            at, limit = at[more], limit[more]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_at]), np.concatenate([none, *found])


def window_sets(texts: list[bytes], width: int) -> list[WindowSet]:
    codes, counts = word_codes(texts)
    begin = np.cumsum(counts) - counts
    by_length: dict[int, tuple[list, list]] = {}
    for i, (b, n) in enumerate(zip(begin, counts, strict=True)):
        if n:
            w = min(width, int(n))
            rows, ids = by_length.setdefault(w, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(codes[b : b + n], w))
            ids.append(np.full(n - w + 1, i))
    return [WindowSet(np.concatenate(r), np.concatenate(i)) for r, i in by_length.values()]


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for s, e in sorted(spans):
        if flat and s <= flat[-1]:
            flat[-1] = max(flat[-1], e)
        else:
            flat += [s, e]
    return flat


def _scanner(shared, ids: list[str], text: str):
    def run(batch: pa.RecordBatch) -> dict:
        codes, counts = word_codes(as_bytes(batch.column(batch.schema.get_field_index(text))))
        begin = np.cumsum(counts) - counts
        spans, items = [[] for _ in counts], [set() for _ in counts]
        for ws in shared.value:
            pos, window = ws.search(codes, begin, begin + counts)
            row = np.searchsorted(begin + counts, pos, side="right")
            start = pos - ws.length + 1 - begin[row]
            for r, s in zip(row.tolist(), start.tolist(), strict=True):
                spans[r].append((s, s + ws.length))
            for r, w in set(zip(row.tolist(), window.tolist(), strict=True)):
                items[r].update(ids[i] for i in ws.items[ws.item_at[w] : ws.item_at[w + 1]])
        return {"_n": counts, "_spans": [_merge(s) for s in spans], "_items": [sorted(x) for x in items]}
    return run


def _gathered(batch: pa.RecordBatch) -> dict:
    """Spans and items of all blocks as one."""
    get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
    spans = [_merge([p for s in parts for p in zip(s[::2], s[1::2], strict=True)]) for parts in get("_parts")]
    return {"_spans": spans, "_items": [sorted(set(chain(*parts))) for parts in get("_named")]}


_SPANS, _ITEMS = ("_spans", T.ArrayType(T.LongType())), ("_items", T.ArrayType(T.StringType()))


def _block_hits(docs: DataFrame, items: DataFrame, text: str, width: int, keep: list[str]):
    """docs with _n, _spans and _items of one block of items, and what was broadcast."""
    rows = items.collect()  # about block_bytes
    shared = docs.sparkSession.sparkContext.broadcast(window_sets([r.t.encode() for r in rows], width))
    return scan(docs, _scanner(shared, [r.id for r in rows], text), [("_n", T.LongType()), _SPANS, _ITEMS], keep), shared


def _in_passes(docs: DataFrame, items: DataFrame, blocks: int, text: str, width: int) -> DataFrame:
    """As ``_block_hits``, a pass over the stored documents for each block; a document's hits are put together by its row number."""
    keep = docs.columns
    docs = stage(docs.withColumn("_rid", F.monotonically_increasing_id()), "deco-docs")
    passes = []
    for b in range(blocks):
        found, shared = _block_hits(docs.select("_rid", text), items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b), text, width, ["_rid"])
        passes.append(stage(found.filter((F.size("_spans") > 0) | F.lit(b == 0)), "deco-pass"))  # the first pass has the counts of all
        shared.unpersist()
    counts = passes[0].select("_rid", "_n")
    hits = passes[0].filter(F.size("_spans") > 0)
    for more in passes[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("_rid").agg(F.collect_list("_spans").alias("_parts"), F.collect_list("_items").alias("_named"))
    hits = stage(counts.join(scan(hits, _gathered, [_SPANS, _ITEMS], ["_rid"]), "_rid", "left"), "deco-hits")
    discard(*passes)
    none = {c: F.coalesce(c, F.array().cast(f"array<{kind}>")) for c, kind in (("_spans", "bigint"), ("_items", "string"))}
    return docs.join(hits, "_rid").withColumns(none).select(*keep, "_n", "_spans", "_items")


def find_windows(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with n_words, n_hit, hit_spans (word ranges, flat), hit_items and contaminated."""
    prepare(docs.sparkSession)
    results = ["n_words", "n_hit", "hit_spans", "hit_items", "contaminated", "_n", "_spans", "_items", "_rid"]
    docs = docs.drop(*(c for c in results if c != text))
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    keep = docs.columns
    df = _block_hits(docs, items, text, width, keep)[0] if blocks == 1 else _in_passes(docs, items, blocks, text, width)
    hit = F.aggregate(F.sequence(F.lit(0), F.size("_spans") - 1, F.lit(2)), F.lit(0).cast("bigint"),
                      lambda a, i: a + F.element_at("_spans", (i + 2).cast("int")) - F.element_at("_spans", (i + 1).cast("int")))
    n_hit = F.when(F.size("_spans") == 0, F.lit(0).cast("bigint")).otherwise(hit)
    return df.select(*keep, F.col("_n").alias("n_words"), n_hit.alias("n_hit"), F.col("_spans").alias("hit_spans"),
                     F.col("_items").alias("hit_items"), (F.size("_spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item; same columns."""
    columns = docs.columns
    kept = docs.select(F.struct(*columns).alias("_row"), F.col(options.get("text", "text")).alias("_text"))
    found = find_windows(kept, items, **{**options, "text": "_text"})
    return found.filter(~F.col("contaminated")).select("_row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_windows(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH w AS (
  SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS m, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)
), dw AS (
  SELECT rid, p, m, array_to_string(ws[p : p + m - 1], ' ') AS win
  FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM w, (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m)
), hits AS (SELECT rid, p, dw.m, item FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m
), hw AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS pos FROM hits) GROUP BY rid
), hi AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
