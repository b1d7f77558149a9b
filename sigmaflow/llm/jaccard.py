"""N-gram Jaccard join by chosen paths: documents whose sets of five-word shingles have similarity 0.8 or more.

Texts that are equal are one record. A record's set is embedded as ``COORDS`` tokens (coordinate,
minimum of a hash of its shingles), so two records share a token with the probability of their similarity.

In each of ``RUNS`` independent runs a record follows one path: its bucket at a node is split by the token
of a coordinate that the node's hash chooses. Buckets of ``LEAF`` records or fewer are compared by brute force; larger
ones are split again, down to the depth at which ``RUNS`` paths still find a pair at the
threshold with probability ``RECALL``, or until a split no longer thins a bucket out. What is then
still large holds records that are mostly alike and is compared in blocks, block against block.

A bucket's comparison (of sketches, with a margin of several standard errors) only emits links that join its
records into groups. The join itself is exact: groups are gathered once by connected components and all
pairs inside a group are compared by their whole sets, again in blocks for large groups. A block
returns each record's number of links and a spanning set of edges, never the pairs.

Defined results: words as in ``kit.WORDS``; a text of one to four words has one shingle; a text without words (null,
empty) has no links and is a class by itself; rows equal in text are linked to each other; classes are connected components,
named by their smallest doc_id (null ids are larger than all); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.llm.graphs import components
from sigmaflow.llm.kit import as_bytes, mix, prepare, scan, shingle_codes, stage, table, text_keys, whole_groups, word_codes

WIDTH = 5
THRESHOLD = (4, 5)  # similarity 4 / 5, as integers
COORDS = 64
RUNS = 12
RECALL = 0.999
LEAF = 128
BLOCK = 512
BLOCK_BYTES = 4 << 20
#: Least share of equal coordinates of a pair that is looked at exactly: five standard errors below the threshold.
LEAST_EQUAL = 0.55
BROADCAST_ROWS = 1_000_000
_COEF = np.random.default_rng(99).integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def max_depth(runs: int = RUNS, recall: float = RECALL) -> int:
    """Splits after which the runs together still find a pair at the threshold with this probability."""
    s, d = THRESHOLD[0] / THRESHOLD[1], 1
    while (1 - s ** (d + 1)) ** runs <= 1 - recall:
        d += 1
    return d


def _signatures(batch: pa.RecordBatch) -> dict:
    codes, counts = word_codes(as_bytes(batch.column(batch.schema.get_field_index("_text"))))
    shingles, n = shingle_codes(codes, counts, WIDTH)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((shingles, row))
    s, r = shingles[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=len(n))
    some = np.flatnonzero(n > 0)
    begin = (np.cumsum(n) - n)[some]
    low = np.zeros((len(n), COORDS), np.uint64)
    for c in range(COORDS):
        if len(some):
            low[some, c] = np.minimum.reduceat(shingles * _COEF[c], begin)
    low = mix(low)
    keys = mix(low[:, :RUNS] + np.arange(RUNS, dtype=np.uint64)).view(np.int64)
    return {"n": distinct, "keys": list(keys), "sketch": [x.tobytes() for x in low.astype(np.uint8)]}


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component, of square boolean matrices [..., g, g]."""
    g = linked.shape[-1]
    linked = linked | np.eye(g, dtype=bool)
    label = np.broadcast_to(np.arange(g), linked.shape[:-1]).copy()
    while True:
        new = np.where(linked, label[..., None, :], g).min(axis=-1)
        if (new == label).all():
            return label
        label = new


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _alike(sketch: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pairs of [..., g] records that may reach the threshold."""
    g = sketch.shape[-2]
    equal = np.zeros((*sketch.shape[:-2], g, g), np.int16)
    for c in range(sketch.shape[-1]):
        equal += sketch[..., :, None, c] == sketch[..., None, :, c]
    few, many = np.minimum(n[..., :, None], n[..., None, :]), np.maximum(n[..., :, None], n[..., None, :])
    return (equal >= LEAST_EQUAL * sketch.shape[-1]) & (few * THRESHOLD[1] >= many * THRESHOLD[0])


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["key", "p", "q"]):
        ident = np.stack([t[c].to_numpy() for c in ("key", "p", "q")])
        start = np.flatnonzero(np.append(True, (ident[:, 1:] != ident[:, :-1]).any(axis=0)))
        many = np.diff(np.append(start, t.num_rows))
        if many.max() < 2:
            continue
        sid, n = t["sid"].to_numpy(), t["n"].to_numpy()
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        for g in np.unique(many[many > 1]):  # all groups of one size together
            at = start[many == g]
            step = max(1, (1 << 22) // int(g * g))
            for i in range(0, len(at), step):
                rows = at[i : i + step, None] + np.arange(g)
                label = _labels(_alike(sketch[rows], n[rows]))
                off = label != np.arange(g)
                if off.any():
                    own = sid[rows]
                    root = np.take_along_axis(own, label, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(own[off]), pa.array(root[off])], schema=_EDGES)


def candidate_edges(records: DataFrame) -> DataFrame:
    """Edges (a, b) that join records that may be similar; records: sid, n, keys, sketch."""
    spark = records.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = records.filter("n > 0").select("sid", "n", "sketch", F.explode("keys").alias("key"), F.lit(None).cast("long").alias("before"))
    found, depth = [], 1
    while True:
        sizes = level.groupBy("key").agg(F.count("*").alias("size"), F.first("before").alias("before")).filter(F.col("size") > LEAF)
        big = stage(sizes, "path-large")
        n_big = big.count()
        hint = F.broadcast(big) if n_big <= BROADCAST_ROWS else big
        marked = level.drop("before").join(hint, "key", "left") if n_big else level.drop("before").withColumns({"size": F.lit(None).cast("long"), "before": F.lit(None).cast("long")})
        # small buckets, and large ones that a split no longer thins out or may not split further
        stop = F.col("size").isNull() | F.lit(depth >= max_depth()) | F.coalesce(F.col("size") > 0.7 * F.col("before"), F.lit(False))
        blocks = F.when(F.col("size").isNull(), 1).otherwise(F.ceil(F.col("size") / BLOCK)).cast("int")
        mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
        leaf = marked.filter(stop).withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        leaf = leaf.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "sid", "n", "sketch")
        found.append(stage(leaf.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_bucket_edges, "a long, b long").distinct(), "path-edges"))
        if not n_big:
            break
        deeper = marked.filter(~stop)
        where = F.pmod(F.xxhash64("key", F.lit(depth)), F.lit(COORDS)).cast("int") + 1
        level = deeper.select("sid", "n", "sketch", F.xxhash64("key", F.lit(depth), F.substring("sketch", where, F.lit(1))).alias("key"), F.col("size").alias("before"))
        level = stage(level, "path-level")
        if level.isEmpty():
            break
        depth += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _sets(batch: pa.RecordBatch) -> dict:
    codes, counts = word_codes(as_bytes(batch.column(batch.schema.get_field_index("_text"))))
    shingles, n = shingle_codes(codes, counts, WIDTH)
    at = np.cumsum(n) - n
    return {"set": [np.unique(shingles[a : a + k]).tobytes() for a, k in zip(at.tolist(), n.tolist(), strict=True)]}


_LINKS = pa.schema([("sid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    every, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seen = np.bincount(column, minlength=len(every))
    place = np.cumsum(seen > 1) - 1
    row, column = row[seen[column] > 1], place[column[seen[column] > 1]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        x = np.zeros((len(sets), step), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["grp", "p", "q"]):
        ident = np.stack([t[c].to_numpy() for c in ("grp", "p", "q")])
        start = np.append(np.flatnonzero(np.append(True, (ident[:, 1:] != ident[:, :-1]).any(axis=0))), t.num_rows)
        sid_all, mine_all, copies_all = t["sid"].to_numpy(), t["mine"].to_numpy(), t["copies"].to_numpy()
        sets_all = t["set"].to_pylist()
        out: list[list[np.ndarray]] = [[], [], []]
        for a, b in zip(start[:-1], start[1:], strict=True):
            sid, first = np.unique(sid_all[a:b], return_index=True)
            if len(sid) < 2:
                continue
            sets = [np.frombuffer(sets_all[a + i], np.uint64) for i in first]
            mine, copies = mine_all[a + first], copies_all[a + first]
            n = np.array([len(s) for s in sets])
            both = _common(sets)
            p, q = ident[1, a], ident[2, a]
            asked = (mine[:, None] == p) & (mine[None] == q) | (mine[:, None] == q) & (mine[None] == p)
            near = asked & (THRESHOLD[1] * both >= THRESHOLD[0] * (n[:, None] + n[None] - both))
            np.fill_diagonal(near, False)
            out[0].append(sid)
            out[1].append((near * copies[None]).sum(axis=1))
            out[2].append(sid[_labels(near)])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], schema=_LINKS)


def similar(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, x0, x1 (of the text), class_id, class_row (the class's first row), n_links, n_copies."""
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    docs = docs.select("doc_id", "_text", *text_keys("_text"))
    fields = [("n", T.LongType()), ("keys", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())]
    signed = stage(scan(docs, _signatures, fields, ["doc_id", "x0", "x1"]), "jaccard-signatures")
    records = signed.groupBy("x0", "x1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    records = stage(records.withColumn("sid", F.monotonically_increasing_id()), "jaccard-records")

    groups = components(candidate_edges(records)).withColumnsRenamed({"node": "sid", "root": "grp"})
    members = stage(groups.join(records.select("sid", "x0", "x1", "rep", "copies", "n"), "sid"), "jaccard-members")
    size = members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    wanted = members.join(size, "grp").withColumnRenamed("rep", "_rep")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    chosen = docs.join(wanted, (docs.x0 == wanted.x0) & (docs.x1 == wanted.x1) & docs.doc_id.eqNullSafe(F.col("_rep"))).select("sid", "grp", "copies", "blocks", "_text")
    sets = scan(chosen, _sets, [("set", T.BinaryType())], ["sid", "grp", "copies", "blocks"])
    sets = sets.withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.select("grp", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "sid", "copies", "set")
    links = stage(sets.repartition(parts, "grp", "p", "q").sortWithinPartitions("grp", "p", "q").mapInArrow(_block_links, "sid long, links long, root long"), "jaccard-links")

    roots = components(links.select(F.col("sid").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "sid"})
    linked = links.groupBy("sid").agg(F.sum("links").alias("links"))
    full = records.select("sid", "x0", "x1", "rep", "copies", "n").join(linked, "sid", "left").join(roots, "sid", "left")
    full = stage(full.withColumn("root", F.coalesce("root", "sid")), "jaccard-classes")
    # smallest id, null last; one record per class
    first = full.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("rep"), "x0", "x1")).alias("class_row"))
    full = full.join(first, "root").select("x0", "x1", "n", "class_row", F.col("copies").alias("n_copies"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    out = signed.select("doc_id", "x0", "x1").join(full, ["x0", "x1"])
    empty = F.col("n") == 0
    return out.select("doc_id", "x0", "x1", F.when(empty, F.col("doc_id")).otherwise(F.col("class_row.rep")).alias("class_id"), F.when(~empty, F.col("class_row")).alias("class_row"),
                      F.when(empty, F.lit(0).cast("long")).otherwise(F.col("links") + F.col("n_copies") - 1).alias("n_links"), "n_copies")


def drop_similar(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` but for all except the first of each class; same columns. Rows without words stay."""
    found = stage(similar(docs, key=key, text=text), "jaccard-found")
    is_first = F.col("doc_id").eqNullSafe(F.col("class_row.rep")) & (F.col("x0") == F.col("class_row.x0")) & (F.col("x1") == F.col("class_row.x1"))
    gone = found.filter(F.col("class_row").isNotNull() & ~is_first).select(F.col("doc_id").alias("_d"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).select("_row", "_key", "_text", *text_keys("_text"))
    left = packed.join(gone, F.col("_key").eqNullSafe(F.col("_d")) & (F.col("x0") == F.col("_x0")) & (F.col("x1") == F.col("_x1")), "left_anti")
    repeated = found.filter(is_first).groupBy("doc_id", "x0", "x1").count().filter("count > 1")
    if not repeated.isEmpty():  # rows equal in key and text: one of them stays
        worded = F.col("_text").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")
        left = left.filter(worded).dropDuplicates(["_key", "x0", "x1"]).unionByName(left.filter(~worded))
    return left.select("_row.*")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), near AS (
  SELECT a, b FROM pairs JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reach AS (SELECT doc_id AS v, doc_id AS t FROM w UNION SELECT r.v, e.b FROM reach r JOIN e ON e.a = r.t
), cls AS (SELECT v, min(t) AS class_id FROM reach GROUP BY v
), deg AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links FROM w JOIN cls ON v = doc_id LEFT JOIN deg ON a = doc_id
"""
