"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one class, kept with its ``k`` + 1 smallest ids, so copies can't fill a graph's
neighbourhoods. Classes are dealt to shards by hash. A shard's nodes are numbered by falling level, so
each level is a prefix, and its graph is a flat int32 array of neighbour numbers (-1: none). The graph is
over inner products of vectors with one more component that gives all the same length, which turns largest inner
product into nearest neighbour. Nodes enter in batches: beam search from the level above, candidates of
the batch itself, then the usual diversity rule for links both ways.

Every query is searched in every shard (blocks of queries meet shards by key); candidates are scored in
double precision on the vectors as given, and the shards' results are merged per query.

Defined results: vectors that are null, of another length than most, zero or with null or
non-finite components, and rows of null id, take no part; rows equal in id and vector count once; ties go to
the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmaflow.llm.kit import prepare, stage, table

K = 20
LINKS = 16
EF_BUILD = 64
EF = 200
SHARD_ROWS = 20_000
QUERY_ROWS = 16_384
LANES = 512
BATCH = 1024


def _beam(vec: np.ndarray, links: np.ndarray, n: int, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef most similar nodes found among the first n for each query, all queries at once; -1 pads."""
    b = len(queries)
    entry = np.where(entry < n, entry, 0)  # a node of the level above that has not entered this one yet
    ids, sim = np.full((b, ef), -1), np.full((b, ef), -np.inf, np.float32)
    done = np.zeros((b, ef), bool)
    seen = np.zeros((b, n), bool)
    ids[:, 0], sim[:, 0] = entry, np.einsum("bd,bd->b", queries, vec[entry])
    seen[np.arange(b), entry] = True
    alive = np.arange(b)
    while len(alive):
        best = np.argmax(np.where(done[alive], -np.inf, sim[alive]), axis=1)
        open_ = ~done[alive, best] & (ids[alive, best] >= 0)
        alive, best = alive[open_], best[open_]
        if not len(alive):
            break
        done[alive, best] = True
        near = links[ids[alive, best]]
        lane = np.broadcast_to(alive[:, None], near.shape)
        fresh = (near >= 0) & (near < n)
        fresh &= ~seen[lane, np.where(fresh, near, 0)]
        seen[lane[fresh], near[fresh]] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[fresh] = np.einsum("xd,xd->x", queries[lane[fresh]], vec[near[fresh]])
        all_sim = np.concatenate([sim[alive], got], axis=1)
        order = np.argsort(-all_sim, axis=1, kind="stable")[:, :ef]
        sim[alive] = np.take_along_axis(all_sim, order, 1)
        ids[alive] = np.take_along_axis(np.concatenate([ids[alive], np.where(fresh, near, -1)], axis=1), order, 1)
        done[alive] = np.take_along_axis(np.concatenate([done[alive], ~fresh], axis=1), order, 1)
    return ids, sim


def _diverse(vec: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the row's node than to any kept before; filled up by nearness."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    real = cand >= 0
    real[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    v = vec[np.maximum(cand, 0)]
    between = np.einsum("bid,bjd->bij", v, v)
    keep = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        closest = np.where(keep, between[:, j], -np.inf).max(axis=1)
        keep[:, j] = real[:, j] & (sim[:, j] > closest) & (keep.sum(axis=1) < most)
    rank = np.argsort(np.where(keep, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((len(cand), most), -1, np.int32)
    chosen = np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(cand, rank, 1), -1)
    out[:, : chosen.shape[1]] = chosen
    return out


class Graph:
    """Vectors by falling level, level sizes (level 0 first) and flat neighbour arrays."""

    def __init__(self, vec: np.ndarray, sizes: list[int], links: list[np.ndarray]):
        self.vec, self.sizes, self.links = vec, sizes, links

    def search(self, queries: np.ndarray, ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
        ids, sim = [], []
        for i in range(0, len(queries), LANES):
            q = queries[i : i + LANES]
            a, s = _beam(self.vec, self.links[0], self.sizes[0], q, self._entry(q, 0), ef)
            ids.append(a)
            sim.append(s)
        return np.concatenate(ids), np.concatenate(sim)

    def _entry(self, q: np.ndarray, level: int) -> np.ndarray:
        at = np.zeros(len(q), np.int64)
        for up in range(len(self.links) - 1, level, -1):
            at = _beam(self.vec, self.links[up], self.sizes[up], q, at, 1)[0][:, 0]
        return at

    @classmethod
    def build(cls, vec: np.ndarray, seed: int = 1) -> tuple[Graph, np.ndarray]:
        """The graph and the order in which it holds the rows."""
        length = np.einsum("nd,nd->n", vec, vec)
        vec = np.concatenate([vec, np.sqrt(np.maximum(length.max() - length, 0))[:, None]], axis=1).astype(np.float32)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(vec))) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")
        vec, level = np.ascontiguousarray(vec[order]), level[order]
        sizes = [int((level >= up).sum()) for up in range(level[0] + 1)]
        g = cls(vec, sizes, [np.zeros((0, 1), np.int32)] * len(sizes))
        for up in range(len(sizes) - 1, -1, -1):
            g.links[up] = np.full((sizes[up], LINKS if up else 2 * LINKS), -1, np.int32)
            g._fill(up)
        return g, order

    def _fill(self, level: int) -> None:
        n, links, vec = self.sizes[level], self.links[level], self.vec
        at = 0
        while at < n:
            end = min(n, at + (256 if not at else min(BATCH, at)))
            new = np.arange(at, end)
            own = vec[new] @ vec[new].T
            np.fill_diagonal(own, -np.inf)
            k = min(len(new), 2 * LINKS)
            inner = np.argsort(-own, axis=1, kind="stable")[:, :k]
            cand, sim = np.where(np.take_along_axis(own, inner, 1) > -np.inf, new[inner], -1), np.take_along_axis(own, inner, 1)
            if at:
                parts = [_beam(vec, links, at, vec[new[i : i + LANES]], self._entry(vec[new[i : i + LANES]], level), EF_BUILD) for i in range(0, len(new), LANES)]
                cand = np.concatenate([cand, np.concatenate([p[0] for p in parts])], axis=1)
                sim = np.concatenate([sim, np.concatenate([p[1] for p in parts])], axis=1)
            links[new] = _diverse(vec, cand, sim, links.shape[1])
            self._back(links, new)
            at = end

    def _back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Links from the neighbours back to the new nodes."""
        source = np.repeat(new, links.shape[1])
        target = links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        sim = np.einsum("xd,xd->x", self.vec[source], self.vec[target])
        order = np.lexsort((-sim, target))
        source, target, sim = source[order], target[order], sim[order]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, many)
        width = min(int(many.max(initial=0)), 2 * links.shape[1])  # the nearest back links; a list holds no more
        near = place < width
        for i in range(0, len(nodes), BATCH):
            part = nodes[i : i + BATCH]
            mine = near & (target >= part[0]) & (target <= part[-1])
            row = np.searchsorted(part, target[mine])
            more, more_sim = np.full((len(part), width), -1), np.full((len(part), width), -np.inf, np.float32)
            more[row, place[mine]], more_sim[row, place[mine]] = source[mine], sim[mine]
            old = links[part]
            old_sim = np.where(old >= 0, np.einsum("bd,bjd->bj", self.vec[part], self.vec[np.maximum(old, 0)]), -np.inf)
            links[part] = _diverse(self.vec, np.concatenate([old, more], axis=1), np.concatenate([old_sim, more_sim], axis=1), links.shape[1])


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: the rows that take part."""
    df = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    sizes = df.groupBy(F.size("v").alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").first()
    dim = sizes.n if sizes else 0
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col("id").isNotNull() & (F.size("v") == dim) & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """v0, v1, v, ids: distinct vectors with their smallest ids, gathered in three steps so that no copy group meets in one task."""
    df = rows.withColumns({"v0": F.xxhash64("v"), "v1": F.xxhash64(F.lit(7), F.col("v")), "salt": F.pmod(F.xxhash64("id"), F.lit(64))}).dropDuplicates(["id", "v0", "v1"])
    for salts in (64, 8):
        w = W.partitionBy("v0", "v1", F.col("salt") % salts).orderBy("id")
        df = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)
    return df.groupBy("v0", "v1").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))


def build_index(rows: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """One row per shard with its graph; the number of shards. rows: id, v."""
    found = stage(classes(rows, k + 1), "hnsw-classes")
    shards = max(1, -(-found.count() // shard_rows))
    found = found.withColumn("shard", F.pmod("v0", F.lit(shards)).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        n = group.num_rows
        v = _matrix(group["v"], n)
        graph, order = Graph.build(v.astype(np.float64))
        ids = [x for i in order for x in group["ids"][int(i)].as_py()]
        at = np.concatenate([[0], np.cumsum([len(group["ids"][int(i)]) for i in order])]).astype(np.int64)
        row = {"shard": group["shard"][0].as_py(), "dim": v.shape[1], "wide": v.dtype == np.float64, "vectors": np.ascontiguousarray(v[order]).tobytes(), "tail": graph.vec[:, -1].tobytes(),
               "sizes": graph.sizes, "links": [x.tobytes() for x in graph.links], "ids": ids, "id_at": at.tolist()}
        return pa.Table.from_pylist([row], schema=_INDEX)

    index = found.groupBy("shard").applyInArrow(build, "shard int, dim int, wide boolean, vectors binary, tail binary, sizes array<bigint>, links array<binary>, ids array<bigint>, id_at array<bigint>")
    return stage(index, "hnsw-index"), shards


_INDEX = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("wide", pa.bool_()), ("vectors", pa.binary()), ("tail", pa.binary()), ("sizes", pa.list_(pa.int64())),
                    ("links", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("id_at", pa.list_(pa.int64()))])


def _matrix(column, n: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int = K, ef: int = EF, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, id, score of the k nearest found; queries: id, v."""
    blocks = max(1, -(-queries.count() // query_rows))
    q = queries.select(F.col("id").alias("query_id"), "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    sides = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(one: pa.Table, asked: pa.Table) -> pa.Table:
        if not one.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        r = one.to_pylist()[0]
        v = np.frombuffer(r["vectors"], np.float64 if r["wide"] else np.float32).reshape(-1, r["dim"])
        n = len(v)
        vec = np.concatenate([v.astype(np.float32), np.frombuffer(r["tail"], np.float32)[:, None]], axis=1)
        links = [np.frombuffer(x, np.int32).reshape(m, -1) for x, m in zip(r["links"], r["sizes"], strict=True)]
        graph = Graph(vec, r["sizes"], links)
        want = _matrix(asked["v"], asked.num_rows).astype(np.float64)
        near, _ = graph.search(np.concatenate([want, np.zeros((len(want), 1))], axis=1).astype(np.float32), min(max(ef, k + 1), max(n, 1)))
        ids, at = np.array(r["ids"], np.int64), np.array(r["id_at"], np.int64)
        names = asked["query_id"].to_numpy()
        out = []
        for i in range(0, len(want), LANES):
            part = near[i : i + LANES]
            lane, col = np.nonzero(part >= 0)
            node = part[lane, col]
            score = np.einsum("xd,xd->x", want[i + lane], v[node].astype(np.float64))
            many = at[node + 1] - at[node]
            each = np.repeat(np.arange(len(node)), many)
            found = ids[np.repeat(at[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            row, score = lane[each], score[each]
            other = found != names[i + row]
            row, score, found = row[other], score[other], found[other]
            order = np.lexsort((found, -score, row))
            row, score, found = row[order], score[order], found[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank < k
            out.append(pa.table([names[i + row[top]], found[top], score[top]], schema=_FOUND))
        return pa.concat_tables(out)

    found = sides.groupBy("shard", "qb").cogroup(q.groupBy("shard", "qb")).applyInArrow(search, "query_id bigint, id bigint, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


_FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    prepare(spark)
    rows = clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index, shards = build_index(rows)
    queries = rows.filter("id % 20 = 0").dropDuplicates(["id"])
    return search_index(index, shards, queries).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
