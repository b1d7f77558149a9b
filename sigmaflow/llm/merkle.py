"""Merkle manifest of a dataset: one hash tree per group, a tree over the groups' roots, and a proof for each row.

Each row's fields make its leaf. Per group, leaves stand in order of their key; ``FANOUT`` neighbours make a parent until
one node is left, the group's root; the groups' roots, in order of the group, make the dataset's root by the same rule.

Slot pivot: a node's place gives its parent (place // fanout) and its slot (place % fanout). One aggregation by parent
with a conditional aggregate for each slot spreads the children into fanout columns; concatenating the columns and
hashing them gives the parent, and omitting a slot's own column gives that child's siblings. Levels are stored; then
paths go down the levels: a parent's row meets its own path by (group, place) and each of its slots becomes a row
with the path below it, so that the join at the leaves has an eighth of the rows and carries no text.

No group is gathered: leaves are sorted by range over (group, key, leaf), numbered inside each partition, and only
sums by (partition, group) cross partitions. Equal rows are counted before the sort, so that copies of one row
stay one. Digests travel as 32 bytes and are hashed as hexadecimal text. Depth is log8 of the rows.

Defined results: null groups and keys come first, equal keys in order of their leaves; equal rows get places, and so
proofs, of their own; a null field is ``-``; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.llm.kit import prepare, stage, table

FANOUT = 8
#: Copies of one row that are dealt to one row before they are told apart.
RUN = 4096
#: Depth of the highest tree of 64-bit places.
DEEPEST = 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(c: Column) -> Column:
    """A field as its UTF-8 length, a colon and its value; ``-`` if null."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def hash_of(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256))


def text_of(digest: Column) -> Column:
    """Bytes as lowercase hexadecimal text; null is empty."""
    return F.coalesce(F.lower(F.hex(digest)), F.lit(""))


def leaves(docs: DataFrame, key: str = "doc_id", group: str = "lang", text: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """g, key, leaf, changed (the leaf after tampering, where it tampers and the text changes), m (how many rows are equal)."""
    tampered = F.when(F.crc32(F.col(key).cast("string")) % 3 == 0, F.translate(F.col(text), UPPER, LOWER))
    after = [framed(tampered if f == text else F.col(f)) for f in fields]
    rows = docs.select(F.col(group).alias("g"), F.col(key).alias("key"), hash_of(*(framed(F.col(f)) for f in fields)).alias("leaf"),
                       F.when(tampered != F.col(text), hash_of(*after)).alias("changed"))
    return rows.groupBy("g", "key", "leaf", "changed").agg(F.count("*").alias("m"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``at``, the first of their ``m`` places in their group ``g`` by ``order``, and ``n``, the group's size."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("g").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    ranged = stage(rows, "merkle-rows").repartitionByRange(parts, *by).sortWithinPartitions(*by)
    schema = T.StructType([*ranged.schema.fields, T.StructField("p", T.IntegerType()), T.StructField("before", T.LongType())])
    place = ranged.columns.index("g")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        p, group, so_far = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(batch.schema.get_field_index("m")).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = batch.column(place).dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.diff(code, prepend=code[0] - 1))  # where a group begins in the batch
            upto = np.cumsum(m) - m
            before = upto - np.repeat(upto[new], np.diff(np.append(new, len(m))))
            if coded.dictionary[code[0]].as_py() == group:
                before[: new[1] if len(new) > 1 else len(m)] += so_far
            group, so_far = coded.dictionary[code[-1]].as_py(), int(before[-1] + m[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(m), p), pa.int32()), pa.array(before, pa.int64())], names=[*batch.schema.names, "p", "before"])

    local = stage(ranged.mapInArrow(count, schema), "merkle-numbered")
    sums = local.groupBy("g", "p").agg(F.sum("m").alias("s"))  # one row for a partition, and one more for each further group
    w = W.partitionBy("g").orderBy("p")
    sums = sums.select(F.col("g").alias("g_"), F.col("p").alias("p_"), (F.sum("s").over(w) - F.col("s")).alias("offset"), F.sum("s").over(W.partitionBy("g")).alias("n"))
    both = local.join(sums, local.g.eqNullSafe(sums.g_) & (local.p == sums.p_))
    return both.select(*rows.columns, (F.col("before") + F.col("offset")).alias("at"), "n")


def one_by_one(rows: DataFrame) -> DataFrame:
    """A row for each of a row's ``m`` places, made in runs of at most ``RUN``."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / RUN))))
    here = F.least(F.lit(RUN), F.col("m") - F.col("run") * RUN) - 1
    step = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), here)))
    return step.withColumn("at", F.col("at") + F.col("run") * RUN + F.col("i")).drop("m", "run", "i")


#: SQL: levels above the leaves of a tree of n leaves, and bytes as lowercase hexadecimal text (null is empty).
DEPTH = f"size(filter(array({', '.join(f'{FANOUT**k}L' for k in range(DEEPEST))}), most -> most < n))"
HEX = "coalesce(lower(hex({})), '')"


def pivoted(nodes: DataFrame) -> DataFrame:
    """Parents: g, at, n, c0..c7 (the children in their slots), digest. Nodes: g, at, n, child (a struct with ``digest``)."""
    slots = [F.expr(f"max(CASE WHEN at % {FANOUT} = {j} THEN child END)").alias(f"c{j}") for j in range(FANOUT)]
    wide = nodes.groupBy("g", F.expr(f"at div {FANOUT}").alias("at_")).agg(F.max("n").alias("n"), *slots)
    whole = ", ".join(HEX.format(f"c{j}.digest") for j in range(FANOUT))
    return wide.selectExpr("g", "at_ AS at", "n", *(f"c{j}" for j in range(FANOUT)), f"unhex(sha2(concat({whole}), 256)) AS digest")


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all groups' trees, and each group's root: g, root, n. A lone leaf is its root; its level only carries it."""
    levels = [stage(pivoted(nodes), "merkle-level")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    roots = [levels[0].filter("n = 1").selectExpr("g", "c0.digest AS root", "n")]
    k, width = 1, FANOUT
    while True:
        roots.append(levels[-1].filter(f"{DEPTH} = {k}").selectExpr("g", "digest AS root", "n"))
        if width >= most:
            return levels, reduce(DataFrame.unionByName, roots)
        above = levels[-1].filter(f"{DEPTH} > {k}").selectExpr("g", "at", "n", "named_struct('digest', digest) AS child")
        levels.append(stage(pivoted(above), "merkle-level"))
        k, width = k + 1, width * FANOUT


def _slots() -> str:
    """SQL: the slots of a parent that are taken, each with its child and the siblings on both sides, its own column left out."""
    side = lambda js: f"concat(X'', {', '.join(f'coalesce(c{j}.digest, X{chr(39) * 2})' for j in js)})" if js else "X''"
    each = (f"named_struct('slot', {j}, 'child', c{j}, 'l', {side(range(j))}, 'r', {side(range(j + 1, FANOUT))})" for j in range(FANOUT))
    return f"filter(array({', '.join(each)}), s -> s.child IS NOT NULL)"


def descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """child, path and the columns of ``top`` for every leaf.

    top: g, path, n and others, one row a group. A path has, from the leaf up, the siblings to the left and to the right.
    """
    carried = [c for c in top.columns if c not in ("g", "path", "n")]
    paths = top.withColumn("at", F.lit(0).cast("long"))
    for k in range(len(levels), 0, -1):
        level = levels[k - 1].drop("n", "digest").withColumnsRenamed({"g": "g_", "at": "at_"})
        here = paths.filter(f"{DEPTH} >= {k}") if k > 1 else paths
        met = here.join(level, here.g.eqNullSafe(level.g_) & (here.at == level.at_))
        each = met.selectExpr("g", "n", "at", "path", *carried, f"explode({_slots()}) AS s")
        longer = "IF(n > 1, concat(array(named_struct('l', s.l, 'r', s.r)), path), path) AS path"
        made = each.selectExpr("g", "n", f"at * {FANOUT} + s.slot AS at", longer, *carried, "s.child AS child")
        paths = made if k == 1 else made.drop("child").unionByName(paths.filter(f"{DEPTH} < {k}"))
    return paths.select("child", "path", *carried)


def _empty_path() -> Column:
    return F.expr("CAST(array() AS array<struct<l: binary, r: binary>>)")


def proof(path: Column) -> Column:
    """All siblings from the leaf up, left to right, as bytes."""
    return F.aggregate(path, F.lit(b""), lambda a, x: F.concat(a, x["l"], x["r"]))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path make, as hexadecimal text."""
    return F.aggregate(path, text_of(leaf), lambda h, x: F.sha2(F.concat(text_of(x["l"]), h, text_of(x["r"])), 256))


def manifest(docs: DataFrame, **options) -> DataFrame:
    """key, leaf, changed, subroot, root (bytes) and path of every row. Options: those of ``leaves``."""
    rows = one_by_one(numbered(leaves(docs, **options), ["key", "leaf"]))
    levels, subroots = build(rows.select("g", "at", "n", F.struct(F.col("leaf").alias("digest"), "key", "changed").alias("child")))
    subroots = subroots.select(F.lit(0).alias("g"), F.col("g").alias("group"), F.col("root").alias("subroot"), F.col("n").alias("rows"), F.lit(1).cast("long").alias("m"))
    placed = numbered(subroots, ["group"])
    upper, root = build(placed.select("g", "at", "n", F.struct(F.col("subroot").alias("digest"), "group", "rows").alias("child")))
    top = root.select("g", "n", "root", _empty_path().alias("path"))  # one row
    groups = descend(upper, top).select(F.col("child.group").alias("g"), F.col("child.rows").alias("n"), "path", "root", F.col("child.digest").alias("subroot"))
    found = descend(levels, stage(groups, "merkle-groups"))
    return found.select(F.col("child.key").alias("key"), F.col("child.digest").alias("leaf"), F.col("child.changed").alias("changed"), "subroot", "root", "path")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked after some are tampered with."""
    prepare(spark)
    found = manifest(table(spark, sf_dir, "documents"))
    out = found.select(F.col("key").alias("doc_id"), text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"),
                       F.sha2(text_of(proof(F.col("path"))), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 9) -> str:
    """Levels are written out; ``levels`` of them hold 8^9 leaves a group."""
    framed_ = lambda c, v=None: f"coalesce(strlen(CAST({v or c} AS VARCHAR)) || ':' || {v or c}, '-')"
    fields = lambda text: " || ".join(framed_(f, text if f == "text" else None) for f in FIELDS)
    ctes = [f"""crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), d AS (
  SELECT row_number() OVER () AS id, doc_id, lang, text, n_chars, source, CASE WHEN (SELECT xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) FROM crc) % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS bad FROM documents
), leaf AS (
  SELECT id, doc_id, lang, sha256({fields('text')}) AS h, sha256({fields('bad')}) AS f FROM d
), a0 AS (
  SELECT id, doc_id, lang, h AS leaf, h, f, '' AS proof, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf
)"""]

    def step(name: str, before: str, group: str, keep: str) -> str:
        # one level: the nodes of a run make their parent; runs of a group that is one node already stay as they are
        return f"""{name}_nodes AS (SELECT DISTINCT {group}, pos, n, h FROM {before}
), {name}_runs AS (SELECT {group}, pos // 8 AS p, list(h ORDER BY pos) AS hs FROM {name}_nodes GROUP BY ALL
), {name} AS (
  SELECT {keep}, CASE WHEN n = 1 THEN x.h ELSE sha256(array_to_string(hs, '')) END AS h,
    CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(hs[: pos % 8], '') || f || array_to_string(hs[pos % 8 + 2 :], '')) END AS f,
    CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[: pos % 8], '') || array_to_string(hs[pos % 8 + 2 :], '') END AS proof, pos // 8 AS pos, (n + 7) // 8 AS n
  FROM {before} x JOIN {name}_runs r ON r.{group} IS NOT DISTINCT FROM x.{group} AND r.p = x.pos // 8
)"""
    for k in range(levels):
        ctes.append(step(f"a{k + 1}", f"a{k}", "lang", "id, doc_id, x.lang, leaf"))
    ctes.append(f"""subs AS (SELECT DISTINCT lang, h FROM a{levels}
), places AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM subs
), b0 AS (SELECT id, doc_id, 0 AS g, leaf, x.h AS subroot, x.h, f, proof, p.pos, p.n FROM a{levels} x JOIN places p ON p.lang IS NOT DISTINCT FROM x.lang
)""")
    for k in range(4):
        ctes.append(step(f"b{k + 1}", f"b{k}", "g", "id, doc_id, x.g, leaf, subroot"))
    return "WITH " + ", ".join(ctes) + " SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM b4"


OP13_SQL = _sql()
