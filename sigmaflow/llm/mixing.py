"""Mixing sources to target weights with hash-threshold histograms (DataFrame operations only).

Every document gets a 60-bit hash. A source takes the documents whose hash lies
below a threshold: sizes are summed by source and leading hash bits, the running
sum finds the bucket in which the budget ends, and only that bucket is summed
again by the next bits, until the document at the boundary is known. Nothing is
sorted but at most 2**BITS sums of a source. A target above the source's size takes whole
copies first and a threshold for the rest, so the takes of a growing budget nest.

A boundary document that does not fit is left out; while more than ``TOLERANCE``
of the target is missing, the search goes on behind it among documents that are not
larger than what is missing, and the source's take is a list of hash ranges, each
with the largest size it takes.

Defined results: a null text has size 0; a null source is a source of its own and last; rows
that share hash (same key and text) are taken or left together; sources of size 0 have
target 0; an empty table gives an empty result; input columns that share a result's name are
replaced. The list of sources is a table of one row each; it is broadcast only below ``BROADCAST_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigmaflow.llm.kit import prepare, stage, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
TOLERANCE = 0.002
BITS = 12
HASH_BITS = 60
BROADCAST_ROWS = 100_000
SEED = "mix-1"


def text_size(text: str) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(key: str, text: str, seed: str = SEED) -> Column:
    words = F.concat(F.lit(seed + "|"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(words), 1, 15), 16, 10).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def targets(slim: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target: shares by weight, none above ``most`` times its source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    level = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    df = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    df = df.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    df = df.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    everything = W.partitionBy()
    df = df.withColumn("_total", F.least(F.sum("source_size").over(everything) * F.lit(share), F.sum("_cap").over(everything)))
    # with the sources of smaller ratio full, the others share what is left by weight
    df = df.withColumn("_full", F.coalesce(F.sum("_cap").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("_rest_w", F.sum("_w").over(level.rowsBetween(0, W.unboundedFollowing)))
    df = df.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_rest_w"))
    fits = F.when(F.col("_level") <= F.col("_ratio") * (1 + 1e-12), F.col("_level"))
    df = df.withColumn("_level", F.coalesce(F.max(fits).over(everything), F.lit(0.0)))
    return df.select("source", "source_size", F.round(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), 6).alias("target"))


def hash_ranges(slim: DataFrame, goal: DataFrame, tolerance: float = TOLERANCE, bits: int = BITS) -> DataFrame:
    """goal with whole copies and the hash ranges [lo, hi) taken once more.

    slim: source, hash, size. State of a source: the budget left, where the present
    range begins, and the bucket [at, end) in which it must end.
    """
    top = F.lit(1 << HASH_BITS)
    budget = F.floor(F.col("target") + 1e-6).cast("long")
    state = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.withColumn("left", budget - F.col("whole") * F.col("source_size"))
    state = state.withColumns({"open": F.col("left") > F.col("target") * tolerance, "lo": F.lit(0).cast("long"), "at": F.lit(0).cast("long"), "end": top,
                               "below": F.lit(0).cast("long"), "cap": F.col("left"), "shift": F.lit(HASH_BITS - bits), "ranges": F.array().cast("array<struct<lo:bigint,hi:bigint,cap:bigint>>")})
    state = stage(state, "mix-state")
    sources = state.count()
    while not state.filter("open").isEmpty():
        open_ = state.filter("open").select(F.col("source").alias("s"), "left", "at", "end", "below", "cap", "shift")
        inside = slim.join(_small(open_, sources), F.col("source").eqNullSafe(F.col("s"))).filter("hash >= at AND hash < end AND size <= cap")
        inside = inside.withColumn("b", F.expr("shiftright(hash, shift)"))
        sums = inside.groupBy("s", "b").agg(F.sum("size").alias("n"), F.min("hash").alias("h0"), F.max("hash").alias("h1"), F.first("left").alias("left"), F.first("below").alias("below"))
        sums = sums.withColumn("upto", F.sum("n").over(W.partitionBy("s").orderBy("b")) + F.col("below"))
        over = F.col("upto") > F.col("left")
        found = sums.groupBy("s").agg(F.min(F.when(over, F.struct("b", (F.col("upto") - F.col("n")).alias("before"), "h0", "h1"))).alias("x"), F.max("upto").alias("all"))
        joined = state.join(_small(found, sources), F.col("source").eqNullSafe(F.col("s")), "left")
        ends = F.col("open") & F.col("x").isNull()  # the rest of the source fits
        single = F.col("open") & F.col("x").isNotNull() & ((F.col("x.h0") == F.col("x.h1")) | (F.col("shift") == 0))
        deeper = F.col("open") & F.col("x").isNotNull() & ~single
        to = F.when(ends, top).otherwise(F.col("x.h0"))
        left = F.col("left") - F.when(ends, F.coalesce("all", "below")).otherwise(F.col("x.before"))
        new = {
            "ranges": F.when(ends | single, F.concat("ranges", F.array(F.struct(F.col("lo").alias("lo"), to.alias("hi"), F.col("cap"))))).otherwise(F.col("ranges")),
            "left": F.when(ends | single, left).otherwise(F.col("left")),
            "open": F.when(ends, False).when(single, left > F.col("target") * tolerance).otherwise(F.col("open")),
            "cap": F.when(single, left).otherwise(F.col("cap")),
            "lo": F.when(single, F.col("x.h1") + 1).otherwise(F.col("lo")),
            "at": F.when(single, F.col("x.h1") + 1).when(deeper, F.greatest(F.col("at"), F.expr("shiftleft(x.b, shift)"))).otherwise(F.col("at")),
            "end": F.when(single, top).when(deeper, F.expr("shiftleft(x.b + 1, shift)")).otherwise(F.col("end")),
            "below": F.when(single, F.lit(0)).when(deeper, F.col("x.before")).otherwise(F.col("below")),
            "shift": F.when(single, F.lit(HASH_BITS - bits)).when(deeper, F.greatest(F.col("shift") - bits, F.lit(0))).otherwise(F.col("shift")),
        }
        state = stage(joined.select(*(new.get(c, F.col(c)).alias(c) for c in state.columns)), "mix-state")
    return state.select("source", "source_size", "target", "whole", "ranges")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_s")
    df = rows.join(_small(plan, plan.count()), F.col("_source").eqNullSafe(F.col("_s")))
    copies = F.col("whole") + F.exists("ranges", lambda r: (F.col("_hash") >= r.lo) & (F.col("_hash") < r.hi) & (F.col("size") <= r.cap)).cast("long")
    return df.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_s", "whole", "ranges")


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = SHARE,
        most: int = MAX_COPIES, tolerance: float = TOLERANCE, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, copies and taken."""
    prepare(docs.sparkSession)
    docs = docs.drop(*({"size", "source_size", "target", "copies", "taken", "_hash", "_source"} - {key, source, text}))
    rows = docs.withColumns({"_source": F.col(source), "size": text_size(text), "_hash": row_hash(key, text, seed)})
    slim = stage(rows.select(F.col("_source").alias("source"), F.col("_hash").alias("hash"), "size"), "mix-rows")
    plan = hash_ranges(slim, targets(slim, weights, share, most), tolerance)
    return _taken(rows, plan).drop("_hash", "_source")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; same columns."""
    names = {**{"key": "doc_id", "source": "source", "text": "text"}, **options}
    inner = {"key": "_key", "source": "_src", "text": "_text"}
    packed = docs.select(F.struct(*docs.columns).alias("_row"), *(F.col(names[k]).alias(v) for k, v in inner.items()))
    df = mix(packed, **{**options, **inner})
    return df.withColumn("_n", F.explode(F.sequence(F.lit(0), F.col("copies")))).filter("_n > 0").select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    rows = stage(docs.select("doc_id", F.col("source").alias("_source"), text_size("text").alias("size"), row_hash("doc_id", "text").alias("_hash")), "mix-rows")
    slim = rows.select(F.col("_source").alias("source"), F.col("_hash").alias("hash"), "size")
    return _taken(rows, hash_ranges(slim, targets(slim))).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), r AS (
  SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / w AS ratio, least(sum(source_size) OVER () * 1.5, sum(2.0 * source_size) OVER ()) AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r
), t AS (
  SELECT sid, source, source_size, round(least(cap, w * coalesce(max(CASE WHEN lv <= ratio * (1 + 1e-12) THEN lv END) OVER (), 0)), 6) AS target FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 1e-6) AS BIGINT) // source_size ELSE 0 END AS whole, CAST(floor(target + 1e-6) AS BIGINT) AS budget FROM t
), g AS (
  SELECT sid, h, CAST(sum(size) AS BIGINT) AS n, max(size) AS one, row_number() OVER (PARTITION BY sid ORDER BY h) AS k
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source GROUP BY sid, h
), walk AS (
  SELECT sid, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS h, budget - whole * source_size AS rest, budget - whole * source_size AS cap,
         budget - whole * source_size > target * 0.002 AS open, target, false AS took FROM b
  UNION ALL
  SELECT w.sid, g.k, g.h, CASE WHEN w.open AND g.n <= w.rest AND g.one <= w.cap THEN w.rest - g.n ELSE w.rest END,
         CASE WHEN w.open AND g.n > w.rest AND g.one <= w.cap THEN w.rest ELSE w.cap END,
         w.open AND (g.n <= w.rest OR g.one > w.cap OR w.rest > w.target * 0.002), w.target, w.open AND g.n <= w.rest AND g.one <= w.cap
  FROM walk w JOIN g ON g.sid = w.sid AND g.k = w.k + 1
)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST((b.whole + CASE WHEN w.took THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN walk w ON w.sid = b.sid AND w.h = d.h AND w.k > 0
"""
