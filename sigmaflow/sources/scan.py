"""Raw CSV scan with an inferred schema, and a quarantine of the lines that don't fit it.

The columns' types come from a sample of lines of all files: the narrowest of whole number, number, timestamp and text that at least
``SHARE`` of a column's sampled values have, so that a few bad values don't turn a price column into text. The scan itself
reads every field as text with the broken lines kept, casts, and splits the rows in one pass: those that fit, and those that
don't with every reason. No value becomes null silently: a field that is there and can't be cast is a reason.

Every file must have the same header, names in any case: a file with another one ends the scan with an error, since its
lines would be read under wrong names. Empty fields and the ``NULLS`` texts are nulls, not errors, but for required
columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for no value, and what numbers and timestamps look like.
NULLS = ("", "NA", "NaN", "null", "NULL")
LOOKS = {"bigint": r"^[+-]?[0-9]+$", "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$",
         "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?)?$"}
#: Share of lines that are sampled, and the share of a column's sampled values that a type must fit.
SAMPLE, SHARE = 0.1, 0.9
#: Sampled lines below which all lines are looked at.
LEAST_SAMPLE = 1_000
CORRUPT = "_corrupt"
TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(), "string": T.StringType()}


@dataclass(frozen=True)
class Inferred:
    """Column names as in the header, and the type of each."""

    names: tuple[str, ...]
    types: tuple[str, ...]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, TYPES[t]) for n, t in zip(self.names, self.types, strict=True)])


def _value(name: str) -> Column:
    """The field without blanks around it, null where it stands for none."""
    c = F.trim(F.col(f"`{name}`"))
    return F.when(~c.isin(*NULLS), c)


def _cast(c: Column, kind: str) -> Column:
    """The value in a type; null where it doesn't look like one (words like "Infinity" are no prices) or is out of range."""
    return c if kind == "string" else F.when(c.rlike(LOOKS[kind]), c.try_cast(kind))


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in one file's first line; the scan checks those of all files against it."""
    first = spark.read.text(path).limit(1).collect()
    return tuple(n.strip().strip('"') for n in first[0].value.split(",")) if first else ()


def _raw(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """All fields as text, and the whole line where the number of fields is wrong."""
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .option("enforceSchema", False).csv(path))


def infer(spark: SparkSession, path: str, sample: float = SAMPLE, seed: int = 7) -> Inferred:
    """Types from a sample of the lines of all files; from all lines where the sample is small."""
    names = header(spark, path)
    if not names:
        return Inferred((), ())
    if CORRUPT in names or len(set(map(str.lower, names))) != len(names):
        raise ValueError(f"header with repeated or reserved names: {names}")
    whole = _raw(spark, path, names).where(F.col(CORRUPT).isNull())

    def fits(rows: DataFrame):
        parts = [F.count(_value(n)).alias(f"n{i}") for i, n in enumerate(names)]
        parts += [F.count(_cast(_value(n), k)).alias(f"{k}{i}") for i, n in enumerate(names) for k in TYPES]
        return rows.agg(F.count("*").alias("rows"), *parts).first()

    got = fits(whole.sample(fraction=sample, seed=seed))
    if got["rows"] < LEAST_SAMPLE:
        got = fits(whole)
    kinds = tuple(next(k for k in TYPES if k == "string" or got[f"{k}{i}"] >= max(1, SHARE * got[f"n{i}"])) for i in range(len(names)))
    return Inferred(names, kinds)


def _reasons(found: Inferred, required: tuple[str, ...]) -> Column:
    """Why a line doesn't fit: its number of fields alone, or each field that can't be cast or is missing."""
    shape = F.when(F.col(CORRUPT).isNotNull(), F.lit("number of fields"))
    bad = [F.when(_value(n).isNotNull() & _cast(_value(n), k).isNull(), F.lit(f"{n}: not a {k}")) for n, k in zip(found.names, found.types, strict=True)]
    missing = [F.when(_value(n).isNull(), F.lit(f"{n}: missing")) for n in found.names if n in required]
    return F.when(shape.isNotNull(), F.array(shape)).otherwise(F.array_compact(F.array(*bad, *missing)))


def scan(spark: SparkSession, path: str, found: Inferred | None = None, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, quarantine): the table in the inferred types, and ``file, line, reasons`` of every other line.

    ``required`` columns must have a value. Every line of every file is in exactly one of the two.
    """
    found = found or infer(spark, path)
    if not found.names:
        empty = spark.createDataFrame([], T.StructType([]))
        return empty, spark.createDataFrame([], "file string, line string, reasons array<string>")
    raw = _raw(spark, path, found.names).withColumn("_file", F.col("_metadata.file_name")).withColumn("_reasons", _reasons(found, required))
    good = raw.where(F.size("_reasons") == 0).select(*(_cast(_value(n), k).alias(n) for n, k in zip(found.names, found.types, strict=True)))
    line = F.coalesce(CORRUPT, F.array_join(F.array(*(F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in found.names)), ","))
    bad = raw.where(F.size("_reasons") > 0).select(F.col("_file").alias("file"), line.alias("line"), F.col("_reasons").alias("reasons"))
    return good, bad


def problems(quarantine: DataFrame) -> DataFrame:
    """``reason, n_lines`` of a quarantine; a line counts under each of its reasons."""
    return quarantine.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_lines"))
