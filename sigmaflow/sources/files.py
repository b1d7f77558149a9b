"""File sources and sinks: raw price CSV and intermediate parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.config import Params
from sigmaflow.functions.columns import epoch_to_ts, ntz_lit, ts_to_epoch

# Raw price file layout: epoch seconds and a weighted price (plus our series key).
RAW_PRICE_SCHEMA = T.StructType([
    T.StructField("series", T.StringType(), True),
    T.StructField("Timestamp", T.LongType(), True),
    T.StructField("Weighted_Price", T.DoubleType(), True),
])


def write_raw_prices_csv(prices: DataFrame, path: str) -> None:
    """Write prices in the raw layout (``Timestamp`` epoch seconds, ``Weighted_Price``)."""
    (prices.select("series", ts_to_epoch("date").alias("Timestamp"),
                   F.col("adjusted").alias("Weighted_Price"))
     .write.mode("errorifexists").option("header", True).csv(path))


def read_raw_prices_csv(spark: SparkSession, path: str, params: Params | None = None) -> DataFrame:
    """Scan a raw price CSV with a fixed schema, then project and range-filter it.

    ``Timestamp`` becomes a naive timestamp ``date``, ``Weighted_Price`` becomes
    ``adjusted``; all other columns are dropped.
    """
    raw = spark.read.schema(RAW_PRICE_SCHEMA).option("header", True).csv(path)
    out = raw.select("series", epoch_to_ts("Timestamp").alias("date"),
                     F.col("Weighted_Price").alias("adjusted"))
    if params is not None:
        out = out.where(F.col("date").between(ntz_lit(params.utc(params.start)), ntz_lit(params.utc(params.end))))
    return out


# Cleaned price file layout: a naive timestamp and a price (plus our series key).
CLEANED_PRICE_SCHEMA = T.StructType([
    T.StructField("series", T.StringType(), True),
    T.StructField("date", T.TimestampNTZType(), True),
    T.StructField("adjusted", T.DoubleType(), True),
])
CLEANED_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def write_cleaned_prices_csv(prices: DataFrame, path: str) -> None:
    """Write cleaned prices as ``date, adjusted``; fractions of a second are kept."""
    (prices.select("series", "date", "adjusted").write.mode("errorifexists").option("header", True)
     .option("timestampNTZFormat", CLEANED_TIMESTAMP).csv(path))


def read_cleaned_prices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan a cleaned price CSV with a fixed schema."""
    return (spark.read.schema(CLEANED_PRICE_SCHEMA).option("header", True)
            .option("timestampNTZFormat", CLEANED_TIMESTAMP).csv(path))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("series",)) -> None:
    """Persist an intermediate result as parquet, partitioned for later pruning."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_sorted(df: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> None:
    """Write files in one total order: ranges of the key, each sorted, and file names that follow the ranges.

    Rows of equal keys may be in any order, but stay in one range.
    """
    spark = df.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def read_sorted(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """The rows of a sorted table with ``position`` = 1, 2, ...: the row's place in its file after all rows of earlier files."""
    from pyspark.sql import Window
    rows = spark.read.parquet(path).withColumns({"_file": F.col("_metadata.file_name"), "_place": F.col("_metadata.row_index")})
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))  # one row a file
    before = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_file").withColumn(position, F.col("_before") + F.col("_place") + 1).drop("_file", "_place", "_before")
