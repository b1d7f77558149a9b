"""From raw documents to training shards: five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the sentence model scores 0.3 or more go.
2. jaccard: of each class of documents that are similar by five-word shingles (0.8 or more), the first stays.
3. decontamination: documents that hold a ten-word window of a benchmark item go.
4. mixing: documents are taken, once, twice or not at all, towards the sources' target weights.
5. order: token sequences get global slots by a keyed permutation and are written as fixed-stride shards.

All but the last return the columns of ``documents``. Nulls, empty texts, repeated rows and
further columns are treated as the operators' docstrings say; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigmaflow.llm.decontaminate import decontaminate
from sigmaflow.llm.jaccard import drop_similar
from sigmaflow.llm.kit import prepare, stage, table
from sigmaflow.llm.mixing import mixed
from sigmaflow.llm.order import digests, write_shards
from sigmaflow.llm.toxicity import drop_toxic
from sigmaflow.session import scratch_path


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3; the model learns from the labels of documents outside the held-out fold."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class; texts without words stay."""
    return drop_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def write_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Slots of all sequences, read back from the written shards."""
    prepare(spark)
    return digests(write_shards(docs, scratch_path(spark, "pipeline-shards")))


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("order", write_training_order),
]

#: SQL can't express the first stage's fitted model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
