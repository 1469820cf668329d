"""Documents to training shards: STAGES in order, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscreen.llm import decontaminate, mix, shard, signature_tree, toxicity
from lexiscreen.llm.common import fresh, saved, table


def ordinary(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity models accept.  Null and empty texts are scored as empty text and stay; rows are judged
    one by one, repeated ones alike; without labels all stay."""
    score = toxicity.learn(docs, table(spark, folder, "labels"))
    return docs.filter(score(docs["text"]) < toxicity.THRESHOLD)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near copies, repeated rows included: five words, similarity 0.8 or more.

    The smallest id stays, a null id only if no other is there; null texts and texts without words all stay.  An empty
    table stays empty."""
    return signature_tree.one_of_each(docs, 5, 80, 100)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a word inside any window of a benchmark item.  Null and empty texts have none and stay; repeated
    rows are judged alike; an empty benchmark takes nothing out."""
    name = fresh(docs, "found")
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark"), name)
    return found.filter(F.col(f"{name}.n_hit") == 0).drop(name)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them.  Rows of one id, and all rows without id, go together; a null source is a
    source of its own; a source without a word is not taken."""
    return mix.remix(docs)


def sharded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with their shard of 40.  The id alone decides, so repeated rows and all rows without id share a shard."""
    return docs.withColumn("shard", shard.rendezvous(F.col("doc_id"), [1.0] * 40))


STAGES = [
    ("toxicity", ordinary),
    ("near-duplicates", one_of_each),
    ("decontaminate", clean_of_benchmark),
    ("mix", mixed),
    ("shard", sharded),
]

#: Language models and similarity joins are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs
