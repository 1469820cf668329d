"""Text sources: documents, pages and conversations as one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting: so many tasks for text work, whatever the source's size.  Unset, as on a cluster, a source is read
#: in the splits its files have, and no text is shuffled.
SCAN_TASKS = "lexiscreen.scan.tasks"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(texts: DataFrame) -> DataFrame:
    """The source in SCAN_TASKS tasks, if that is set: for files of one row group on one machine."""
    tasks = texts.sparkSession.conf.get(SCAN_TASKS, None)
    return texts.repartition(int(tasks)) if tasks else texts


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, lang) from the documents table."""
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """What the assistant wrote, one row per turn, keyed by ``doc_id``."""
    rows = table(spark, folder, "conversations").filter("role = 'assistant'")
    return spread(
        rows.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "conv_id", "turn", "text")
    )


def snippets(texts: DataFrame, spans: DataFrame, radius: int) -> DataFrame:
    """The columns of ``spans`` and ``context``: the text ``radius`` characters
    around each.  Spans are gathered per text first, so a text takes part in the
    join once and not once per span."""
    row = F.struct(*[c for c in spans.columns if c != "doc_id"])
    gathered = spans.groupBy("doc_id").agg(F.collect_list(row).alias("_spans"))
    joined = texts.select("doc_id", F.col("text").alias("_full")).join(gathered, "doc_id")
    left = lambda s: F.greatest(s["start"] - radius, F.lit(0))
    around = F.transform("_spans", lambda s: F.struct(
        s.alias("s"), F.substring("_full", left(s) + 1, s["end"] + radius - left(s)).alias("context")
    ))
    return joined.select("doc_id", F.inline_outer(around)).select("doc_id", "s.*", "context")
