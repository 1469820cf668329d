"""Annotated treebank files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(blocks: DataFrame, key: str = "sent", block: str = "block") -> DataFrame:
    """Sentence blocks to (key, sentence, n, form, upos).  The parts of a
    multiword range are dropped and the range keeps its surface without a
    reading; empty nodes are skipped.  All inside the row of a sentence."""
    lines = F.split(block, "\n")
    text = F.regexp_extract(block, r"(?m)^# text = (.*)$", 1)
    cells = F.transform(F.filter(lines, lambda x: x.rlike(r"^[0-9]+(-[0-9]+)?\t")), lambda x: F.split(x, "\t"))
    ranges = F.transform(
        F.filter("_cells", lambda c: c[0].contains("-")),
        lambda c: F.struct(
            F.substring_index(c[0], "-", 1).cast("int").alias("a"), F.substring_index(c[0], "-", -1).cast("int").alias("b")
        ),
    )
    inside = lambda c: F.exists("_ranges", lambda r: c[0].cast("int").between(r["a"], r["b"]))
    kept = F.filter("_cells", lambda c: c[0].contains("-") | ~inside(c))
    rows = blocks.select(key, text.alias("sentence"), cells.alias("_cells")).withColumn("_ranges", ranges)
    each = rows.select(key, "sentence", F.posexplode_outer(kept).alias("n", "c")).filter("c IS NOT NULL AND sentence <> ''")
    gold = F.when(~F.col("c")[0].contains("-"), F.col("c")[3])
    return each.select(key, "sentence", "n", F.col("c")[1].alias("form"), gold.alias("upos"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of a treebank; the reader splits at blank lines, so a sentence is a
    row and a file of any size is read by many tasks."""
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    # Blank lines of files with carriage returns are cut here; every block has a number of its own, equal ones too.
    block = F.explode(F.split("value", "\r\n(?:\r\n)+")).alias("block")
    return parse(blocks.select(block).select(F.monotonically_increasing_id().alias("sent"), F.replace("block", F.lit("\r"), F.lit("")).alias("block")))
