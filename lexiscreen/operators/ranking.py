"""Which of several matches wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def rule_order() -> list:
    """Order of rules at one token: multi-word rules by length, then by word
    type, length and exactness; ties by id."""
    return [
        F.when(F.col("n_words") > 1, F.length("words")).otherwise(0).desc(),
        F.col("rule_word_type").desc(),
        F.length("words").desc(),
        F.col("lemmatize").asc(),
        F.col("rule_id").asc(),
    ]


def best_rule(matches: DataFrame, stage: str = "stage") -> DataFrame:
    """The first match of a token in stage order, then rule order."""
    order = Window.partitionBy("doc_id", "i").orderBy(F.col(stage), *rule_order())
    return matches.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


#: Chains whose rows are put into one list.
CHAINS = 512


def non_overlapping(matches: DataFrame) -> DataFrame:
    """Left to right: a match at token i moves the scan to its ``skip``.  Matches
    that do not touch are settled by a running maximum, and so is what begins inside the first match of a chain of touching
    ones; only the rest of such a chain is folded.  Rows are gathered by ``CHAINS`` chains, as a list for each match costs more
    than the match."""
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.when(F.col("i") < F.max("skip").over(before), 0).otherwise(1)
    columns = [c for c in matches.columns if c not in ("doc_id", "i", "skip")]
    row = F.struct("i", "skip", *columns)
    open_ = F.last(F.when(F.col("_fresh") == 1, F.col("skip")), ignorenulls=True).over(upto)
    placed = matches.withColumn("_fresh", fresh).withColumns({"_chain": F.sum("_fresh").over(upto), "_open": open_})
    left = (F.col("_fresh") == 0) & (F.col("i") >= F.col("_open"))
    blocks = (
        placed.filter((F.col("_fresh") == 1) | left)
        .groupBy("doc_id", F.expr(f"_chain div {CHAINS}").alias("_block"))
        .agg(F.collect_list(F.when(F.col("_fresh") == 1, row)).alias("rows"), F.array_sort(F.collect_list(F.when(left, row))).alias("rest"))
    )
    kept = F.aggregate(
        F.slice("rest", F.lit(2), F.size("rest")),
        F.slice("rest", 1, 1),
        lambda acc, m: F.when(m["i"] >= F.element_at(acc, -1)["skip"], F.array_append(acc, m)).otherwise(acc),
    )
    kept = F.when(F.size("rest") > 1, kept).otherwise(F.col("rest"))
    return blocks.select("doc_id", F.inline(F.concat("rows", kept))).select(*matches.columns)
