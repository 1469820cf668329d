"""Suggestions: chosen once per rule and number, joined to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suggestion_table(rules: DataFrame, alternatives: DataFrame, show_inspirations: bool = False) -> DataFrame:
    """(rule_id, number, alternatives): the alternatives of the rule or its
    parent, in the best non-empty tier: strict, then with inspirations, then
    regardless of number.  `number` is singular, plural or unknown."""
    number = F.explode(F.array(F.lit("singular"), F.lit("plural"), F.lit("unknown"))).alias("number")
    asked = rules.select("rule_id", F.coalesce("parent_id", "rule_id").alias("_from"), number)
    rows = alternatives.withColumnRenamed("rule_id", "_from")
    wrong = ((F.col("number") == "singular") & (F.col("pluralization") == "plural_only")) | (
        (F.col("number") == "plural") & (F.col("pluralization") == "singular_only")
    )
    hidden = (F.col("is_inspiration") | F.col("is_placeholder")) if not show_inspirations else F.lit(False)
    tier = F.when(~wrong & ~hidden, 1).when(~wrong, 2).otherwise(3)
    entry = F.struct("ord", "alt", "is_remove", "is_inspiration", "label")
    tiers = asked.join(rows, "_from").withColumn("tier", tier)
    # Tier 2 includes tier 1's rows and tier 3 all: but a tier is only used when
    # the stricter ones are empty, so the rows of the smallest tier are the answer.
    best = tiers.groupBy("rule_id", "number", "tier").agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    best = best.groupBy("rule_id", "number").agg(F.min_by("_rows", "tier").alias("_rows"))
    shown = F.filter("_rows", lambda a: ~F.coalesce(a["alt"].contains("^"), F.lit(False)))
    return best.select("rule_id", "number", shown.alias("alternatives"))


def clean(alternatives: Column, text: Column, most: int) -> Column:
    """One entry per text, the last value at the first position, none equal to
    the finding's own text, at most ``most``.  Lists are a handful of entries."""
    return F.slice(_latest(F.filter(alternatives, lambda a: a["is_remove"] | ~a["alt"].eqNullSafe(text))), 1, most)


def _latest(usable: Column) -> Column:
    keys = F.array_distinct(F.transform(usable, lambda a: F.coalesce(a["alt"], F.lit(""))))
    return F.transform(
        keys, lambda k: F.element_at(F.filter(usable, lambda a: F.coalesce(a["alt"], F.lit("")) == k), -1)
    )


_ENTRIES = "array<struct<ord:int,alt:string,is_remove:boolean,is_inspiration:boolean,label:string>>"


def attached(found: DataFrame, suggested: DataFrame, most: int) -> DataFrame:
    """``found`` with its ``alternatives``, cleaned.  A list is cleaned once for its rule and number; again only for a finding
    whose own text is in it."""
    ready = suggested.select("*", _latest(F.col("alternatives")).alias("_ready"), F.transform("alternatives", lambda a: a["alt"]).alias("_alts"))
    joined = found.join(ready, ["rule_id", "number"], "left")
    own = F.coalesce(F.array_contains("_alts", F.col("text")), F.lit(False))
    listed = F.when(own, clean(F.col("alternatives"), F.col("text"), most)).otherwise(F.slice("_ready", 1, most))
    return joined.withColumn("alternatives", F.coalesce(listed, F.array().cast(_ENTRIES))).drop("_ready", "_alts")
