"""Categories: which subcategory a rule is reported under, and how severe it is.
All of it is computed once per rule, not once per match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..packs import literal


def base_key(key: Column) -> Column:
    return F.regexp_replace(key, "_advanced$", "")


def enabled_subcategory(rules: DataFrame, taxonomy: DataFrame, disabled: list[str]) -> DataFrame:
    """Per rule the first subcategory that is not disabled, exists and whose
    parent is not disabled; rules without one are dropped."""
    off = F.array(*[F.lit(d) for d in disabled]).cast("array<string>")
    listed = rules.select("rule_id", F.posexplode(F.split("subcategories", r"\|")).alias("pos", "subcategory"))
    known = taxonomy.select(F.col("key").alias("_key"), "parent")
    ok = (
        listed.withColumn("_key", base_key(F.col("subcategory")))
        .join(known, "_key")
        .filter(~F.array_contains(off, F.col("subcategory")))
        .filter(F.coalesce(~F.array_contains(off, F.col("parent")), F.lit(True)))
    )
    return ok.groupBy("rule_id").agg(F.min_by("subcategory", "pos").alias("subcategory"))


def severity(taxonomy: DataFrame, levels: DataFrame) -> DataFrame:
    """Proficiency level and gravity for every key and its advanced variant."""
    keys = taxonomy.select("*", F.explode(F.array(F.lit(""), F.lit("_advanced"))).alias("_adv"))
    keys = keys.withColumn("subcategory", F.concat("key", "_adv")).join(levels, "level", "left")
    level = (
        F.when(F.col("level").isNull(), F.when(F.col("parent") == "orthography", F.lit("orthography")))
        .when(F.col("level") == "openly_discriminating", F.col("level"))
        .when(F.col("inclusive"), "inclusive")
        .otherwise("unconscious_bias")
    )
    gravity = (
        F.when(F.col("subcategory") == "corporate_rules", 0.9)
        .when(F.col("inclusive"), None)
        .when(F.col("proficiency_level").isNull(), 2.0)
        .when(F.col("proficiency_level").isin("orthography", "openly_discriminating"), 1.0)
        .when(F.col("_adv") != "", 3.0)
        .otherwise(2.0)
    )
    out = keys.withColumn("proficiency_level", level).withColumn("gravity", gravity)
    category = F.coalesce("parent", "key").alias("category")
    return out.select("subcategory", category, "proficiency_level", "gravity", "icon", "label_en", "label_de")
