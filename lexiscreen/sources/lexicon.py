"""Rule tables and lexicons from files, and the job that builds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the rule files a run used."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; an empty field is an empty string, not NULL."""
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.fillna("", subset=[f.name for f in rows.schema if f.dataType.simpleString() == "string"])


def load_taxonomy(spark: SparkSession, categories: str, drivers: str) -> DataFrame:
    """Two JSON maps as one table; a key of the second wins."""
    read = lambda path: (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", "map<string,struct<category:string,proficiency_level:string>>")).alias("key", "v"))
    )
    a, b = read(categories), read(drivers)
    return a.alias("a").join(b.alias("b"), "key", "full").select("key", F.coalesce("b.v", "a.v").alias("v")).select("key", "v.*")


def forms(declensions: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    """Wide declension rows as (keys, form_name, form)."""
    return declensions.unpivot(keys, cells, "form_name", "form").filter("form IS NOT NULL AND form <> ''")


def active(rules: DataFrame, alternatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active rules without helper columns, and the alternatives that still
    have a rule."""
    kept = rules.filter("is_active").drop("is_active", "notes")
    return kept, alternatives.join(kept.select("rule_id"), "rule_id", "left_semi")


def build(rules: DataFrame, alternatives: DataFrame, path: str) -> None:
    """Write the pruned pack as parquet, rules by language."""
    kept, alts = active(rules, alternatives)
    kept.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/rules")
    alts.write.mode("overwrite").parquet(f"{path}/alternatives")
