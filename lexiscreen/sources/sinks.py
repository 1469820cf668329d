"""Shapes findings are written in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import snippets


def as_json(findings: DataFrame, *columns: str) -> DataFrame:
    """One JSON object per finding without NULL fields."""
    return findings.select("doc_id", F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("json"))


def as_matches(findings: DataFrame, texts: DataFrame, radius: int = 40) -> DataFrame:
    """The match schema of spell-check clients: message from explanation, label
    or subcategory; replacements with "" for a removal; context around."""
    values = F.transform("alternatives", lambda a: F.when(a["is_remove"], "").otherwise(a["alt"]))
    return snippets(texts, findings, radius).select(
        "doc_id",
        F.coalesce("explanation", "label_en", "subcategory").alias("message"),
        F.col("start").alias("offset"),
        F.length("text").alias("length"),
        F.array_join(values, "|").alias("replacements"),
        "context",
        F.concat(F.lit("SCREEN_"), F.upper("subcategory")).alias("rule_id"),
        F.when(F.col("category") == "orthography", "misspelling").otherwise("style").alias("issue_type"),
    )


def as_report(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """One readable report per text: a header, then a line per finding."""
    line = F.concat(F.col("text"), F.lit(" ("), F.col("category"), F.lit(", "), F.coalesce("proficiency_level", F.lit("-")), F.lit(")"))
    listed = findings.select("doc_id", "start", line.alias("line")).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "line"))).alias("l")
    )
    body = F.array_join(F.transform("l", lambda s, k: F.concat(F.lit("#"), k + 1, F.lit(" "), s["line"])), "\n")
    rows = texts.select("doc_id", "lang").join(listed, "doc_id", "left")
    count = F.coalesce(F.size("l"), F.lit(0))
    header = F.concat(F.lit("Language: "), F.col("lang"), F.lit(", issues: "), F.greatest(count, F.lit(0)))
    return rows.select("doc_id", F.concat_ws("\n", header, body).alias("report"))


def write_by_language(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").partitionBy("lang").parquet(path)
