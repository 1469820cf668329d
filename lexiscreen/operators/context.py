"""A learned check of the sentence around a context-dependent finding."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sweep
from .tokens import sentences


#: Parts that findings without a sentence are dealt to.
DEALS = 1 << 16


def train(texts: DataFrame, labels: DataFrame, label: str = "toxic"):
    """A linear model on hashed words."""
    rows = texts.join(labels, "doc_id").select("text", F.col(label).cast("double").alias("label"))
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+"),
        HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 12),
        LogisticRegression(maxIter=10, regParam=0.05),
    ]
    return Pipeline(stages=stages).fit(rows)


def without_harmless(findings: DataFrame, model, least: float = 0.5) -> DataFrame:
    """Drop findings whose ``sentence`` the model scores below ``least``.  Each
    distinct sentence is scored once; without a model all findings stay."""
    if model is None:
        return findings
    distinct = findings.select("sentence").filter("sentence IS NOT NULL").distinct()
    scored = model.transform(distinct.withColumnRenamed("sentence", "text"))
    harmless = scored.filter(vector_to_array("probability")[1] < least).select(F.col("text").alias("sentence"), F.lit(0).alias("_deal"))
    # Findings that ask nothing have no sentence: they are dealt out, as a join would send them all to one task.
    own = F.xxhash64(F.lit(0), *[F.col(c) for c in findings.columns if c != "sentence"])
    deal = F.when(F.col("sentence").isNull(), F.pmod(own, F.lit(DEALS))).otherwise(0).cast("int")
    return findings.withColumn("_deal", deal).join(harmless, ["sentence", "_deal"], "left_anti").drop("_deal")


def cleared(findings: DataFrame, texts: DataFrame, model, rule_ids: tuple[int, ...], least: float = 0.5) -> DataFrame:
    """Drop findings of the named rules in sentences that the model clears.  A finding's sentence is the last one that begins
    at or before it; other findings ask nothing and stay."""
    cut = sentences(texts).select("doc_id", "start", "end", "sentence")
    placed = sweep.last_starting(findings, cut, "_in")
    asked = placed.withColumn("sentence", F.when(F.col("rule_id").isin(*rule_ids), F.col("_in.sentence"))).drop("_in")
    return without_harmless(asked, model, least).drop("sentence")
