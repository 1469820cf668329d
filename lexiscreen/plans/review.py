"""Verdict on a text: parts, screening, counts, limits, message."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as w
from ..operators import guardrail
from ..packs import fixed, literal
from ..session import checkpoint_dir
from . import check

LIMIT_COLUMNS = "level, max_count, max_ratio, ord"
#: The default: fail at the first finding that has an alternative.
DEFAULT_LIMITS = [("overall", 1, None, 0)]


def limits(spark, rows=None) -> DataFrame:
    frame = literal.frame(spark, LIMIT_COLUMNS, rows or DEFAULT_LIMITS)
    return frame.withColumn("max_count", F.col("max_count").cast("int")).withColumn("max_ratio", F.col("max_ratio").cast("double"))


def parted(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, part_no, part, lang, text, shift): parts are rows, so one long text is screened by many tasks.

    ``part`` is a struct of text and part number; a part without a language is in the one its frequent words say."""
    cut = guardrail.parts(texts, size).withColumn("part", F.struct("doc_id", "part_no"))
    # Unfolded from a list of one, so that what asks for a language does not tell it again.
    cut = cut.withColumn("_lang", F.explode(F.array(F.coalesce("lang", w.stopword_language(F.col("text"))))))
    return cut.select("doc_id", "part_no", "part", F.col("_lang").alias("lang"), "text", F.col("part_start").alias("shift"))


#: A character of two UTF-16 units.
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def places(texts: DataFrame, size: int) -> DataFrame:
    """(part, _text, shift, shift16): what a finding's offsets move by, in code points and in UTF-16 units.  The text goes along only
    where code points and units differ inside the part."""
    cut = guardrail.parts(texts, size, keep=("doc_id",))
    narrow = cut.select(
        "doc_id", "part_no", F.col("part_start").alias("shift"), w.utf16_length(F.col("text")).alias("_units"),
        F.when(F.col("text").rlike(ASTRAL), F.col("text")).alias("_text"),
    )
    before = Window.partitionBy("doc_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    shift16 = F.coalesce(F.sum("_units").over(before), F.lit(0)).cast("int")
    return narrow.select(F.struct("doc_id", "part_no").alias("part"), "_text", "shift", shift16.alias("shift16"))


def _written(rows: DataFrame, spark, name: str) -> DataFrame:
    """``rows`` from the checkpoint folder, so that all who read them share one run."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def findings(texts: DataFrame, spark, size: int) -> tuple[DataFrame, DataFrame]:
    """Parts, and their findings with ``start`` and ``end`` in the whole text and ``start16`` and ``end16`` in its UTF-16 units."""
    cut = parted(texts, size)
    found = check.findings(
        cut.select(F.col("part").alias("doc_id"), "lang", "text"), spark, disabled=list(fixed.INCLUSIVE_CATEGORIES)
    ).withColumnRenamed("doc_id", "part")
    wide = lambda at: F.coalesce(F.regexp_count(F.substring("_text", F.lit(1), at), F.lit(ASTRAL)), F.lit(0))
    units = lambda at: F.col("shift16") + at + wide(at)
    placed = found.join(places(texts, size), "part").withColumns({"start16": units(F.col("start")), "end16": units(F.col("end"))})
    placed = placed.withColumns({"start": F.col("start") + F.col("shift"), "end": F.col("end") + F.col("shift")})
    return cut, placed.withColumn("doc_id", F.col("part.doc_id")).drop("part", "_text", "shift", "shift16")


def review(texts: DataFrame, spark, size: int = 1000, limit_rows=None) -> DataFrame:
    """(doc_id, language, words, verdict, failed_on, found, reask).

    Parts whose language is not told or not supported are not checked, and their words do not count; a text without any
    other passes, with no language.  ``found`` are the findings as (start16, end16, text, subcategory); ``reask`` is the
    message to the model, for texts that fail."""
    cut, found = findings(texts, spark, size)
    # Counts, places and messages, and verdicts, languages and numbers of words, come from one run of the check each.
    used = ("doc_id", "start", "start16", "end16", "text", "category", "subcategory", "gravity", "alternatives", "explanation")
    found = _written(found.select(*used), spark, "findings")
    counts = guardrail.level_counts(found)
    asked = cut.filter(F.col("lang").isin(*check.SUPPORTED))
    words = asked.groupBy("doc_id").agg(F.sum(w.word_count(F.col("text"))).alias("words"), F.min_by("lang", "part_no").alias("language"))
    words = _written(words, spark, "words")
    judged = guardrail.verdicts(words.select("doc_id", "words"), counts, limits(spark, limit_rows))
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start16", "end16", "text", "subcategory"))).alias("found"))
    issues = guardrail.quoted(found, min_changes=0).select("doc_id", "issues")
    rows = texts.select("doc_id", "text").join(words.select("doc_id", "language"), "doc_id", "left").join(judged, "doc_id", "left")
    rows = rows.join(listed, "doc_id", "left").join(issues, "doc_id", "left")
    failed = F.col("failed_on").isNotNull()
    return rows.select(
        "doc_id", "language", F.coalesce("words", F.lit(0)).alias("words"), F.when(failed, "fail").otherwise("pass").alias("verdict"),
        "failed_on", "found", F.when(failed, guardrail.reask(F.col("text"), F.col("issues"))).alias("reask"),
    )


def notes(texts: DataFrame, spark, explain: bool = False) -> DataFrame:
    """(doc_id, note) of texts with findings that have alternatives; texts without a language are in that of their
    frequent words."""
    lang = w.stopword_language(F.col("text"))
    texts = texts.withColumn("lang", F.coalesce("lang", lang) if "lang" in texts.columns else lang)
    return guardrail.note(check.findings(texts, spark), explain)
