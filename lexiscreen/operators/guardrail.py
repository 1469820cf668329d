"""Verdicts: parts of an answer, levels of findings, limits, and the messages
built from what was found."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.words import word_count
from ..packs import fixed

_FLUSH = 10_000
LEVELS = ("overall", "corporate_rules", "openly_discriminating", "basic", "advanced")


def part_pattern(size: int) -> re.Pattern:
    """What a part looks like: all that is left if it fits; else the longest run beyond half the size that closes a
    sentence; else the longest run that closes a word; else ``size`` characters."""
    closed = r"(?:(?<=[.!?] )|(?<=\n))"
    return re.compile(rf"(?s).{{1,{size}}}\Z|.{{{size // 2 + 1},{size}}}{closed}|.{{1,{size}}}(?<= )|.{{1,{size}}}")


def parts(texts: DataFrame, size: int, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """One row per part: ``keep``, ``part_no``, ``part_start``, ``text``.  Where
    a part ends depends on the one before, so it is cut over Arrow batches, and
    written in bounded ones."""

    def run(batches):
        pattern = part_pattern(size)
        for batch in batches:
            found = (
                (row, no, m.start(), m[0])
                for row, text in enumerate(batch.column("_text").to_pylist())
                for no, m in enumerate(pattern.finditer(text or ""))
            )
            while rows := list(islice(found, _FLUSH)):
                row, no, start, part = zip(*rows)
                kept = [batch.column(c).take(pa.array(row)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(part, pa.string())],
                    names=[*keep, "part_no", "part_start", "text"],
                )

    schema = T.StructType(
        [texts.schema[c] for c in keep]
        + [T.StructField("part_no", T.IntegerType()), T.StructField("part_start", T.IntegerType()), T.StructField("text", T.StringType())]
    )
    return texts.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def level(category: Column, gravity: Column) -> Column:
    return (
        F.when(category == "corporate_rules", "corporate_rules")
        .when(gravity < 1.5, "openly_discriminating")
        .when(gravity <= 2.5, "basic")
        .when(gravity.isNotNull(), "advanced")
    )


def level_counts(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, level, found): findings with alternatives, overall and by level.
    One partial aggregation; nothing is collected per text."""
    usable = findings.filter(F.size("alternatives") > 0)
    each = F.array_compact(F.array(F.lit("overall"), level(F.col("category"), F.col("gravity"))))
    return usable.select(key, F.explode(each).alias("level")).groupBy(key, "level").agg(F.count("*").alias("found"))


def verdicts(words: DataFrame, counts: DataFrame, limits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, verdict, failed_on): a level fails at its count or at its ratio per
    word; a text without words cannot fail a ratio."""
    reached = (F.coalesce(F.col("found"), F.lit(0)) >= F.col("max_count")) | (
        (F.col("words") > 0) & (F.col("found") / F.col("words") >= F.col("max_ratio"))
    )
    failed = (
        words.join(counts, key)
        .join(limits, "level")
        .filter(F.coalesce(reached, F.lit(False)))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("ord", "level"))).alias("_f"))
        .select(key, F.array_join(F.transform("_f", lambda s: s["level"]), ",").alias("failed_on"))
    )
    joined = words.join(failed, key, "left")
    return joined.select(key, "words", F.when(F.col("failed_on").isNull(), "pass").otherwise("fail").alias("verdict"), "failed_on")


def quoted(findings: DataFrame, key: str = "doc_id", min_changes: int | None = None) -> DataFrame:
    """(key, changes, rephrase, issues): findings with suggestions as JSON, then
    those with an explanation only.  Bounded by the text the findings lie in.
    With ``min_changes`` only texts that have more suggestions than that."""
    has = F.size("alternatives") > 0
    listed = F.transform(
        "alternatives", lambda a: F.struct(F.when(~a["is_remove"], a["alt"]).alias("alt"), F.when(a["is_remove"], True).alias("remove"))
    )
    why = F.when(~has, F.col("explanation"))
    entry = F.to_json(F.struct(F.col("text").alias("issue"), listed.alias("alternatives"), why.alias("explanation")))
    rows = findings.select(key, "start", has.alias("has"), F.when(has | F.col("explanation").isNotNull(), entry).alias("item"))
    listed = rows.filter("item IS NOT NULL").groupBy(key).agg(
        F.count_if("has").alias("changes"),
        F.array_sort(F.collect_list(F.struct((~F.col("has")).alias("later"), "start", "item"))).alias("_items"),
    )
    items = F.array_join(F.transform("_items", lambda s: s["item"]), ",")
    kept = listed if min_changes is None else listed.filter(F.col("changes") > min_changes)
    return kept.select(key, "changes", F.concat(F.lit("["), items, F.lit("]")).alias("issues"))


def reask(text: Column, issues: Column) -> Column:
    """The message that asks a model to mend its answer."""
    before, between, after = re.split(r"\{text\}|\{issues\}", fixed.REASK)
    quoted_text = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    return F.concat(F.lit(before), quoted_text, F.lit(between), issues, F.lit(after))


def without_note(texts: DataFrame, notes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``texts`` (doc_id, text) whose last note, behind the mark, is just the one that the text before it gets: without
    it.  Any other text behind a mark is part of the answer.  ``notes`` gives (doc_id, note) of some texts; only texts
    with a mark are asked about."""
    at = F.length("text") - F.locate(fixed.NOTE_MARK[::-1], F.reverse(F.col("text"))) + 1 - len(fixed.NOTE_MARK)
    marked = texts.filter(F.col("text").contains(fixed.NOTE_MARK)).select("*", at.alias("_at"))
    parts = marked.select(*texts.columns, F.substring("text", F.lit(1), F.col("_at")).alias("_answer"), F.substring("text", F.col("_at") + len(fixed.NOTE_MARK) + 1, F.length("text")).alias("_note"))
    found = notes(parts.select(*[c for c in texts.columns if c != "text"], F.col("_answer").alias("text"))).select("doc_id", "note")
    own = parts.join(found, "doc_id").filter("note = _note").select("doc_id", "_answer")
    return texts.join(own, "doc_id", "left").withColumn("text", F.coalesce("_answer", "text")).drop("_answer")


def note_entry(explain: bool) -> Column:
    """One finding as it stands in a note."""
    names = F.array_join(
        F.transform(F.filter("alternatives", lambda a: ~a["is_remove"]), lambda a: a["alt"]), " / "
    )
    why = F.when(F.col("explanation").isNotNull(), F.concat(F.lit(" ("), F.col("explanation"), F.lit(")"))).otherwise("")
    return F.concat(F.lit('"'), F.col("text"), F.lit('" → '), names, why if explain else F.lit(""))


def note(findings: DataFrame, explain: bool, key: str = "doc_id") -> DataFrame:
    """(key, note): `"text" → a / b (why); …` in text order."""
    rows = findings.filter(F.size("alternatives") > 0).select(key, "start", note_entry(explain).alias("entry"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "entry"))).alias("_e"))
    return listed.select(key, F.array_join(F.transform("_e", lambda s: s["entry"]), "; ").alias("note"))


def outcomes(texts: DataFrame, findings: DataFrame, limits: DataFrame, block: Column) -> DataFrame:
    """(doc_id, text, note, verdict, blocked): counts and note from one pass over
    the findings, so they are screened once."""
    usable = findings.filter(F.size("alternatives") > 0)
    kind = level(F.col("category"), F.col("gravity"))
    counts = [F.count_if(kind == name).alias(name) for name in LEVELS[1:]]
    per_text = usable.groupBy("doc_id").agg(
        F.count("*").alias("overall"),
        *counts,
        F.array_sort(F.collect_list(F.struct("start", note_entry(False).alias("entry")))).alias("_e"),
    )
    # A row a level at most; a level without a limit never fails.
    bounds = {r["level"]: (r["max_count"], r["max_ratio"]) for r in limits.groupBy("level").agg(F.max("max_count").alias("max_count"), F.max("max_ratio").alias("max_ratio")).collect()}
    rows = texts.withColumn("_words", word_count(F.col("text"))).join(per_text, "doc_id", "left")
    failed = F.lit(False)
    for name, (count, ratio) in sorted(bounds.items()):
        if count is not None:
            failed = failed | F.coalesce(F.col(name) >= count, F.lit(False))
        if ratio is not None:
            failed = failed | F.coalesce((F.col("_words") > 0) & (F.col(name) / F.col("_words") >= ratio), F.lit(False))
    noted = F.when(F.col("_e").isNotNull(), F.array_join(F.transform("_e", lambda s: s["entry"]), "; "))
    return rows.select(
        "doc_id", "text", noted.alias("note"), F.when(failed, "fail").otherwise("pass").alias("verdict"), (failed & block).alias("blocked")
    )
