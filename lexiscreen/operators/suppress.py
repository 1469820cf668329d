"""False positives: window, interval and equality anti-joins.  Spans meet spans
in one ordered pass per text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import once
from . import sweep


def window_text(ignore_case: bool = True) -> tuple[Column, Column, Column]:
    """The text of five tokens on either side, and where the token lies in it."""
    left = F.array_join(F.slice("prev", F.greatest(F.size("prev") - 4, F.lit(1)), F.lit(5)), "")
    right = F.array_join(F.slice("next", 1, 5), "")
    whole = F.concat(left, F.col("tok"), F.col("ws"), right)
    start = F.length(left)
    return (F.lower(whole) if ignore_case else whole), start, start + F.length("tok")


def without_false_positives(matches: DataFrame, false_positives: DataFrame) -> DataFrame:
    """Drop a match when one of its rule's false-positive phrases occurs within
    five tokens and covers the token."""
    phrases = false_positives.groupBy("rule_id").agg(F.collect_set(F.lower("false_positive")).alias("phrases"))
    whole, start, end = window_text()
    joined = matches.join(phrases, "rule_id", "left")

    # An occurrence covers the token when it starts in the stretch that ends at
    # the token's start and is at least one phrase long.
    def covers(place, phrase):
        first = F.greatest(place["end"] - F.length(phrase), F.lit(0))
        return F.substring(place["whole"], first + 1, place["start"] - first + F.length(phrase)).contains(phrase)

    place = F.struct(whole.alias("whole"), start.alias("start"), end.alias("end"))
    covered = once(place, lambda p: F.exists("phrases", lambda phrase: covers(p, phrase)))
    return joined.filter(F.col("phrases").isNull() | ~covered).drop("phrases")


#: Phrases in which a word has another meaning: master of a subject, lead on or a life, let alone, of a kind, quick call.
_WORD = r"\p{L}+"
PHRASES = "|".join(
    (
        rf"masters? of {_WORD}",
        rf"(?:leads?|leading|led) (?:{_WORD} )?(?:on|down|up|to|away|back|along|with|off|by|in|nowhere)\b",
        rf"(?:leads?|leading|led) (?:{_WORD} ){{0,2}}life\b",
        r"(?:let|lets|letting) alone\b",
        rf"of (?:{_WORD} )?kind\b",
        r"quick (?:calls?|checks?|exits?|meetings?)\b",
    )
)
#: What stands in every such phrase: one of these, in any case.
SIGNS = ("master", "lead", "led ", "alone", "kind", "quick ")
#: Tokens of the longest such phrase before its last one.
REACH = 4


def in_phrase() -> Column:
    """Whether an English match begins inside a phrase with another meaning, unless the phrase is the rule's own text."""
    hit = F.lit(False)
    lead_of = lambda k: F.array_join(F.slice("prev", F.greatest(F.size("prev") - k + 1, F.lit(1)), F.lit(k)), "")
    rest = F.concat("tok", "ws", F.array_join("next", ""))
    for k in range(REACH + 1):
        lead = lead_of(k) if k else F.lit("")
        said = F.lower(F.regexp_extract(F.concat(lead, rest), f"(?i)^(?:{PHRASES})", 0))
        here = (F.length(said) > F.length(lead)) & (said != F.lower("words"))
        hit = hit | (here & (F.size("prev") >= k))
    # A phrase that begins at one of these places has its sign somewhere in the whole; few matches have one near.
    near = once(F.lower(F.concat(lead_of(REACH), rest)), lambda said: reduce(or_, [said.contains(sign) for sign in SIGNS]))
    return F.when((F.col("lang") == "en") & near, hit).otherwise(F.lit(False))


def without_overlaps(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Drop findings that overlap a span of the same document."""
    return sweep.touched(findings, spans, "_hit").filter("NOT _hit").drop("_hit")


def without_covered(spans: DataFrame, findings: DataFrame) -> DataFrame:
    """Drop spans that lie inside a finding of the same document."""
    return sweep.inside(spans, findings, "_hit").filter("NOT _hit").drop("_hit")


def without_ignored(findings: DataFrame, ignored: DataFrame, keys: tuple[str, ...] = ("text",)) -> DataFrame:
    """Drop findings whose text is on an ignore list, exactly as written."""
    return findings.join(ignored.select(*keys).distinct(), list(keys), "left_anti")
