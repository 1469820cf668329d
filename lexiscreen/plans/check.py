"""The full screening of a corpus: texts to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alternatives as alts
from ..operators import matching, ranking, suppress, taxonomy
from ..operators.tokens import tokens
from ..packs import rules as packs

SUPPORTED = ("en", "de", "fr")
#: Pieces before and after a token that the checks around a match look at.
BEFORE, AFTER = 5, 6


def window(rules: DataFrame) -> dict[str, int]:
    """The neighbours a token row carries: as many as the longest rule of the pack needs."""
    longest = rules.agg(F.max(F.size(matching.rule_words()))).first()[0] or 1
    return dict(prev=BEFORE, next=max(AFTER, longest - 1))


def matched(texts: DataFrame, rules: DataFrame, lemmas: DataFrame, addons=None) -> DataFrame:
    """Every verified rule match, before false positives and ranking."""
    asked = matching.asked_words(rules, lemmas, addons)
    words = tokens(texts.filter(F.col("lang").isin(*SUPPORTED)), **window(rules), only=asked)
    # Nearly every word is its own lemma: the pins and the pack are small, so
    # both joins run inside the scan's stage.
    annotated = matching.annotate(words, lemmas)
    pack = rules.withColumn("rule_word_type", F.col("word_type"))
    return matching.phrase_matches(matching.candidates(annotated, pack, addons))


def number_of(lang, tok, lemma, is_plural):
    """singular / plural / unknown from the pins, else by shape."""
    listed = ~(tok.endswith("e") & lemma.endswith("er"))
    return (
        F.when(listed & is_plural, "plural")
        .when(is_plural == F.lit(False), "singular")
        .when(tok.endswith("-"), "plural")
        .otherwise("unknown")
    )


def at_clause_start():
    """Whether the text before the token is empty or ends a clause within five
    blanks."""
    before = F.expr("right(array_join(prev, ''), 5)")
    return before.rlike(r"^ {0,5}$") | before.rlike(r"[.!?:,]\s{0,5}$")


def ranked(
    texts: DataFrame,
    spark,
    disabled: list[str] | None = None,
    addons: list[str] | None = None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """The first surviving rule of every token."""
    rules = packs.rules(spark) if rules is None else rules
    found = matched(texts, rules, packs.lemmas(spark), addons)
    found = found.filter(~((F.col("lang") == "de") & (F.col("lemma") == "aber") & at_clause_start()))
    found = found.join(taxonomy.enabled_subcategory(rules, packs.taxonomy(spark), disabled or []), "rule_id")
    number = number_of(F.col("lang"), F.col("tok"), F.col("lemma"), F.col("is_plural"))
    found = found.withColumn("number", number).filter(
        ~((F.col("pluralization") == "plural_only") & (F.col("number") == "singular"))
        & ~((F.col("pluralization") == "singular_only") & (F.col("number") == "plural"))
    )
    found = suppress.without_false_positives(found, packs.false_positives(spark))
    # From here on a match is a narrow row: the neighbourhood stays behind.
    slim = found.select(
        "doc_id", "lang", "i", "skip", "start", "end", "text", "rule_id", "subcategory", "number", "explanation",
        "stage", "n_words", "words", "rule_word_type", "lemmatize",
    )
    # Whatever follows looks at a text's matches together: dealt by text once, they stay where they are.
    return ranking.best_rule(slim.repartition("doc_id"))


def findings(
    texts: DataFrame,
    spark,
    disabled: list[str] | None = None,
    addons: list[str] | None = None,
    most: int = 5,
    ignored: DataFrame | None = None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """One row per finding: span, rule, category, severity and suggestions."""
    rules = packs.rules(spark) if rules is None else rules
    kept = ranking.non_overlapping(ranked(texts, spark, disabled, addons, rules))
    if ignored is not None:
        kept = suppress.without_ignored(kept, ignored)
    graded = kept.join(taxonomy.severity(packs.taxonomy(spark), packs.levels(spark)), "subcategory")
    suggested = alts.suggestion_table(rules, packs.alternatives(spark))
    return alts.attached(graded, suggested, most).drop("stage", "n_words", "words", "rule_word_type", "lemmatize")
