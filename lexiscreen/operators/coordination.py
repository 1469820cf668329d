"""The case that a German noun takes from what stands before it, through chains of coordinated nouns.

A pair of articles, `des`, or `den` before a plural says the case.  Behind a conjunction a noun has the case of the noun
it is joined to, and so on down the chain: labels travel along the edges noun, conjunction, noun.  As every noun has one
edge at most, and it leads two words back, a chain is an island in the words of one parity, and its first word's label
is everyone's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gender, inklusivum
from ..packs import fixed, lexicon, literal
from .tokens import tokens

CONJUNCTIONS = ("und", "oder", "sowie", "bzw.", "&")


def target_cell(case: Column, plural: Column) -> Column:
    """The inclusive declension marks the dative plural and the genitive singular only."""
    return F.when(case.isNotNull(), F.when(plural, F.when(case == "dativ", "pl_dat").otherwise("pl_nom")).otherwise(F.when(case == "genitiv", "sg_gen").otherwise("sg_nom")))


def cases(texts: DataFrame, morphology: DataFrame | None = None) -> DataFrame:
    """(doc_id, i, tok, is_plural, grammatical_case, target) of every gendered form and noun of the lexicon.

    Words are what blanks separate, so that a form like `Lehrer(innen)` is one.  ``morphology`` (doc_id, i,
    morph_case) is asked where nothing before the noun says its case."""
    spark = texts.sparkSession
    words = tokens(texts.filter("lang = 'de'"), words_only=True, prev=1)
    words = words.withColumn("core", F.regexp_replace("tok", "[.,;!?»“”\"]+$", ""))
    words = words.withColumn("before", F.regexp_extract(F.try_element_at("prev", F.lit(-1)), r"^\S*", 0))
    words = words.withColumn("_low", F.lower("before"))
    pair = F.array_join(F.array_sort(F.array(F.lower(gender.split_form(F.col("before"), 1)), F.lower(gender.split_form(F.col("before"), 2)))), "~")
    articles = literal.frame(spark, "form, masculine, feminine, neuter, plural, pair, inclusive", fixed.article_rows())
    known = inklusivum.article_pairs(articles).select("pair_key", "grammatical_case")
    words = words.withColumn("pair_key", pair).join(known, "pair_key", "left")
    is_edge = F.coalesce(F.col("_low").isin(*CONJUNCTIONS), F.lit(False)) & (F.col("i") >= 2)
    label = F.coalesce("grammatical_case", F.when(F.col("_low") == "des", "genitiv"))
    words = words.withColumn("_edge", is_edge).withColumn("_label", label).withColumn("_den", F.col("_low") == "den")
    parity = Window.partitionBy("doc_id", F.col("i") % 2).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("_chain", F.sum(F.when(F.col("_edge"), 0).otherwise(1)).over(parity))
    chain = Window.partitionBy("doc_id", F.col("i") % 2, "_chain").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("_first", F.first(F.struct("_label", "_den")).over(chain))
    nouns = literal.frame(spark, "_form, _plural", plural_rows())
    rows = words.withColumn("_form", F.lower("core")).join(nouns, "_form", "left")
    gendered = gender.form_format(F.col("core"))
    plural = F.when(gendered.isNotNull(), gender.form_part(F.col("core"), 2).rlike("(?i)nen$")).otherwise(F.col("_plural"))
    rows = rows.withColumn("is_plural", plural).filter("is_plural IS NOT NULL")
    found = F.coalesce("_first._label", F.when(F.col("_first._den") & F.col("is_plural"), "dativ"))
    if morphology is not None:
        rows = rows.join(morphology, ["doc_id", "i"], "left")
        found = F.coalesce(found, "morph_case")
    rows = rows.withColumn("grammatical_case", found)
    return rows.select("doc_id", "i", F.col("core").alias("tok"), "is_plural", "grammatical_case", target_cell(F.col("grammatical_case"), F.col("is_plural")).alias("target"))


def plural_rows() -> list[tuple[str, bool]]:
    """(form in lower case, whether it is read as a plural): a form other than the base that some plural cell has."""
    rows: dict[str, bool] = {}
    for base, _, _, _, cell, form in lexicon.german_noun_rows():
        rows[form.lower()] = rows.get(form.lower(), False) or (cell.startswith("pl") and form != base)
    bases = {base.lower() for base, *_ in lexicon.GERMAN_NOUNS}
    return sorted((form, plural and form not in bases) for form, plural in rows.items())
