"""Sentences with `he` or `she` as `they`: the verbs that agree with it lose their ending.

`is` and `has` change as words.  Else the verb behind the pronoun loses its -s, and so does every further word in -s that a
conjunction or comma joins to it; the run has no fixed length.  Pairs (conjunction, word in -s) form islands in the words of one
parity; the length of the island that starts behind the pronoun or behind its verb is where the rewriting ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import drop_last
from ..packs import lexicon, literal
from . import annotate
from .tokens import tokens

PRONOUNS = ("he", "she")
WHOLE = {"is": "are", "has": "have"}


def third_person() -> list[tuple[str]]:
    return sorted({(form,) for _, cell, form in lexicon.english_verb_rows() if cell == "third_person_singular"})


def agreement(texts: DataFrame, words: DataFrame | None = None, pronouns: tuple[str, ...] = PRONOUNS) -> DataFrame:
    """(doc_id, i, start, text, suggestion) of every pronoun: the words that change, and what they become."""
    rows = annotate.typed(tokens(texts.filter("lang = 'en'"), prev=1), words)
    tok = F.col("tok")
    third = literal.frame(texts.sparkSession, "_form", third_person()).withColumn("_third", F.lit(True))
    rows = rows.withColumn("_form", F.lower("tok")).join(third, "_form", "left")
    # A word that is both, like `rests`, is a verb behind a pronoun.
    is_verb = F.coalesce(F.col("_third") | (F.col("word_type") == "v"), F.lit(False))
    rows = rows.select("doc_id", "i", "start", "tok", "ws", "word_type", is_verb.alias("_verb"))
    ahead = Window.partitionBy("doc_id").orderBy("i")
    back = Window.partitionBy("doc_id", F.col("i") % 2).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", tok.endswith("s")).withColumn("_conj", (tok == ",") | F.coalesce(F.col("word_type") == "conj", F.lit(False)))
    rows = rows.withColumn("_pair", F.col("_conj") & F.coalesce(F.lead("_s").over(ahead), F.lit(False)))
    # Pairs in a row, two words apart, counted from the back: an island's number is how many words that start none follow it.
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_pair"), 0).otherwise(1)).over(back))
    inside = Window.partitionBy("doc_id", F.col("i") % 2, "_island").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_pairs", F.sum(F.when(F.col("_pair"), 1).otherwise(0)).over(inside))
    verb = F.lead(F.col("_s") & F.col("_verb") & (tok != "was")).over(ahead)
    anchor = F.lower("tok").isin(*pronouns)
    next_word, pairs = F.lead("tok").over(ahead), lambda k: F.coalesce(F.lead("_pairs", k).over(ahead), F.lit(0))
    length = (
        F.when(next_word.isin(*WHOLE), 1)
        .when(F.coalesce(verb, F.lit(False)), 1 + 2 * pairs(2))
        .otherwise(2 * pairs(1))
    )
    rows = rows.withColumn("_anchor", F.when(anchor, F.struct("i", "start", length.alias("length"))))
    upto = ahead.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_of", F.last("_anchor", ignorenulls=True).over(upto)).filter(F.col("i") <= F.col("_of.i") + F.col("_of.length"))
    whole = F.create_map(*[F.lit(x) for kv in WHOLE.items() for x in kv])
    bare = F.when(tok.endswith("hes"), drop_last(tok, 2)).when(F.col("_s"), drop_last(tok, 1)).otherwise(tok)
    new = F.when(F.col("i") == F.col("_of.i"), "they").when(F.col("_of.length") == 1, F.coalesce(F.try_element_at(whole, tok), bare)).when(F.col("_conj"), tok).otherwise(bare)
    last = F.col("i") == F.col("_of.i") + F.col("_of.length")
    blank = F.when(last, "").otherwise(F.col("ws"))
    pieces = F.array_sort(F.collect_list(F.struct("i", F.concat("tok", blank).alias("old"), F.concat(new, blank).alias("new"))))
    done = rows.groupBy("doc_id", F.col("_of.i").alias("i"), F.col("_of.start").alias("start")).agg(pieces.alias("p"))
    return done.select("doc_id", "i", "start", F.array_join("p.old", "").alias("text"), F.array_join("p.new", "").alias("suggestion"))
