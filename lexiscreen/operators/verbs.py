"""Verbs in the form of the verb they replace.

A form that the verb tables know is a cell; the proposed verb is taken from the same cell.  What the tables do not know is
aligned as text: German `zu` and `ge` go between a loose prefix and its verb, and the matched word's ending is put on the
proposed verb's stem; an English ending names a tense, and the tense is formed by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import drop_last, fold_umlauts
from ..packs import lexicon, literal

CELL_ORDER = [c for c in lexicon._ENGLISH_VERB_CELLS] + [c for c in lexicon._GERMAN_VERB_CELLS if c != "base_form"]
#: Verbs that leave a prefix which other verbs keep.
SPLITTABLE = [("durch", "durchfahren"), ("durch", "durchfallen"), ("durch", "durchgehen"), ("durch", "durchscheinen")]


def prefix_rows() -> list[tuple[str, bool]]:
    return [(p, False) for p in lexicon.FIRM_PREFIXES] + [(p, True) for p in lexicon.LOOSE_PREFIXES]


def with_prefix(verbs: DataFrame, verb: str = "target", splittable: DataFrame | None = None) -> DataFrame:
    """``verbs`` with ``prefix``: what leaves the verb, NULL if nothing does.

    All beginnings of a verb are looked up at once; a firm one keeps the verb whole, else the longest loose one leaves
    it, else one that is listed for this verb."""
    spark = verbs.sparkSession
    table = literal.frame(spark, "prefix, loose", prefix_rows())
    listed = literal.frame(spark, "prefix, verb", SPLITTABLE) if splittable is None else splittable
    one = verbs.select(F.col(verb).alias("_verb")).distinct()
    starts = one.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.length("_verb") - 1, F.lit(2))), lambda n: F.substring("_verb", F.lit(1), n))))
    known = starts.join(table, "prefix").select("_verb", "prefix", "loose")
    named = one.join(listed, one["_verb"] == listed["verb"]).select("_verb", "prefix", F.lit(True).alias("loose"))
    best = known.unionByName(named).groupBy("_verb").agg(
        F.bool_and("loose").alias("_loose"), F.max_by("prefix", F.length("prefix")).alias("prefix")
    )
    best = best.select("_verb", F.when(F.col("_loose"), F.col("prefix")).alias("prefix"))
    return verbs.join(best, F.col(verb) == F.col("_verb"), "left").drop("_verb")


def _rest(text: Column, n: Column) -> Column:
    return F.substring(text, n + 1, F.length(text))


def _shared(rows: DataFrame, one: str) -> DataFrame:
    """``rows`` with ``_n``: the letters that a form and its lemma begin with alike, umlauts as plain vowels; 0 where the
    words differ in how many `ä` they have."""
    letters = lambda word: F.split(fold_umlauts(word), "")
    umlauts = lambda word: F.regexp_count(F.lower(word), F.lit("ä"))
    alike = F.zip_with(letters(F.lower(F.col(one))), letters(F.col("lemma")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    rows = rows.withColumn("_alike", F.array_append(alike, F.lit(False)))
    return rows.withColumn("_n", F.when(umlauts(F.col(one)) != umlauts(F.col("lemma")), 0).otherwise((F.array_position("_alike", False) - 1).cast("int")))


def _german(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_written``: the target with what the source has and its lemma has not: zu, ge, ending."""
    source, lemma, target, prefix = (F.col(c) for c in ("_source", "lemma", "target", "prefix"))
    times = lambda text, part: F.regexp_count(text, F.lit(part))
    inside = lambda part: F.concat(prefix, F.lit(part), _rest(target, F.length(prefix)))
    rows = rows.withColumn("_zu", times(source, "zu") > times(lemma, "zu")).withColumn("_ge", times(source, "ge") > times(lemma, "ge"))
    rows = _shared(rows, "_source")
    begun = F.substring(source, F.lit(1), F.col("_n"))
    ge_inside = F.col("_ge") & _rest(source, F.col("_n")).startswith("ge")
    rows = rows.withColumn("_bare", F.when(ge_inside, F.concat(begun, _rest(source, F.col("_n") + 2))).otherwise(source))
    rows = _shared(rows, "_bare")
    rows = rows.withColumn("_ending", _rest(F.col("_bare"), F.col("_n")))
    shorter = lemma.rlike("[ts]$") & F.col("_ending").startswith("e")
    rows = rows.withColumn("_ending", F.when(shorter, _rest(F.col("_ending"), F.lit(1))).otherwise(F.col("_ending")))
    # Longer endings are no endings: the words share too little (gewannen, gewinnen).
    usable = F.length("_ending") <= 3
    kept = F.length(target) - (F.length(lemma) - F.col("_n"))
    rows = rows.withColumn("_root", F.when(usable, F.substring(target, F.lit(1), kept)).otherwise(target))
    rows = rows.withColumn("_ending", F.when(usable, F.col("_ending")).otherwise(""))
    root, ending = F.col("_root"), F.col("_ending")
    rows = rows.withColumn("_binds", root.rlike("[tncvrh]$") & ending.rlike("^[tsnr]"))
    binds = F.col("_binds")
    vowel = ending.startswith("n") | ~root.rlike("(en|in|ön|h)$")
    link = F.when(binds & vowel, "e").when(~binds & root.endswith("s"), "s").otherwise("")
    put = (
        F.when((ending == "") | (F.length(root) <= 2), F.concat(root, ending))
        .when(root.endswith("em"), root)
        .when(~binds & root.endswith("e") & ending.startswith("e"), F.concat(drop_last(root, 1), ending))
        .otherwise(F.concat(root, link, ending))
    )
    written = (
        F.when(F.col("_zu"), F.when(prefix.isNotNull(), inside("zu")).otherwise(F.concat(F.lit("zu "), target)))
        .when(F.col("_ge") & prefix.isNotNull(), inside("ge"))
        .otherwise(put)
    )
    return rows.withColumn("_written", written)


def english_cell(word: Column) -> Column:
    """The tense that an English ending stands for."""
    return (
        F.when(word.rlike("..ing$"), "present_participle")
        .when(word.rlike("..ed$"), "past_tense")
        .when(word.rlike("[^s]s$"), "third_person_singular")
    )


def english(verb: Column, cell: Column) -> Column:
    """A regular verb in a tense; the verb itself without one."""
    mute, y = verb.rlike("[^aeiouy]e$|[aiou]e$") & ~verb.rlike("ee$"), verb.rlike("[^aeiou]y$")
    third = F.when(y, F.concat(drop_last(verb, 1), F.lit("ies"))).when(verb.rlike("(s|x|z|ch|sh|o)$"), F.concat(verb, F.lit("es"))).otherwise(F.concat(verb, F.lit("s")))
    past = F.when(verb.endswith("e"), F.concat(verb, F.lit("d"))).when(y, F.concat(drop_last(verb, 1), F.lit("ied"))).otherwise(F.concat(verb, F.lit("ed")))
    going = F.when(verb.endswith("ie"), F.concat(drop_last(verb, 2), F.lit("ying"))).when(mute, F.concat(drop_last(verb, 1), F.lit("ing"))).otherwise(F.concat(verb, F.lit("ing")))
    return F.when(cell == "third_person_singular", third).when(cell.isin("past_tense", "past_participle"), past).when(cell == "present_participle", going).otherwise(verb)


def forms(spark: SparkSession) -> DataFrame:
    """(lang, base_form, cell, place, form): place is the order in which a form's cell is chosen."""
    rows = [("en", b, c, CELL_ORDER.index(c), f) for b, c, f in lexicon.english_verb_rows()]
    rows += [("de", b, c, CELL_ORDER.index(c), f) for b, c, f in lexicon.german_verb_rows()]
    return literal.frame(spark, "lang, base_form, cell, place, form", rows)


def aligned(pairs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(lang, source, lemma, target) with ``cell`` and ``aligned``: the target verb in the source's form."""
    table = forms(pairs.sparkSession) if table is None else table
    named = table.select("lang", F.col("base_form").alias("lemma"), F.lower("form").alias("_source"), F.struct("place", "cell").alias("_c"))
    named = named.groupBy("lang", "lemma", "_source").agg(F.min("_c")["cell"].alias("_known"))
    rows = pairs.withColumn("_source", F.lower("source")).join(named, ["lang", "lemma", "_source"], "left")
    rows = rows.withColumn("cell", F.when((F.col("lang") == "en") & F.col("_known").isNull(), english_cell(F.col("_source"))).otherwise(F.col("_known")))
    ready = table.select("lang", F.col("base_form").alias("target"), "cell", F.col("form").alias("_ready"))
    rows = _german(with_prefix(rows.join(ready, ["lang", "target", "cell"], "left")))
    written = F.when(F.col("lang") == "de", F.col("_written")).otherwise(english(F.col("target"), F.col("cell")))
    return rows.withColumn("aligned", F.coalesce("_ready", written)).select(*pairs.columns, "cell", "aligned")
