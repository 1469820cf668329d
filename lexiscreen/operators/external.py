"""Matches of an external spell and style checker: a table of spans, and the reasons to drop one.

The checker's matches come as a table (doc_id, start, end, rule_id, category).  ``spelling`` makes such a table from the
corpus itself: words that no other text of the language has, blanks in a row, lower case at a sentence's start and a
colon without a blank behind it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import inklusivum
from ..packs import fixed, lexicon, literal
from . import sweep
from .tokens import Wanted, tokens

_CONTEXT = pa.schema(
    [("start", pa.int32()), ("end", pa.int32())]
    + [(name, pa.string()) for name in ("rule_id", "category", "text", "before", "after")]
    + [("leading", pa.bool_()), ("greeted", pa.bool_())]
)
#: Rule, category; what a match of the corpus's own checks can be.
SPELL, BLANKS, CASE, COLON = ("SPELL", "TYPOS"), ("WHITESPACE_RULE", "TYPOGRAPHY"), ("DE_CASE", "CASING"), ("LEERZEICHEN_HINTER_DOPPELPUNKT", "TYPOGRAPHY")
BEFORE, AFTER = 10, 8


def spelling(texts: DataFrame) -> DataFrame:
    """(doc_id, lang, start, end, rule_id, category) of the corpus's own checks.  Words are counted in lower case over
    the whole table; a word seen once carries its only place through the aggregate, so nothing is joined back.  The places are
    plain numbers, which are summed up by hash before the shuffle; a struct of them would have every word sorted."""
    once = (
        tokens(texts, only=Wanted(lambda tok, _: len(tok) >= 4))
        .filter(F.col("tok").rlike(r"^\p{L}{4,}$"))
        .groupBy("lang", F.lower("tok").alias("word"))
        .agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("doc_id", "start", "end")])
        .filter("n = 1")
        .select("doc_id", "lang", "start", "end", F.lit(SPELL[0]).alias("rule_id"), F.lit(SPELL[1]).alias("category"))
    )
    words = tokens(texts, prev=1, only=Wanted(lambda tok, piece: len(piece) - len(tok) > 1, after=lambda p: p[0] in ".!?" or "\n" in p or p == ":"))
    behind = F.try_element_at("prev", F.lit(-1))
    german = F.col("lang") == "de"
    found = F.array_compact(
        F.array(
            F.when(F.length("ws") > 1, _match(F.col("end"), F.col("end") + F.length("ws"), BLANKS)),
            F.when(german & F.col("tok").rlike(r"^\p{Ll}") & behind.rlike(r"^[.!?]|\n"), _match(F.col("start"), F.col("end"), CASE)),
            F.when(german & (behind == ":"), _match(F.col("start") - 1, F.col("end"), COLON)),
        )
    )
    local = words.select("doc_id", "lang", F.inline(found))
    return once.unionByName(local)


def _match(start: Column, end: Column, rule: tuple[str, str]) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.lit(rule[0]).alias("rule_id"), F.lit(rule[1]).alias("category"))


def names(texts: DataFrame) -> DataFrame:
    """(doc_id, start, end, label): capitalised words that open no sentence, the default where no entity table is given."""
    words = tokens(texts, prev=1, only=Wanted(lambda tok, _: len(tok) > 2 and not tok[0].islower()))
    behind = F.try_element_at("prev", F.lit(-1))
    kept = words.filter(F.col("tok").rlike(r"^\p{Lu}\p{Ll}{2,}$") & (F.col("lang") != "de") & ~behind.rlike(r"^[.!?]|\n|^[ \t]*$"))
    return kept.select("doc_id", "start", "end", F.lit("PER").alias("label"))


def _contexts(batches):
    """Each match of a text with what stands in and around it; a text is sliced once a match."""
    opening = {lang: tuple(f"{word.lower()} " for word in words) for lang, words in fixed.SALUTATIONS.items()}
    for batch in batches:
        for k, value in enumerate(batch.column("text").to_pylist()):
            spans = batch.column("spans")[k].as_py()
            if not spans or value is None:
                continue
            lead = len(value) - len(value.lstrip())
            first_line = value.find("\n", lead)
            first_line = len(value) if first_line < 0 else first_line
            line = value[lead:first_line].lower()
            words = opening.get(batch.column("lang")[k].as_py(), ())
            greeted = min((lead + line.find(w) + len(w) for w in words if w in line), default=None)
            rows = []
            for s in spans:
                start, end = s["start"], s["end"]
                rows.append(
                    s
                    | {
                        "text": value[start:end],
                        "before": value[max(start - BEFORE, 0) : start],
                        "after": value[end : end + AFTER],
                        "leading": start == 0 or end <= lead,
                        "greeted": greeted is not None and greeted <= start <= first_line,
                    }
                )
            out = pa.RecordBatch.from_pylist(rows, _CONTEXT)
            keys = [batch.column(c).take(pa.array([k] * len(rows))) for c in ("doc_id", "lang")]
            yield pa.RecordBatch.from_arrays([*keys, *out.columns], names=["doc_id", "lang", *_CONTEXT.names])


def with_context(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """``matches`` with text, before, after, leading (nothing but blanks up to its end) and greeted (on the first line,
    behind a salutation).  Texts without a match are dropped by the join; a text's matches are one list beside it."""
    spans = matches.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "rule_id", "category")).alias("spans"))
    joined = texts.select("doc_id", "lang", "text").join(spans, "doc_id")
    fields = "start int, end int, rule_id string, category string, text string, before string, after string, leading boolean, greeted boolean"
    schema = T.StructType([joined.schema["doc_id"], joined.schema["lang"]] + T._parse_datatype_string(fields).fields)
    return joined.mapInArrow(_contexts, schema)


def inclusive_words(spark) -> DataFrame:
    """Articles, pronouns and noun forms of the inclusive declension in lower case, from the article table and the lexicon's pairs."""
    pairs = lexicon.table(spark, "masculine, feminine", [(n[0], n[5]) for n in lexicon.GERMAN_NOUNS if n[5]])
    articles = literal.frame(spark, "word", sorted({(r[6],) for r in fixed.article_rows()}))
    nouns = inklusivum.paradigm(pairs).select(F.lower("form").alias("word"))
    return articles.union(nouns).distinct()


def reason(ending: str, separator: str, inclusive_roles: bool = True) -> Column:
    """The first reason to drop a match with its context, NULL to keep it.  ``name`` (label of the first entity that
    crosses it), ``is_inclusive`` and ``is_feminine`` are looked up before; ``ending`` and ``separator`` are the writer's
    German and French formats."""
    lang, rule, category, text = (F.col(c) for c in ("lang", "rule_id", "category", "text"))
    before, after = F.col("before"), F.col("after")
    typo = category == "TYPOS"
    last = F.expr("right(before, 1)")
    articles = sorted({r[1] for r in fixed.article_rows()})
    found = (
        F.when((rule == "DE_CASE") & F.rtrim(before, F.lit(" ")).rlike(r"[\n\t]$"), "line start")
        .when((rule == "WHITESPACE_RULE") & F.col("leading"), "leading blanks")
        .when(typo & text.rlike(r"^\p{Lu}") & F.coalesce(F.col("name").isin(*fixed.NAME_LABELS), F.lit(False)), "name")
        .when(typo & F.col("greeted"), "salutation")
        .when((lang == "fr") & F.col("is_feminine"), "feminine noun")
        .when((lang == "fr") & (F.col("start") > 5) & ((last == separator[0]) | text.startswith(separator[0])), "separator")
    )
    if ending == "de-e":
        formed = F.col("is_inclusive") | inklusivum.is_possessive(text)
        adjective = (F.length(text) > 4) & F.lower(text).rlike("(" + "|".join(fixed.INCLUSIVE_ADJECTIVE_ENDINGS) + ")$")
        found = found.when((lang == "de") & typo & (formed | adjective), "inclusive form")
    if separator[0] == "/":
        found = found.when((lang == "fr") & after.startswith("/") & (rule == "D_N"), "separator")
    if ending == ":in":
        found = found.when((lang == "de") & (rule == COLON[0]) & F.substring(text, F.lit(2), F.length(text)).isin(*articles), "colon ending")
    found = found.when(text.rlike("^[@#]") | last.isin("@", "#"), "mention")
    if inclusive_roles:
        behind = F.lit(False)
        for known in fixed.GERMAN_ENDINGS_BEHIND:
            behind = behind | after.startswith(known)
        found = found.when((lang == "de") & behind, "gender ending")
    return found


def subcategory(known: list[str], group: Column | None = None, message: Column | None = None) -> Column:
    """What a match is reported under, NULL if it is not reported; ``known`` are the keys of the taxonomy, ``group`` is the
    name of the checker's category."""
    rule, category = F.col("rule_id"), F.col("category")
    foreign = (rule == "ANGLIZISMEN") | (F.lit(False) if message is None else F.coalesce(message.contains("Fremdwörter"), F.lit(False)))
    easy = F.lit(False) if group is None else F.coalesce(group == "Leichte Sprache", F.lit(False))
    plain = (category == "COLLOQUIALISMS") | ((category == "STYLE") & rule.isin(*fixed.EXTERNAL_PLAIN))
    return (
        F.when(rule.isin(*fixed.EXTERNAL_SILENT), None)
        .when(plain, "plain_language")
        .when((category == "STYLE") & rule.isin(*fixed.EXTERNAL_OFFENSIVE), "offensive_language")
        .when(category.isin(*fixed.EXTERNAL_STYLE), "orthography")
        .when(category == "PLAIN_ENGLISH", "plain_language_advanced")
        .when((category == "DIFFICULT_WORDS") & (rule == "ABKUERZUNG"), None)
        .when((category == "DIFFICULT_WORDS") & foreign, "anglicism_advanced")
        .when((category == "DIFFICULT_WORDS") | easy, "plain_language_advanced")
        .when(F.lower(category).isin(*known), F.lower(category))
        .otherwise("orthography")
    )


def judged(texts: DataFrame, matches: DataFrame, entities: DataFrame, ending: str = "*in", separator: str = "·", inclusive_roles: bool = True) -> DataFrame:
    """Every match with its text and the reason to drop it, NULL for the kept ones."""
    spark = texts.sparkSession
    rows = sweep.first_crossing(with_context(texts, matches), entities, "label", "name")
    inclusive = inclusive_words(spark).withColumn("is_inclusive", F.lit(True))
    feminine = [(n[2],) for n in lexicon.FRENCH_NOUNS if n[2]] + [(n[0],) for n in lexicon.FRENCH_NOUNS if n[3] == "feminine" and not n[4]]
    known = literal.frame(spark, "text", feminine).distinct().withColumn("is_feminine", F.lit(True))
    rows = rows.withColumn("word", F.lower("text")).join(inclusive, "word", "left").join(known, "text", "left").drop("word")
    rows = rows.fillna(False, ["is_inclusive", "is_feminine"])
    return rows.select("doc_id", "lang", "start", "end", "rule_id", "category", "text", reason(ending, separator, inclusive_roles).alias("reason"))
