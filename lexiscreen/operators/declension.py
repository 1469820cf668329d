"""Which declension cell a German noun stands in, and other nouns in the same cell.

A cell set is a bit mask: four cases (nominative, accusative, genitive, dative) for each gender in the singular, and four
for the plural.  Preposition, article, adjective and noun form each allow a set; what all of them allow is where the noun
stands.  If that is one cell, the noun's form is known; if several are left, they stay a set."""

from __future__ import annotations

from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gender
from ..packs import fixed, lexicon, literal
from .tokens import piece_token, tokens

CASES = ("nominativ", "akkusativ", "genitiv", "dativ")
GENDERS = ("masculine", "feminine", "neuter")
PLURAL = 12
EVERYTHING = (1 << 16) - 1
_SINGULAR = (1 << PLURAL) - 1
#: Cell names by bit.
NAMES = [f"sg_{c[:3]}" for _ in GENDERS for c in ("nom", "acc", "gen", "dat")] + ["pl_nom", "pl_acc", "pl_gen", "pl_dat"]


def bits(*cells: tuple[str, str]) -> int:
    """Mask of (gender or "plural", case) pairs."""
    mask = 0
    for kind, case in cells:
        mask |= 1 << ((PLURAL if kind == "plural" else 4 * GENDERS.index(kind)) + CASES.index(case))
    return mask


def article_rows() -> list[tuple[str, int, str]]:
    """(article, mask, declension of the adjective behind it) from the article table, up to its contractions."""
    masks: dict[str, int] = {}
    for case, masculine, feminine, neuter, plural, *_ in takewhile(lambda r: r[1] != "zum", fixed.article_rows()):
        for kind, word in zip((*GENDERS, "plural"), (masculine, feminine, neuter, plural)):
            masks[word] = masks.get(word, 0) | bits((kind, case))
    return [(w, m, "weak" if w[:2] in ("de", "di", "da", "je") and w[:4] not in ("dein",) else "mixed") for w, m in sorted(masks.items())]


def adjective_rows() -> list[tuple[str, str, int]]:
    """(declension, ending, mask): -e and the endings that carry the gender where the article does not; -en for the rest."""
    nominative = [(g, "nominativ") for g in GENDERS]
    weak_e = bits(*nominative, ("feminine", "akkusativ"), ("neuter", "akkusativ"))
    mixed = {
        "er": bits(("masculine", "nominativ")),
        "es": bits(("neuter", "nominativ"), ("neuter", "akkusativ")),
        "e": bits(("feminine", "nominativ"), ("feminine", "akkusativ")),
    }
    rows = [("weak", "e", weak_e), ("weak", "en", EVERYTHING & ~weak_e)]
    return rows + [("mixed", e, m) for e, m in mixed.items()] + [("mixed", "en", EVERYTHING & ~sum(mixed.values()))]


#: Prepositions by the cases they govern.
PREPOSITIONS = {
    ("dativ",): "mit nach bei seit von aus gegenüber außer",
    ("akkusativ",): "durch für gegen ohne um",
    ("genitiv",): "während trotz statt",
    ("akkusativ", "dativ"): "in an auf über unter vor neben zwischen hinter",
}


def preposition_rows() -> list[tuple[str, int]]:
    mask = lambda cases: bits(*[(kind, c) for kind in (*GENDERS, "plural") for c in cases])
    return [(word, mask(cases)) for cases, words in PREPOSITIONS.items() for word in words.split()]


def noun_rows() -> list[tuple[str, str, str, int]]:
    """(form in lower case, base form, gender, mask)."""
    masks: dict[tuple, int] = {}
    for base, kind, _, _, cell, form in lexicon.german_noun_rows():
        number, case = cell.split("_")
        case = {"nom": "nominativ", "acc": "akkusativ", "gen": "genitiv", "dat": "dativ"}[case]
        key = (form.lower(), base, kind)
        masks[key] = masks.get(key, 0) | bits((kind if number == "sg" else "plural", case))
    return [(*key, mask) for key, mask in sorted(masks.items())]


ADJECTIVE = r"^\p{Ll}+(?:e|en|er|es)$"
BREAK = r"^[.!?]|\n"


def _cell_names(mask: Column) -> Column:
    names = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.lit(n).alias("name")) for k, n in enumerate(NAMES)])
    hit = F.filter(names, lambda n: mask.bitwiseAND(n["bit"]) != 0)
    return F.array_distinct(F.transform(hit, lambda n: n["name"]))


def noun_cells(texts: DataFrame, nouns: DataFrame | None = None) -> DataFrame:
    """(doc_id, i, tok, base_form, gender, article, cells, cell) of every German noun of the lexicon.

    Gendered forms are looked up by their feminine.  A word with a dash at its end is not declined: its cell is
    ``no_change``.  ``cell`` is NULL where several are left or none."""
    spark = texts.sparkSession
    nouns = literal.frame(spark, "form, base_form, gender, mask", noun_rows()) if nouns is None else nouns
    words = tokens(texts.filter("lang = 'de'"), prev=4)
    words = words.withColumn("form", F.lower(gender.remove_ending(F.regexp_replace("tok", "-$", ""))))
    rows = words.join(nouns, "form")
    cut = lambda k: F.exists(F.slice("prev", F.greatest(F.size("prev") - k + 1, F.lit(1)), F.lit(k)), lambda p: p.rlike(BREAK))
    for k in range(1, 5):
        piece = F.try_element_at("prev", F.lit(-k))
        rows = rows.withColumn(f"p{k}", F.when(~cut(k), piece_token(piece)))
    articles = literal.frame(spark, "word, article_mask, declension", article_rows())
    known = lambda k: articles.select(F.col("word").alias(f"_a{k}"), F.struct("word", "article_mask", "declension").alias(f"a{k}"))
    for k in range(1, 4):
        rows = rows.withColumn(f"_a{k}", F.lower(f"p{k}")).join(known(k), f"_a{k}", "left")
    adjective = lambda k: F.col(f"a{k}").isNull() & F.coalesce(F.col(f"p{k}").rlike(ADJECTIVE), F.lit(False))
    place = F.when(F.col("a1").isNotNull(), 1).when(adjective(1) & F.col("a2").isNotNull(), 2).when(adjective(1) & adjective(2) & F.col("a3").isNotNull(), 3)
    rows = rows.withColumn("_place", place).withColumn("_article", F.element_at(F.array("a1", "a2", "a3"), F.coalesce("_place", F.lit(1))))
    rows = rows.withColumn("_article", F.when(F.col("_place").isNotNull(), F.col("_article")))
    rows = rows.withColumn("_ending", F.when(F.col("_place") > 1, F.regexp_extract("p1", "(e|en|er|es)$", 1)))
    endings = literal.frame(spark, "_declension, _ending, adjective_mask", adjective_rows())
    rows = rows.withColumn("_declension", F.col("_article.declension")).join(endings, ["_declension", "_ending"], "left")
    before = F.lower(F.element_at(F.array("p1", "p2", "p3", "p4"), F.coalesce("_place", F.lit(0)) + 1))
    governed = literal.frame(spark, "_before, preposition_mask", preposition_rows())
    rows = rows.withColumn("_before", before).join(governed, "_before", "left")
    mask = F.col("mask")
    for part in ("_article.article_mask", "adjective_mask", "preposition_mask"):
        mask = mask.bitwiseAND(F.coalesce(part, F.lit(EVERYTHING)))
    fixed_form = F.col("tok").endswith("-")
    rows = rows.withColumn("cells", F.when(~fixed_form, _cell_names(mask)).otherwise(F.array().cast("array<string>")))
    cell = F.when(fixed_form, "no_change").when(F.size("cells") == 1, F.col("cells")[0])
    return rows.select("doc_id", "i", "tok", "base_form", "gender", F.col("_article.word").alias("article"), "cells", cell.alias("cell"))


#: Nouns proposed for another one.
NOUN_ALTERNATIVES = [
    ("Lehrer", "Fachkraft"), ("Kollege", "Mensch"), ("Geber", "Person"), ("Geberin", "Person"), ("Erbe", "Mensch"), ("Kunde", "Person"),
    ("Student", "Person"), ("Chef", "Person"), ("Verein", "Team"), ("Einheit", "Team"), ("Ente", "Mensch"), ("Stein", "Einheit"), ("Enge", "Stau"),
    ("Schau", "Projekt"), ("Schein", "Einheit"), ("Stau", "Enge"), ("Berg", "Haus"), ("Arzt", "Person"), ("Mitarbeiter", "Fachkraft"),
]


def article_paradigm_rows() -> list[tuple[str, str, str, str]]:
    """(article, case, gender or "plural", article of that gender): one row of the article table crosswise."""
    rows = {}
    for case, *words in takewhile(lambda r: r[1] != "zum", fixed.article_rows()):
        for word in words[:4]:
            for kind, other in zip((*GENDERS, "plural"), words[:4]):
                rows.setdefault((word, case, kind), other)
    return [(*key, other) for key, other in sorted(rows.items())]


def inflected(nouns: DataFrame, alternatives: DataFrame) -> DataFrame:
    """``noun_cells`` rows with each alternative (base_form, alternative) in the same cell: suggestion, and new_article.

    Where several cells are left but the alternative has one form in all of them, that form is meant; else its base
    form.  The article changes to the alternative's gender where the case is known."""
    spark = nouns.sparkSession
    forms = lexicon.german_nouns(spark).select(F.col("base_form").alias("alternative"), F.col("gender").alias("_gender"), F.col("cell").alias("_cell"), F.col("form").alias("_form"))
    of_cell = F.map_from_entries(F.collect_list(F.struct("_cell", "_form")))
    paradigm = forms.groupBy("alternative", "_gender").agg(of_cell.alias("_forms"))
    rows = nouns.join(alternatives, "base_form").join(paradigm, "alternative", "left")
    fits = F.array_distinct(F.transform("cells", lambda c: F.try_element_at("_forms", c)))
    suggestion = F.when(F.size(fits) == 1, F.coalesce(fits[0], "alternative")).otherwise(F.col("alternative"))
    case = F.element_at(F.create_map(*[F.lit(x) for c in CASES for x in ({"akkusativ": "acc"}.get(c, c[:3]), c)]), F.substring("cell", 4, 3))
    rows = rows.withColumn("suggestion", suggestion).withColumn("_case", case)
    rows = rows.withColumn("_kind", F.when(F.col("cell").startswith("pl"), "plural").otherwise(F.col("_gender")))
    table = literal.frame(spark, "article, _case, _kind, new_article", article_paradigm_rows())
    rows = rows.join(table, ["article", "_case", "_kind"], "left")
    return rows.select("doc_id", "i", "tok", "base_form", "cell", "alternative", "suggestion", "article", "new_article")
