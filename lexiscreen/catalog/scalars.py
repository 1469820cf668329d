"""Column functions over the vocabulary of the corpus (each distinct word once)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import french, gender, inklusivum, privacy, words as w
from ..operators.tokens import sentences, tokens, vocabulary
from ..packs import fixed, literal
from ..sources import texts as src
from . import sql as q
from .joins import SENTENCES
from .registry import query

VOCAB = q.with_(q.VOCABULARY)


def vocab(spark, folder, condition="true"):
    return vocabulary(tokens(src.documents(spark, folder))).filter(condition)


def _add(name, sql, columns, condition="true", where="true"):
    """One query per expression: ``columns(spark)`` over the vocabulary."""

    @query(name, VOCAB + f"SELECT lang, tok, {sql} FROM vocabulary WHERE {where}")
    def run(spark, folder):
        return vocab(spark, folder, condition).select("lang", "tok", *columns())

    return run


tok = lambda: F.col("tok")
_add("f01_upperfirst", "replace(upper(left(tok, 1)), 'ẞ', 'SS') || substr(tok, 2) AS value", lambda: [w.upper_first(tok()).alias("value")])

@query(
    "f02_common_prefix",
    VOCAB
    + """SELECT lang, tok, CASE WHEN ae <> be THEN '' ELSE left(a, list_max(list_filter(range(0, length(a) + 1), lambda k: k <= length(b) AND left(a, k) = left(b, k)))) END AS prefix
    FROM (SELECT lang, tok, lower(translate(tok, 'äöü', 'aou')) AS a, translate(other, 'äöü', 'aou') AS b,
        length(lower(tok)) - length(replace(lower(tok), 'ä', '')) AS ae, length(lower(other)) - length(replace(lower(other), 'ä', '')) AS be
      FROM (SELECT *, lower(left(tok, length(tok) // 2)) || 'in' AS other FROM vocabulary WHERE lang = 'de'))""",
)
def f02(spark, folder):
    other = F.concat(F.lower(F.expr("left(tok, cast(length(tok) div 2 as int))")), F.lit("in"))
    rows = vocab(spark, folder, "lang = 'de'").withColumn("other", other)
    return rows.select("lang", "tok", w.common_prefix(F.col("tok"), F.col("other")).alias("prefix"))


_add(
    "f03_word_case",
    r"""NOT ends_with(tok, '-') AND len(list_filter(string_split(tok, '-'), lambda p: p <> '' AND NOT (regexp_matches(p, '^\p{Lu}')
       AND substr(p, 2) = lower(substr(p, 2)) AND regexp_matches(substr(p, 2), '\p{Ll}')))) = 0 AS titled""",
    lambda: [w.word_case(tok(), True).alias("titled")],
)

@query(
    "f17_parse_word_type",
    VOCAB
    + """SELECT lang, tok, CASE WHEN left(spec, 1) IN ('~', '=', '-') THEN substr(spec, 2) ELSE spec END AS word_type,
     CASE left(spec, 1) WHEN '~' THEN true WHEN '=' THEN false WHEN '-' THEN false ELSE true END AS lower_case,
     left(spec, 1) NOT IN ('~', '=') AS lemmatize
     FROM (SELECT *, ['~', '=', '-', ''][(length(tok) % 4 + 1)::INT] || tok AS spec FROM vocabulary)""",
)
def f17(spark, folder):
    mark = F.element_at(F.array(*map(F.lit, ("~", "=", "-", ""))), F.length("tok") % 4 + 1)
    rows = vocab(spark, folder).withColumn("spec", F.concat(mark, F.col("tok")))
    return rows.withColumn("p", w.parse_word_type(F.col("spec"))).select("lang", "tok", "p.*")


_add(
    "f18_category_names",
    "regexp_replace(tok || '_advanced', '_advanced$', '') AS base, tok || '_advanced' AS advanced",
    lambda: [
        F.regexp_replace(F.concat(tok(), F.lit("_advanced")), "_advanced$", "").alias("base"),
        F.concat(tok(), F.lit("_advanced")).alias("advanced"),
    ],
)
_add(
    "f35_a_an",
    "CASE WHEN lower(left(tok, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || tok AS phrase",
    lambda: [w.a_or_an(tok()).alias("phrase")], "lang = 'en'", "lang = 'en'",
)
_add(
    "f16_swiss_spelling", "replace(tok, 'ß', 'ss') AS swiss", lambda: [F.replace(tok(), F.lit("ß"), F.lit("ss")).alias("swiss")],
    "lang = 'de'", "lang = 'de'",
)
_add(
    "f14_add_prefix",
    """CASE WHEN starts_with(tok, 'Haupt') THEN tok WHEN NOT starts_with(tok, '-') THEN 'Haupt' || lower(left(tok, 1)) || substr(tok, 2)
       ELSE 'Haupt' || tok END AS compound""",
    lambda: [
        F.when(tok().startswith("Haupt"), tok())
        .when(~tok().startswith("-"), F.concat(F.lit("Haupt"), w.lower_first(tok())))
        .otherwise(F.concat(F.lit("Haupt"), tok())).alias("compound")
    ],
    "lang = 'de'", "lang = 'de'",
)
_add(
    "f32_possessive",
    """CASE WHEN regexp_matches(lower(tok), '^(sein|ihr)') THEN regexp_replace(lower(tok), '^(sein|ihr)', 'ens') END AS possessive,
       regexp_matches(lower(tok), '^ens(e|em|en|er|es|ers|erm)?$') AS is_possessive""",
    lambda: [inklusivum.possessive(tok()).alias("possessive"), inklusivum.is_possessive(tok()).alias("is_possessive")],
    "lang = 'de'", "lang = 'de'",
)
_add(
    "p14_long_word",
    r"""length(tok) > 18 AND (len(regexp_split_to_array(tok, '[/@:._-]')) = 1
       OR len(list_filter(regexp_split_to_array(tok, '[/@:._-]'), lambda p: length(p) > 12)) > 0) AS flagged""",
    lambda: [w.long_word(tok()).alias("flagged")], "length(tok) > 15", "length(tok) > 15",
)
_add(
    "f22_utf16_offset",
    r"length(tok) + length(regexp_replace(tok, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS utf16",
    lambda: [w.utf16_length(tok()).cast("long").alias("utf16")],
)

@query(
    "f28_french_feminine",
    q.with_(
        q.VOCABULARY,
        "endings AS " + literal.values("rank, ending, cut, added", [(k, *e) for k, e in enumerate(french.feminine_endings())]),
        "one_form AS " + literal.values("w", [(w_,) for w_ in fixed.FRENCH_INVARIABLE]),
    )
    + """SELECT word, CASE WHEN word IN (SELECT w FROM one_form) THEN word ELSE (SELECT arg_min(left(word, length(word) - cut) || added, rank) FROM endings WHERE ends_with(word, ending)) END AS feminine
     FROM (SELECT DISTINCT lower(tok) AS word FROM vocabulary WHERE lang = 'fr')""",
)
def f28(spark, folder):
    rows = vocab(spark, folder, "lang = 'fr'").select(F.lower("tok").alias("word")).distinct()
    return rows.select("word", french.feminine_adjective(F.col("word")).alias("feminine"))


# -- German gender formats ---------------------------------------------------

_FMT = "formats AS " + literal.values("k, fmt", list(enumerate(gender.FORMATS)))
_TGT = "targets AS " + literal.values("target", [(f,) for f in gender.FORMATS])
_PART_RE = gender.PARTS


def _render_sql(ending: str, target: str) -> str:
    gen = f"CASE WHEN regexp_extract({ending}, '^({_PART_RE})') = '' THEN {ending} ELSE regexp_extract({ending}, '^({_PART_RE})') END"
    rest = f"CASE WHEN regexp_extract({ending}, '^({_PART_RE})') = '' THEN '' ELSE substr({ending}, length(regexp_extract({ending}, '^({_PART_RE})')) + 1) END"
    sep = " ".join(f"WHEN '{f}' THEN '{s}' || {gen} || {rest}" for f, s in gender.NOUN_SEPARATORS.items())
    return (
        f"CASE {target} WHEN 'In' THEN CASE WHEN starts_with({ending}, 'in') THEN upper(left({gen}, 1)) || substr({gen}, 2) || {rest}"
        f" ELSE '/' || {gen} || {rest} END WHEN '()' THEN '(' || {gen} || ')' || {rest}"
        f" WHEN '(-)' THEN '(-' || {gen} || ')' || {rest} {sep} END"
    )


# Gendered words written in every format, derived from the capitalised words of
# the German texts: the word's length picks the format, its frequency the ending.
WRITTEN = (
    "stems AS (SELECT tok AS stem, n, ['innen', 'in', 'r', 'innengruppe'][(n % 4 + 1)::INT] AS ending, length(tok) % 8 AS k"
    r" FROM vocabulary WHERE lang = 'de' AND regexp_matches(tok, '^[A-ZÄÖÜ][a-zäöü]{3,}$')),"
    " written AS (SELECT s.stem, s.ending, f.fmt, s.stem || " + _render_sql("s.ending", "f.fmt")
    + " AS written FROM stems s JOIN formats f ON f.k = s.k)"
)
GENDERED = q.with_(q.VOCABULARY, _FMT, _TGT, WRITTEN)


def gendered(spark, folder):
    stems = vocab(spark, folder, "lang = 'de'").filter(F.col("tok").rlike("^[A-ZÄÖÜ][a-zäöü]{3,}$"))
    endings = F.array(*map(F.lit, ("innen", "in", "r", "innengruppe")))
    formats = F.array(*map(F.lit, gender.FORMATS))
    rows = stems.select(
        F.col("tok").alias("stem"),
        F.element_at(endings, (F.col("n") % 4 + 1).cast("int")).alias("ending"),
        F.element_at(formats, F.length("tok") % 8 + 1).alias("fmt"),
    )
    return rows.withColumn("written", F.concat("stem", gender.render_ending(F.col("ending"), F.col("fmt"))))


@query("f08_render_ending", GENDERED + f"SELECT w.stem, w.written, target, stem || {_render_sql('ending', 'target')} AS rendered FROM written w CROSS JOIN targets")
def f08(spark, folder):
    rows = gendered(spark, folder).withColumn("target", F.explode(F.array(*map(F.lit, gender.FORMATS))))
    return rows.select("stem", "written", "target", F.concat("stem", gender.render_ending(F.col("ending"), F.col("target"))).alias("rendered"))


_FORM_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(written, '{p}') THEN '{f}'" for f, p in gender.noun_patterns().items()
) + " END"
_PART_SQL = lambda g: "CASE " + " ".join(
    f"WHEN regexp_matches(written, '{p}') THEN regexp_extract(written, '{p}', {g})" for p in gender.noun_patterns().values()
) + " END"


@query("f04_gender_star_match", GENDERED + f"SELECT written, {_FORM_SQL} AS found FROM written")
def f04(spark, folder):
    return gendered(spark, folder).select("written", gender.form_format(F.col("written")).alias("found"))


@query(
    "f05_remove_gender_ending",
    GENDERED + f"SELECT written, coalesce({_PART_SQL(1)} || {_PART_SQL(2)}, written) AS plain FROM written",
)
def f05(spark, folder):
    return gendered(spark, folder).select("written", gender.remove_ending(F.col("written")).alias("plain"))


@query(
    "f06_noun_ending",
    GENDERED + r"""SELECT written, lower(left(e, 1)) || substr(e, 2) AS ending FROM (
      SELECT written, regexp_replace(regexp_replace(tail, '^(?:/-|[*_:/]|\(-?)', ''), '\)$', '') AS e FROM (
        SELECT written, substr(written, length(stem) + 1) AS tail FROM written))""",
)
def f06(spark, folder):
    tail = F.substring("written", F.length("stem") + 1, F.length("written"))
    return gendered(spark, folder).select("written", gender.noun_ending(tail).alias("ending"))


@query(
    "f07_feminine_form",
    GENDERED + rf"""SELECT written, CASE WHEN part <> '' THEN head || CASE WHEN starts_with(part, 'in') THEN 'in' ELSE part END END AS looked_up FROM (
      SELECT written, regexp_extract(written, '{gender._FEMININE}', 1) AS head,
        regexp_extract(lower(concat(regexp_extract(written, '{gender._FEMININE}', 2), regexp_extract(written, '{gender._FEMININE}', 3))), '^({_PART_RE})', 1) AS part
      FROM written)""",
)
def f07(spark, folder):
    return gendered(spark, folder).select("written", gender.feminine_form(F.col("written")).alias("looked_up"))


@query(
    "f10_convert_noun_form",
    GENDERED + f"SELECT written, target, head || {_render_sql('e', 'target')} AS converted FROM (SELECT written, {_PART_SQL(1)} AS head, lower(left({_PART_SQL(2)}, 1)) || substr({_PART_SQL(2)}, 2) AS e FROM written) CROSS JOIN targets",
)
def f10n(spark, folder):
    rows = gendered(spark, folder).withColumn("target", F.explode(F.array(*map(F.lit, gender.FORMATS))))
    return gender.convert_nouns(rows).select("written", "target", "converted")


# -- article pairs -----------------------------------------------------------

ARTICLE_COLUMNS = "form, masculine, feminine, neuter, plural, pair, inclusive"
ARTICLES = "articles AS " + literal.values(ARTICLE_COLUMNS, fixed.article_rows())
_TXT = rf"""spoken AS (SELECT lower(tok) AS masculine, sum(n) AS n FROM vocabulary WHERE lang = 'de' GROUP BY 1),
pairs AS (SELECT DISTINCT a.pair, s.n FROM articles a JOIN spoken s ON s.masculine = a.masculine WHERE contains(a.pair, '~')),
written AS (SELECT replace(pair, '~', sep) AS written, pair, n FROM pairs CROSS JOIN (VALUES ('*'), ('/'), ('/-'), (':')) v(sep)),
split AS (SELECT *, regexp_extract(written, '^({gender.WORD})(?:/-|[*_:/])({gender.WORD})$', 1) AS a, regexp_extract(written, '^({gender.WORD})(?:/-|[*_:/])({gender.WORD})$', 2) AS b FROM written)"""
PAIRS = q.with_(q.VOCABULARY, ARTICLES, _TGT, _TXT)


def article_frame(spark):
    return literal.frame(spark, ARTICLE_COLUMNS, fixed.article_rows())


def written_pairs(spark, folder):
    """Article pairs in several formats, for the articles the texts use."""
    spoken = vocab(spark, folder, "lang = 'de'").groupBy(F.lower("tok").alias("masculine")).agg(F.sum("n").alias("n"))
    known = article_frame(spark).filter(F.col("pair").contains("~"))
    pairs = spoken.join(known, "masculine").select("pair", "n").distinct()
    separator = F.explode(F.array(*map(F.lit, ("*", "/", "/-", ":")))).alias("sep")
    return pairs.select("*", separator).select(F.expr("replace(pair, '~', sep)").alias("written"), "pair", "n")


@query("f09_split_form", PAIRS + "SELECT written, a AS first, b AS second FROM split")
def f09(spark, folder):
    rows = written_pairs(spark, folder)
    form = F.col("written")
    return rows.select("written", gender.split_form(form, 1).alias("first"), gender.split_form(form, 2).alias("second"))


@query(
    "f10_convert_form",
    PAIRS
    + f"""SELECT written, target, CASE WHEN (a || b) IN (SELECT masculine FROM articles UNION SELECT feminine FROM articles)
        THEN CASE target WHEN 'In' THEN a || '/' || b ELSE a || {_render_sql('b', 'target')} END
        ELSE a || CASE target {" ".join(f"WHEN '{f}' THEN '{s}'" for f, s in gender.PAIR_SEPARATORS.items())} END || b END AS converted
      FROM split CROSS JOIN targets""",
)
def f10(spark, folder):
    articles = article_frame(spark)
    forms = written_pairs(spark, folder).withColumn("target", F.explode(F.array(*map(F.lit, gender.FORMATS))))
    words = articles.select(F.col("masculine").alias("word")).union(articles.select("feminine"))
    converted = gender.convert_pairs(forms, inklusivum.article_pairs(articles), words)
    return converted.select("written", "target", "converted")


@query(
    "j23_article_pair_join",
    PAIRS
    + """SELECT written, k.inclusive, k.grammatical_case FROM split JOIN (
      SELECT list_sort(string_split(pair, '~')) AS key, min(inclusive) AS inclusive, CASE WHEN count(DISTINCT form) = 1 THEN min(form) END AS grammatical_case
      FROM articles WHERE contains(pair, '~') GROUP BY 1) k ON k.key = list_sort([a, b])""",
)
def j23(spark, folder):
    rows = written_pairs(spark, folder)
    parts = F.array(gender.split_form(F.col("written"), 1), gender.split_form(F.col("written"), 2))
    keyed = rows.withColumn("pair_key", F.array_join(F.array_sort(parts), "~"))
    return keyed.join(inklusivum.article_pairs(article_frame(spark)), "pair_key").select("written", "inclusive", "grammatical_case")


# -- inclusive paradigms -----------------------------------------------------

PAIRED = r"""paired AS (
  SELECT tok AS masculine, CASE
      WHEN ends_with(tok, 'erer') THEN left(tok, -2) || 'in' WHEN ends_with(tok, 'ter') THEN left(tok, -1)
      WHEN ends_with(tok, 'e') THEN left(tok, -1) || 'in' WHEN ends_with(tok, 'us') THEN left(tok, -2) || 'a'
      WHEN contains(tok, 'a') AND NOT contains(tok, 'ä') AND ends_with(tok, 't') THEN replace(tok, 'a', 'ä') || 'in'
      ELSE tok || 'in' END AS feminine, n
  FROM vocabulary WHERE lang = 'de' AND regexp_matches(tok, '^[A-ZÄÖÜ][a-zäöü]{3,}$'))"""


def paired(spark, folder):
    """Masculine/feminine pairs derived from the capitalised German words."""
    rows = vocab(spark, folder, "lang = 'de'").filter(F.col("tok").rlike("^[A-ZÄÖÜ][a-zäöü]{3,}$"))
    t = F.col("tok")
    join = lambda stem, ending: F.concat(stem, F.lit(ending))
    feminine = (
        F.when(t.endswith("erer"), join(w.drop_last(t, 2), "in"))
        .when(t.endswith("ter"), w.drop_last(t, 1))
        .when(t.endswith("e"), join(w.drop_last(t, 1), "in"))
        .when(t.endswith("us"), join(w.drop_last(t, 2), "a"))
        .when(t.contains("a") & ~t.contains("ä") & t.endswith("t"), join(F.replace(t, F.lit("a"), F.lit("ä")), "in"))
        .otherwise(join(t, "in"))
    )
    return rows.select(t.alias("masculine"), feminine.alias("feminine"), "n")


_PL = lambda s: f"CASE WHEN ends_with({s}, 're') THEN left({s}, -1) || 'ne' ELSE {s} || 'rne' END"
_SG = lambda s: f"CASE WHEN ends_with({s}, 'e') THEN {s} || 're' ELSE {s} || 'e' END"
_PLAIN = lambda s: f"translate({s}, 'äöüÄÖÜ', 'aouAOU')"
PARADIGM = f"""exceptions AS {literal.values("masculine, ex_singular, ex_plural", fixed.exception_rows())},
neutral AS (SELECT DISTINCT masculine, true AS is_neutral FROM {literal.values("masculine", [(x,) for x in fixed.NEUTRAL_NOUNS])}),
endings AS {literal.values("c, e", [(k, {c: a for c, a, b in fixed.ADJECTIVE_ENDINGS}[v]) for k, v in inklusivum.CASES.items()])},
cells AS (SELECT p.masculine, p.feminine, target, starts_with(target, 'pl') AS is_plural, ex_singular, ex_plural, is_neutral, e,
    CASE target WHEN 'sg_gen' THEN 's' WHEN 'pl_dat' THEN 'n' ELSE '' END AS mark,
    CASE WHEN ends_with(p.masculine, 'us') AND p.feminine = left(p.masculine, -2) || 'a' THEN left(p.masculine, -2)
      WHEN ends_with(p.masculine, 'o') AND p.feminine = left(p.masculine, -1) || 'a' THEN left(p.masculine, -1)
      WHEN ends_with(p.masculine, 'erer') AND p.feminine = left(p.masculine, -2) || 'in' THEN left(p.masculine, -2) ELSE p.masculine END AS base,
    CASE WHEN ends_with(p.feminine, 'in') AND left(p.feminine, -2) <> p.masculine
        AND {_PLAIN("left(p.feminine, -2)")} = {_PLAIN("p.masculine")} AND left(p.feminine, -2) <> {_PLAIN("left(p.feminine, -2)")}
        AND NOT regexp_matches(lower(p.masculine), '({"|".join(fixed.NO_PLURAL_UMLAUT)})$') THEN left(p.feminine, -2) END AS up
  FROM paired p CROSS JOIN (SELECT unnest(['sg_nom', 'sg_acc', 'sg_gen', 'sg_dat', 'pl_nom', 'pl_acc', 'pl_dat', 'pl_gen']) AS target)
  LEFT JOIN exceptions x ON x.masculine = p.masculine LEFT JOIN neutral u ON u.masculine = p.masculine
  LEFT JOIN endings ON c = substr(target, 4)),
paradigms AS (SELECT masculine, feminine, target, CASE
    WHEN ex_singular IS NOT NULL THEN CASE WHEN is_plural THEN ex_plural ELSE ex_singular END || mark
    WHEN ends_with(masculine, 'ling') OR is_neutral THEN masculine
    WHEN ends_with(masculine, 'er') AND feminine = left(masculine, -1) THEN left(masculine, -2) || CASE WHEN is_plural THEN 'en' ELSE e END
    WHEN is_plural THEN {_PL("(" + _SG("coalesce(up, base)") + ")")} || mark ELSE {_SG("base")} || mark END AS form FROM cells)"""


@query("f29_paradigm_generate", q.with_(q.VOCABULARY, PAIRED, PARADIGM) + "SELECT * FROM paradigms")
def f29(spark, folder):
    return inklusivum.paradigm(paired(spark, folder).select("masculine", "feminine"))


@query(
    "f30_paradigm_detect",
    q.with_(q.VOCABULARY, PAIRED, PARADIGM)
    + "SELECT tok, masculine, target FROM vocabulary JOIN paradigms ON form = tok WHERE lang = 'de' AND target IN ('sg_nom', 'sg_gen', 'pl_nom', 'pl_dat')",
)
def f30(spark, folder):
    """Corpus words that are an inclusive form of a pair: an equality join to the
    generated forms instead of undoing endings."""
    wanted = ("sg_nom", "sg_gen", "pl_nom", "pl_dat")
    forms = inklusivum.paradigm(paired(spark, folder).select("masculine", "feminine"), targets=wanted)
    words = vocab(spark, folder, "lang = 'de'").select("tok")
    return words.join(forms, words["tok"] == forms["form"]).select("tok", "masculine", "target")


@query(
    "f27_pair_synthesis",
    q.with_(q.VOCABULARY, PAIRED)
    + """, kinds AS (SELECT masculine AS m, feminine AS f, CASE WHEN regexp_matches(lower(masculine), '(bayer|pommer)$') THEN NULL
        WHEN ends_with(masculine, 'er') AND feminine = masculine || 'in' THEN 'er'
        WHEN ends_with(masculine, 'e') AND feminine = left(masculine, -1) || 'in' THEN 'n'
        WHEN regexp_matches(masculine, '(ist|ent|ant)$') AND feminine = masculine || 'in' THEN 'en' END AS kind FROM paired)
    SELECT m AS masculine, f AS feminine, cell, CASE
        WHEN kind = 'er' THEN m || CASE cell WHEN 'sg_gen' THEN 's' WHEN 'pl_dat' THEN 'n' ELSE '' END
        WHEN cell = 'sg_nom' THEN m ELSE m || kind END AS masculine_form,
      f || CASE WHEN starts_with(cell, 'pl') THEN 'nen' ELSE '' END AS feminine_form
    FROM kinds CROSS JOIN (SELECT unnest(['sg_nom', 'sg_acc', 'sg_gen', 'sg_dat', 'pl_nom', 'pl_acc', 'pl_dat', 'pl_gen']) AS cell) WHERE kind IS NOT NULL""",
)
def f27(spark, folder):
    m, f, cell = F.col("masculine"), F.col("feminine"), F.col("cell")
    kind = (
        F.when(F.lower(m).rlike("(bayer|pommer)$"), F.lit(None).cast("string"))
        .when(m.endswith("er") & (f == F.concat(m, F.lit("in"))), "er")
        .when(m.endswith("e") & (f == F.concat(w.drop_last(m, 1), F.lit("in"))), "n")
        .when(m.rlike("(ist|ent|ant)$") & (f == F.concat(m, F.lit("in"))), "en")
    )
    rows = paired(spark, folder).withColumn("kind", kind).filter("kind IS NOT NULL")
    rows = rows.withColumn("cell", F.explode(F.array(*map(F.lit, inklusivum.TARGETS))))
    regular = F.concat(m, F.when(cell == "sg_gen", "s").when(cell == "pl_dat", "n").otherwise(""))
    weak = F.when(cell == "sg_nom", m).otherwise(F.concat(m, F.col("kind")))
    return rows.select(
        "masculine", "feminine", "cell",
        F.when(F.col("kind") == "er", regular).otherwise(weak).alias("masculine_form"),
        F.concat(f, F.when(cell.startswith("pl"), "nen").otherwise("")).alias("feminine_form"),
    )


_ENDINGS = [(k, g, e) for k, (g, e) in enumerate((g, e) for g, es in fixed.PRIMARY_ENDINGS + fixed.SECONDARY_ENDINGS for e in es.split())]


@query(
    "f26_noun_gender",
    q.with_(q.VOCABULARY, "endings AS " + literal.values("ord, gender, ending", _ENDINGS))
    + """SELECT v.tok, CASE WHEN regexp_matches(v.tok, '(leute|kraft|person)$') THEN 'feminine' ELSE arg_min(e.gender, e.ord) END AS gender
     FROM vocabulary v LEFT JOIN endings e ON ends_with(v.tok, e.ending)
     WHERE v.lang = 'de' AND regexp_matches(v.tok, '^\\p{Lu}') GROUP BY v.tok""".replace("\\\\", "\\"),
)
def f26(spark, folder):
    """By ending, first hit in table order: one chain of conditions, no join."""
    t = F.col("tok")
    found = F.when(t.rlike("(leute|kraft|person)$"), "feminine")
    for group in (fixed.PRIMARY_ENDINGS, fixed.SECONDARY_ENDINGS):
        for gender_name, endings in group:
            found = found.when(t.rlike("(" + "|".join(endings.split()) + ")$"), gender_name)
    rows = vocab(spark, folder, "lang = 'de'").filter(t.rlike(r"^\p{Lu}"))
    return rows.select("tok", found.alias("gender"))


@query(
    "f31_adjective_ending",
    q.with_(q.VOCABULARY, "endings AS " + literal.values("grammatical_case, after_article, bare", fixed.ADJECTIVE_ENDINGS))
    + """SELECT tok, grammatical_case, tok || after_article AS with_article, tok || bare AS without_article
      FROM vocabulary CROSS JOIN endings WHERE lang = 'de' AND ends_with(tok, 'lich')""",
)
def f31(spark, folder):
    rows = vocab(spark, folder, "lang = 'de' AND endswith(tok, 'lich')")
    rows = rows.withColumn("grammatical_case", F.explode(F.array(*[F.lit(c) for c, _, _ in fixed.ADJECTIVE_ENDINGS])))
    case = F.col("grammatical_case")
    return rows.select(
        "tok", "grammatical_case",
        inklusivum.adjective(F.col("tok"), case, True).alias("with_article"),
        inklusivum.adjective(F.col("tok"), case, False).alias("without_article"),
    )


# -- French forms ------------------------------------------------------------

_FRT = "targets AS " + literal.values("target", [(f,) for f, _ in fixed.FRENCH_FORMATS])
_FRW = r"""stems AS (SELECT lower(tok) AS stem, sum(n) AS n FROM vocabulary WHERE lang = 'fr' AND regexp_matches(tok, '^\p{L}{3,}$') GROUP BY 1),
written AS (SELECT stem, stem || ['·', '.', '/'][(length(stem) % 3 + 1)::INT] || ['e', 'es', 'rice', 'euses'][(n % 4 + 1)::INT] AS written FROM stems)"""


def french_written(spark, folder):
    stems = vocab(spark, folder, "lang = 'fr'").filter(F.col("tok").rlike(r"^\p{L}{3,}$"))
    stems = stems.groupBy(F.lower("tok").alias("stem")).agg(F.sum("n").alias("n"))
    pick = lambda options, k: F.element_at(F.array(*map(F.lit, options)), k.cast("int"))
    separator = pick(("·", ".", "/"), F.length("stem") % 3 + 1)
    ending = pick(("e", "es", "rice", "euses"), F.col("n") % 4 + 1)
    return stems.select("stem", F.concat("stem", separator, ending).alias("written"))


@query(
    "f11_convert_french",
    q.with_(q.VOCABULARY, _FRT, _FRW)
    + rf"""SELECT written, target, CASE WHEN known THEN st || left(target, 1) || suffix || CASE WHEN NOT plural THEN ''
        WHEN length(target) > 1 THEN left(target, 1) || 's' ELSE 's' END END AS converted FROM (
      SELECT written, target, regexp_extract(written, '{french.FORM}', 1) AS st, regexp_extract(regexp_extract(written, '{french.FORM}', 3), '{french.ENDING}', 1) AS suffix,
        regexp_extract(regexp_extract(written, '{french.FORM}', 3), '{french.ENDING}', 2) = 's' AS plural,
        regexp_matches(written, '{french.FORM}') AND regexp_matches(regexp_extract(written, '{french.FORM}', 3), '{french.ENDING}') AS known
      FROM written CROSS JOIN targets)""",
)
def f11(spark, folder):
    """Inclusive French forms in every target format; the stem has to be a word
    of the texts, which the semi-join checks."""
    forms = french_written(spark, folder).withColumn("target", F.explode(F.array(*[F.lit(f) for f, _ in fixed.FRENCH_FORMATS])))
    parts = french.read(F.col("written"))
    converted = french.render(parts["stem"], parts["suffix"], parts["plural"], F.col("target"))
    return forms.select("written", "target", converted.alias("converted"))


@query(
    "f34_french_elision",
    q.with_(q.VOCABULARY, "arts AS " + literal.values("article, inclusive", fixed.FRENCH_MASCULINE + fixed.FRENCH_FEMININE))
    + r"""SELECT DISTINCT noun, article, CASE WHEN (ends_with(article, 'le') OR article = 'la')
        AND left(noun, 1) IN ('a','e','i','o','u','h','à','â','ä','é','è','ê','ë','î','ï','ô','ö','ù','û','ü')
        THEN 'l''' || noun ELSE article || ' ' || noun END AS phrase
      FROM (SELECT DISTINCT lower(tok) AS noun FROM vocabulary WHERE lang = 'fr' AND regexp_matches(tok, '^\p{L}')) CROSS JOIN arts""",
)
def f34(spark, folder):
    nouns = vocab(spark, folder, "lang = 'fr'").filter(F.col("tok").rlike(r"^\p{L}")).select(F.lower("tok").alias("noun")).distinct()
    articles = sorted({a for a, _ in fixed.FRENCH_MASCULINE + fixed.FRENCH_FEMININE})
    rows = nouns.withColumn("article", F.explode(F.array(*map(F.lit, articles))))
    return rows.select("noun", "article", french.with_article(F.col("article"), F.col("noun")).alias("phrase"))


# -- texts -------------------------------------------------------------------


@query("f15_privacy_mask", f"SELECT doc_id, {privacy.masked_sql('text')} AS masked FROM documents")
def f15(spark, folder):
    return src.documents(spark, folder).select("doc_id", privacy.mask(F.col("text")).alias("masked"))


@query(
    "f46_plain_answer",
    """SELECT conv_id, turn, CASE WHEN json_valid(j) AND json_type(j) = 'VARCHAR' THEN j ->> '$' ELSE j END AS answer
     FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN to_json(text)::VARCHAR ELSE text END AS j FROM conversations)""",
)
def f46(spark, folder):
    """An answer that came as a JSON string is unwrapped, any other stays."""
    rows = src.table(spark, folder, "conversations")
    quoted = F.get_json_object(F.to_json(F.struct(F.col("text").alias("t"))), "$")
    raw = F.when(F.col("turn") % 2 == 1, F.regexp_extract(quoted, r'^\{"t":(?s)(.*)\}$', 1)).otherwise(F.col("text"))
    unwrapped = F.get_json_object(F.concat(F.lit('{"v":'), F.col("raw"), F.lit("}")), "$.v")
    answer = F.when(F.col("raw").rlike(r'(?s)^".*"$'), F.coalesce(unwrapped, F.col("raw"))).otherwise(F.col("raw"))
    return rows.withColumn("raw", raw).select("conv_id", "turn", answer.alias("answer"))


@query(
    "f47_pseudonym",
    "SELECT c_custkey, left(sha256(lower(c_name)), 16) AS id, md5(c_name || '|' || c_mktsegment) AS config_hash FROM customer",
)
def f47(spark, folder):
    return src.table(spark, folder, "customer").select(
        "c_custkey",
        F.substring(F.sha2(F.lower("c_name"), 256), 1, 16).alias("id"),
        F.md5(F.concat("c_name", F.lit("|"), "c_mktsegment")).alias("config_hash"),
    )


@query(
    "f48_text_degrade",
    q.with_(SENTENCES)
    + r"""SELECT doc_id, sent_no, CASE WHEN len(ws) < 4 THEN sentence ELSE
        array_to_string(ws[1:cut - 1] || [left(ws[cut], greatest(2, length(ws[cut]) * 2 // 3))], ' ') END AS partial
      FROM (SELECT *, greatest(3, len(ws) * 2 // 3)::BIGINT AS cut FROM (
        SELECT doc_id, sent_no, sentence, regexp_extract_all(sentence, '[^ \t\r\n\f\x{b}\x{a0}]+') AS ws FROM sentences))""",
)
def f48(spark, folder):
    """Sentences cut off mid-word, as they are while being typed."""
    rows = sentences(src.documents(spark, folder)).select(
        "doc_id", "sent_no", "sentence",
        F.regexp_extract_all("sentence", F.lit(r"[^ \t\r\n\f\x{b}\x{a0}]+"), F.lit(0)).alias("ws"),
    )
    partial = F.expr(
        "if(size(ws) < 4, sentence, array_join(array_append(slice(ws, 1, cut - 1),"
        " left(ws[cut - 1], greatest(2, cast(length(ws[cut - 1]) * 2 div 3 as int)))), ' '))"
    )
    return rows.withColumn("cut", F.expr("greatest(3, cast(size(ws) * 2 div 3 as int))")).select("doc_id", "sent_no", partial.alias("partial"))


@query(
    "f48_text_degrade_grammar",
    q.with_(SENTENCES)
    + r"""SELECT doc_id, sent_no, array_to_string(ws[1:k] || [ws[k + 2], ws[k + 1]] || ws[k + 3:len(ws)], ' ') AS swapped FROM (
       SELECT *, (1 + ('0x' || left(md5('swap' || sentence), 8))::BIGINT % (len(ws) - 2))::BIGINT AS k FROM (
        SELECT doc_id, sent_no, sentence, regexp_extract_all(sentence, '[^ \t\r\n\f\x{b}\x{a0}]+') AS ws FROM sentences) WHERE len(ws) >= 4)""",
)
def f48g(spark, folder):
    """Two neighbouring words swapped, at a place picked by a hash of the text."""
    rows = sentences(src.documents(spark, folder)).select(
        "doc_id", "sent_no", "sentence",
        F.regexp_extract_all("sentence", F.lit(r"[^ \t\r\n\f\x{b}\x{a0}]+"), F.lit(0)).alias("ws"),
    ).filter(F.size("ws") >= 4)
    pick = F.expr("1 + cast(conv(substring(md5(concat('swap', sentence)), 1, 8), 16, 10) as bigint) % (size(ws) - 2)")
    swapped = F.expr("array_join(concat(slice(ws, 1, k), array(ws[k + 1], ws[k]), slice(ws, k + 3, size(ws))), ' ')")
    return rows.withColumn("k", pick.cast("int")).select("doc_id", "sent_no", swapped.alias("swapped"))
