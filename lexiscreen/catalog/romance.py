"""French nouns and adjectives, and emoji."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, emoji, french
from ..operators.tokens import tokens
from ..packs import fixed, lexicon, literal
from ..sources import texts as src
from . import sql as q
from .grammar import TYPED
from .registry import query

_DEEP = max(len(n[0].split()) for n in lexicon.FRENCH_NOUNS)
_NOUNS = "french_nouns AS " + literal.values(lexicon.FRENCH_NOUN_COLUMNS, lexicon.FRENCH_NOUNS)


def french_texts(spark, folder):
    return src.documents(spark, folder).filter("lang = 'fr'")


@query(
    "f55_french_noun",
    q.with_(q.TOKENS, _NOUNS)
    + r""", said AS (SELECT t.doc_id, t.i, t.tok, lower(regexp_replace(concat_ws('', t.tok, t.ws, p1.piece, p2.piece, p3.piece, p4.piece), '\s+', ' ', 'g')) || ' ' AS phrase FROM tokens t
      LEFT JOIN pieces p1 ON p1.doc_id = t.doc_id AND p1.i = t.i + 1 LEFT JOIN pieces p2 ON p2.doc_id = t.doc_id AND p2.i = t.i + 2
      LEFT JOIN pieces p3 ON p3.doc_id = t.doc_id AND p3.i = t.i + 3 LEFT JOIN pieces p4 ON p4.doc_id = t.doc_id AND p4.i = t.i + 4 WHERE t.lang = 'fr'),
    hits AS (SELECT s.*, n.*, row_number() OVER (PARTITION BY s.doc_id, s.i ORDER BY length(n.base_form) DESC) AS r FROM said s JOIN french_nouns n ON starts_with(s.phrase, lower(n.base_form) || ' '))
    SELECT doc_id, i::INT AS i, tok, base_form, plural, CASE WHEN gender_1 = 'masculine' AND coalesce(gender_2, '') = 'feminine' THEN NULL ELSE female_form END AS female_form, gender_1 FROM hits WHERE r = 1""",
)
def f55(spark, folder):
    """Nouns of the lexicon that begin at a token, the entry with most words first; neutral ones without their unofficial feminine."""
    words = tokens(french_texts(spark, folder), next=2 * _DEEP)
    phrase = F.trim(F.regexp_replace(F.concat("tok", "ws", F.array_join("next", "")), r"\s+", " "))
    words = words.withColumn("phrase", phrase)
    found = french.longest_noun(words, "phrase").filter("base_form IS NOT NULL")
    female = F.when(~french.is_neutral(), F.col("female_form"))
    return found.select("doc_id", "i", "tok", "base_form", "plural", female.alias("female_form"), "gender_1")


#: What is proposed for a noun: a pair of forms, or another noun.
RULE_ALTERNATIVES = [
    ("étudiant", "étudiant~étudiante"), ("directeur", "directeur~directrice"), ("stagiaire", "stagiaire"), ("eau", "directeur~directrice"),
    ("eau", "stagiaire"), ("an", "étudiant motivé~étudiante motivée"), ("an", "client~cliente"), ("aire", "collègue"), ("pas", "responsable~responsablesse"),
]


@query("f40_french_alternatives")
def f40(spark, folder):
    """Proposals for the French nouns of a rule, in both forms, with their article."""
    words = annotate.typed(tokens(french_texts(spark, folder), prev=2)).filter("word_type = 'n'")
    words = french.with_previous_article(words).select("doc_id", "i", "tok", "lemma", "article", F.coalesce("is_plural", F.lit(False)).alias("is_plural"))
    rows = words.join(literal.frame(spark, "lemma, alternative", RULE_ALTERNATIVES), "lemma")
    return french.alternatives(rows).select("doc_id", "i", "tok", "article", "alternative", F.inline("options"))


_FEMININE = "CASE " + " ".join(
    f"WHEN base LIKE '%{e}' THEN left(base, length(base) - {int(n)}) || '{a}'" for e, n, a in (line.split(",") for line in fixed.FRENCH_FEMININE_ENDINGS.strip("\n").splitlines())
) + " END"
_PLURAL = "CASE WHEN regexp_matches({0}, '[sxz]$') THEN {0} WHEN regexp_matches({0}, '(au|eu)$') THEN {0} || 'x' WHEN ends_with({0}, 'al') THEN left({0}, length({0}) - 1) || 'ux' ELSE {0} || 's' END"


@query(
    "f41_french_adjective_rules",
    q.with_(
        q.TOKENS,
        TYPED,
        "adjectives AS (SELECT *, " + _FEMININE + " AS fem FROM " + literal.values("base", [(a,) for a in lexicon.FRENCH_ADJECTIVES]) + ")",
        "four AS (SELECT base, base AS form, false AS plural, 'm' AS g FROM adjectives UNION ALL SELECT base, fem, false, 'f' FROM adjectives UNION ALL SELECT base, "
        + _PLURAL.format("base") + ", true, 'm' FROM adjectives UNION ALL SELECT base, " + _PLURAL.format("fem") + ", true, 'f' FROM adjectives)",
        "forms AS (SELECT base, form, bool_and(plural) AS only_plural, bool_or(plural) AS plural_too FROM four GROUP BY ALL)",
        "known_articles AS " + literal.values("article", [(r[0],) for r in french.article_rows()]),
        "neutral_nouns AS " + literal.values("noun", [(n,) for n in fixed.FRENCH_NEUTRAL_NOUNS]),
    )
    + """, seen AS (SELECT t.doc_id, t.i, t.sent, t.tok, f.base, f.only_plural, f.plural_too, lower(regexp_extract(b1.piece, '^[^ ]*')) IN (SELECT article FROM known_articles) AS behind,
        lower(concat_ws(' ', '', trim(b2.piece), trim(b1.piece), t.tok, trim(n1.piece), trim(n2.piece), '')) AS near
      FROM typed t JOIN forms f ON f.form = lower(t.tok) LEFT JOIN pieces b1 ON b1.doc_id = t.doc_id AND b1.i = t.i - 1 LEFT JOIN pieces b2 ON b2.doc_id = t.doc_id AND b2.i = t.i - 2
      LEFT JOIN pieces n1 ON n1.doc_id = t.doc_id AND n1.i = t.i + 1 LEFT JOIN pieces n2 ON n2.doc_id = t.doc_id AND n2.i = t.i + 2 WHERE t.lang = 'fr'),
    owners AS (SELECT t.doc_id, t.sent, t.i, lower(t.tok) AS noun, lower(t.tok) IN (SELECT noun FROM neutral_nouns) AS neutral, coalesce(t.is_plural, false) AS is_plural FROM typed t
      WHERE t.lang = 'fr' AND (t.word_type = 'n' OR lower(t.tok) IN (SELECT noun FROM neutral_nouns)) AND lower(t.tok) NOT IN (SELECT base FROM adjectives)),
    placed AS (SELECT r.*, coalesce((SELECT arg_max({'noun': noun, 'neutral': neutral, 'plural': neutral OR is_plural}, o.i) FROM owners o WHERE o.doc_id = r.doc_id AND o.sent = r.sent AND o.i <= r.i),
      (SELECT arg_min({'noun': noun, 'neutral': neutral, 'plural': neutral OR is_plural}, o.i) FROM owners o WHERE o.doc_id = r.doc_id AND o.sent = r.sent AND o.i > r.i)) AS owner FROM seen r),
    numbered AS (SELECT *, plural_too AND (only_plural OR coalesce(owner.plural, false)) AS plural FROM placed),
    ruled AS (SELECT s.*, CASE WHEN s.plural THEN 'fr_adjective_rule' WHEN s.behind THEN 'fr_noun_adjective_rule' END AS rule, CASE WHEN s.plural THEN """ + _PLURAL.format("a.base") + """ ELSE a.base END AS male,
      CASE WHEN s.plural THEN """ + _PLURAL.format("a.fem") + """ ELSE a.fem END AS female, (SELECT count(DISTINCT f.g) FROM seen x JOIN four f ON f.form = lower(x.tok) AND f.base = x.base WHERE x.doc_id = s.doc_id AND x.base = s.base) > 1 AS in_both
      FROM numbered s JOIN adjectives a ON a.base = s.base)
    SELECT doc_id, i::INT AS i, tok, rule, CASE WHEN rule IS NOT NULL THEN male || '~' || female END AS alternative, owner.noun AS noun, CASE WHEN rule IS NULL THEN 'no rule' WHEN contains(near, ' ' || male || ' et ' || female || ' ') OR contains(near, ' ' || female || ' et ' || male || ' ') THEN 'pair'
      WHEN plural AND male = female THEN 'one form' WHEN NOT plural AND in_both THEN 'both genders' WHEN plural AND NOT coalesce(owner.neutral, false) THEN 'no neutral noun' END AS reason FROM ruled""",
)
def f41(spark, folder):
    """Adjectives matched by the rules that the texts' own adjectives give."""
    return french.adjective_rules(src.documents(spark, folder))


@query("f42_emoji_alternatives")
def f42(spark, folder):
    """Documents with their signs and what is found about them: suggestions and runs."""
    docs = src.documents(spark, folder)
    every, found = emoji.signs(docs), emoji.findings(docs)
    sums = every.groupBy("doc_id").agg(F.count("*").alias("n_signs")).join(found.groupBy("doc_id").agg(F.count("*").alias("n_findings")), "doc_id", "left")
    return docs.select("doc_id").join(sums, "doc_id", "left").fillna(0)
