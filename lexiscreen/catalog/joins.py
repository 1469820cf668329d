"""Joins: candidates, phrases, lexicons, suppression, configuration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alternatives as alts
from ..operators import matching, suppress, taxonomy
from ..operators.tokens import sentences, tokens, vocabulary
from ..packs import literal, rules as packs
from ..packs.fixed import STANDARD_WORDS
from ..plans import check
from ..sources import texts as src
from . import sql as q
from .registry import query

TEXTS = "en de fr".split()
IN_SCOPE = "lang IN ('en', 'de', 'fr')"

CHECKABLE = r"""(tok = '(' OR (lang = 'en' AND lower(tok) IN ('a', 'i', 'o')) OR (lang = 'fr' AND lower(tok) IN ('a', 'à', 'y'))
  OR (length(tok) > 1 AND regexp_matches(tok, '[\p{L}\p{N}]')))"""

# Neighbourhoods over pieces: a leading blank piece counts as one.
NEAR = q.TOKENS + """,
near AS (
  SELECT * FROM (
    SELECT p.doc_id, p.lang, p.i, t.tok, t.ws, t.start, t."end", t.sent, p.piece,
      lead(t.tok) OVER w AS n1, lead(t.tok, 2) OVER w AS n2, lag(t.tok) OVER w AS p1, lag(t.tok, 2) OVER w AS p2,
      lead(t.ws) OVER w AS w1,
      concat(lag(p.piece, 5) OVER w, lag(p.piece, 4) OVER w, lag(p.piece, 3) OVER w, lag(p.piece, 2) OVER w, lag(p.piece) OVER w) AS left5,
      concat(lead(p.piece) OVER w, lead(p.piece, 2) OVER w, lead(p.piece, 3) OVER w, lead(p.piece, 4) OVER w, lead(p.piece, 5) OVER w) AS right5
    FROM pieces p LEFT JOIN tokens t ON p.doc_id = t.doc_id AND p.i = t.i
    WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.i))
  WHERE tok IS NOT NULL),
annotated AS (
  SELECT n.*, coalesce(l.lemma, n.tok) AS lemma, l.word_type, l.is_plural
  FROM near n LEFT JOIN lemmas l ON l.lang = n.lang AND l.form = lower(n.tok)
  WHERE n.lang IN ('en', 'de', 'fr')),
keyed AS (
  SELECT *, string_split(words, ' ')[1] AS first_token, len(string_split(words, ' ')) AS n_words,
    lower(coalesce(string_split(words, ' ')[2], '')) AS tail, word_type AS rule_word_type
  FROM rules WHERE subcategories <> ''),
candidates AS (
  SELECT a.doc_id, a.lang, a.i, a.tok, a.ws, a.start, a."end" AS tok_end, a.n1, a.w1, a.left5, a.right5, a.lemma, a.is_plural,
    k.rule_id, k.words, k.n_words, k.tail, k.lemmatize, k.rule_word_type, k.pluralization, k.explanation, k.subcategories, k.is_hr
  FROM annotated a JOIN keyed k ON k.lang = a.lang AND k.rtype = 'default'
    AND k.first_token = CASE WHEN k.lower_case THEN lower(CASE WHEN k.lemmatize THEN a.lemma ELSE a.tok END)
      ELSE CASE WHEN k.lemmatize THEN a.lemma ELSE a.tok END END
  WHERE (coalesce(k.word_type, '') = '' OR a.word_type IS NULL OR a.word_type = k.word_type) AND """ + CHECKABLE.replace("(lang", "(a.lang") + r"""),
suffixes AS (
  SELECT a.doc_id, a.lang, a.i, a.tok, a.ws, a.start, a."end" AS tok_end, a.n1, a.w1, a.left5, a.right5, a.lemma, a.is_plural,
    k.rule_id, k.words, k.n_words, k.tail, k.lemmatize, k.rule_word_type, k.pluralization, k.explanation, k.subcategories, k.is_hr
  FROM annotated a JOIN keyed k ON k.lang = a.lang AND k.rtype = 'suffix' AND length(k.first_token) >= 4
    AND ends_with(lower(a.tok), lower(k.first_token))
  WHERE a.lang = 'de' AND length(tok) >= 4 AND (coalesce(k.word_type, '') = '' OR a.word_type IS NULL OR a.word_type = k.word_type)
    AND NOT (length(regexp_replace(tok, '[^\p{Lu}]', '', 'g')) > 1
      AND length(tok) - length(replace(tok, '-', '')) < length(regexp_replace(tok, '[^\p{Lu}]', '', 'g')) - 1)),
matched AS (
  SELECT *, CASE WHEN n_words = 1 THEN tok ELSE tok || ws || n1 END AS text, i + n_words AS skip FROM (
    SELECT *, 1 AS stage FROM candidates WHERE n_words = 1 OR lower(n1) = tail
    UNION ALL SELECT *, 2 AS stage FROM suffixes))"""
BASE = q.with_(q.RULES, q.LEMMAS, NEAR)


def annotated(spark, folder):
    words = tokens(src.documents(spark, folder).filter(IN_SCOPE), **check.window(packs.rules(spark)))
    words = words.filter(matching.is_checkable(F.col("lang"), F.col("tok")))
    return matching.annotate(words, packs.lemmas(spark))


@query("j01_rule_candidates", BASE + "SELECT doc_id, i, tok, rule_id FROM candidates")
def j01(spark, folder):
    found = matching.candidates(annotated(spark, folder), packs.rules(spark).filter("rtype = 'default'"))
    return found.select("doc_id", "i", "tok", "rule_id")


@query("j02_suffix_join", BASE + "SELECT doc_id, i, tok, rule_id FROM suffixes")
def j02(spark, folder):
    found = matching.candidates(annotated(spark, folder), packs.rules(spark).filter("rtype = 'suffix'"))
    return found.select("doc_id", "i", "tok", "rule_id")


_PARTS = "[" + ", ".join(f"'{p}'" for p in STANDARD_WORDS) + "]"


@query(
    "j03_substring_join",
    q.with_(q.RULES, q.VOCABULARY)
    + f"""SELECT v.lang, v.tok, v.n, r.rule_id FROM vocabulary v
      JOIN rules r ON r.lang = v.lang AND r.rtype = 'substring' AND contains(lower(v.tok), lower(r.words))
      WHERE contains(list_reduce([lower(v.tok)] || list_filter({_PARTS}, lambda p: NOT contains(lower(r.words), p)),
        lambda a, p: replace(a, p, '')), lower(r.words))""",
)
def j03(spark, folder):
    words = vocabulary(tokens(src.documents(spark, folder)))
    return matching.substring_hits(words, packs.rules(spark)).select("lang", "tok", "n", "rule_id")


@query("j04_phrase_join", BASE + "SELECT doc_id, start, start + length(text) AS \"end\", text, rule_id FROM matched WHERE n_words > 1")
def j04(spark, folder):
    found = matching.phrase_matches(matching.candidates(annotated(spark, folder), packs.rules(spark)))
    return found.filter("n_words > 1").select("doc_id", "start", "end", "text", "rule_id")


PATTERNS = {"l|article": "article", "l|v": "v"}
PATTERN_SQL = "CASE r.pattern " + " ".join(f"WHEN '{p}' THEN coalesce(l.word_type = '{t}', false)" for p, t in PATTERNS.items()) + " END"


@query(
    "j05_pattern_join",
    q.with_(q.RULES, q.LEMMAS, NEAR)
    + f"""SELECT m.doc_id, m.i, m.rule_id FROM matched m JOIN rules r ON r.rule_id = m.rule_id AND r.pattern IS NOT NULL
    LEFT JOIN lemmas l ON l.lang = m.lang AND l.form = lower(m.n1) WHERE {PATTERN_SQL}""",
)
def j05(spark, folder):
    found = matching.phrase_matches(matching.candidates(annotated(spark, folder), packs.rules(spark)))
    return matching.pattern_matches(found.filter("pattern IS NOT NULL"), packs.lemmas(spark)).select("doc_id", "i", "rule_id")


NUMBER = """CASE WHEN NOT (ends_with(tok, 'e') AND ends_with(lemma, 'er')) AND is_plural THEN 'plural'
   WHEN is_plural = false THEN 'singular' WHEN ends_with(tok, '-') THEN 'plural' ELSE 'unknown' END"""
TIERS = """numbers AS (SELECT unnest(['singular', 'plural', 'unknown']) AS number),
tiers AS (
  SELECT r.rule_id, n.number, a.*, CASE
      WHEN NOT ((n.number = 'singular' AND a.pluralization = 'plural_only') OR (n.number = 'plural' AND a.pluralization = 'singular_only'))
        THEN CASE WHEN a.is_inspiration OR a.is_placeholder THEN 2 ELSE 1 END ELSE 3 END AS tier
  FROM rules r CROSS JOIN numbers n JOIN alternatives a ON a.rule_id = coalesce(r.parent_id, r.rule_id)),
best AS (SELECT * EXCLUDE (rule_id_1) FROM (SELECT *, min(tier) OVER (PARTITION BY rule_id, number) AS top FROM tiers) WHERE tier = top)"""


@query(
    "j06_alternatives_join",
    q.with_(q.RULES, q.LEMMAS, q.ALTERNATIVES, NEAR, TIERS.replace("* EXCLUDE (rule_id_1)", "*").replace("r.rule_id, n.number, a.*", "r.rule_id, n.number, a.ord, a.alt"))
    + f"""SELECT m.rule_id, m.number, coalesce(b.alts, '') AS alts, count(*) AS n
    FROM (SELECT *, {NUMBER} AS number FROM matched) m
    LEFT JOIN (SELECT rule_id, number, string_agg(coalesce(alt, '-'), '|' ORDER BY ord) AS alts FROM best
      WHERE coalesce(NOT contains(alt, '^'), true) GROUP BY ALL) b ON b.rule_id = m.rule_id AND b.number = m.number
    GROUP BY ALL""",
)
def j06(spark, folder):
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    number = check.number_of(F.col("lang"), F.col("tok"), F.col("lemma"), F.col("is_plural"))
    # Count first: the suggestions depend on rule and number only.
    counted = found.withColumn("number", number).groupBy("rule_id", "number").agg(F.count("*").alias("n"))
    table = alts.suggestion_table(packs.rules(spark), packs.alternatives(spark))
    names = F.array_join(F.transform("alternatives", lambda a: F.coalesce(a["alt"], F.lit("-"))), "|")
    joined = counted.join(table, ["rule_id", "number"], "left")
    return joined.select("rule_id", "number", F.coalesce(names, F.lit("")).alias("alts"), "n")


FP_SQL = """fp AS (SELECT m.doc_id, m.i, m.stage, m.rule_id FROM matched m JOIN false_positives f ON f.rule_id = m.rule_id
  WHERE contains(substr(lower(left5 || tok || ws || right5),
      greatest(length(left5) + length(tok) - length(false_positive), 0) + 1,
      length(left5) - greatest(length(left5) + length(tok) - length(false_positive), 0) + length(false_positive)),
    lower(false_positive)))"""


@query(
    "j07_window_false_positives",
    q.with_(q.RULES, q.LEMMAS, q.FALSE_POSITIVES, NEAR, FP_SQL)
    + "SELECT doc_id, i, rule_id, text FROM matched ANTI JOIN fp USING (doc_id, i, rule_id)",
)
def j07(spark, folder):
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    return suppress.without_false_positives(found, packs.false_positives(spark)).select("doc_id", "i", "rule_id", "text")


@query(
    "j10_female_form_probe",
    q.with_(q.VOCABULARY)
    + """SELECT m.lang, m.tok AS masculine, f.tok AS feminine, f.n FROM vocabulary m
    JOIN vocabulary f ON f.lang = 'de' AND f.tok = m.tok || 'in' WHERE m.lang = 'de' AND length(m.tok) >= 3""",
)
def j10(spark, folder):
    words = vocabulary(tokens(src.documents(spark, folder).filter("lang = 'de'")))
    masculine = words.filter("length(tok) >= 3")
    masculine = masculine.select("lang", F.col("tok").alias("masculine"), F.concat("tok", F.lit("in")).alias("tok"))
    return masculine.join(words, ["lang", "tok"]).select("lang", "masculine", F.col("tok").alias("feminine"), "n")


SENTENCES = r"""cut AS (SELECT doc_id, lang, unnest(ss) AS s, unnest(range(len(ss))) AS k
    FROM (SELECT doc_id, lang, regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+') AS ss FROM documents)),
sentences AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sent_no,
    stop - length(ltrim(s)) AS start, stop AS "end", ltrim(s) AS sentence
  FROM (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS stop FROM cut)
  WHERE regexp_matches(s, '[^ \t\r\n\f\x{b}\x{a0}]'))"""


@query(
    "j14_sentence_asof",
    q.with_(q.RULES, q.LEMMAS, NEAR, SENTENCES)
    + """SELECT m.doc_id, m.i, m.rule_id, min(s."end") AS sentence_end FROM matched m JOIN sentences s ON s.doc_id = m.doc_id
      AND s."end" >= m.start + length(m.text) GROUP BY ALL""",
)
def j14(spark, folder):
    """The sentence of a match is the first that ends at or after it: findings
    and sentence ends in one ordered pass, looking forward for the next end."""
    docs = src.documents(spark, folder).filter(IN_SCOPE)
    found = check.matched(docs, packs.rules(spark), packs.lemmas(spark))
    ends = sentences(docs).select("doc_id", F.col("end").alias("at"), F.col("end").alias("stop"), F.lit(1).alias("kind"))
    rows = found.select("doc_id", F.col("end").alias("at"), F.lit(0).alias("kind"), "i", "rule_id")
    both = rows.unionByName(ends, allowMissingColumns=True)
    ahead = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    placed = both.withColumn("sentence_end", F.first("stop", ignorenulls=True).over(ahead))
    return placed.filter("kind = 0 AND sentence_end IS NOT NULL").select("doc_id", "i", "rule_id", "sentence_end")


IGNORED = [("the",), ("die",), ("la",)]


@query(
    "j16_ignore_list",
    q.with_(q.RULES, q.LEMMAS, "ignored AS " + literal.values("text", IGNORED), NEAR)
    + "SELECT rule_id, text, count(*) AS n FROM matched ANTI JOIN ignored USING (text) GROUP BY ALL",
)
def j16(spark, folder):
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    kept = suppress.without_ignored(found, literal.frame(spark, "text", IGNORED))
    return kept.groupBy("rule_id", "text").agg(F.count("*").alias("n"))


@query(
    "j17_gender_pair_in_text",
    q.with_(q.TOKENS)
    + """SELECT doc_id, stem FROM (SELECT DISTINCT doc_id, CASE WHEN ends_with(tok, 'in') THEN left(tok, length(tok) - 2) ELSE tok END AS stem,
       ends_with(tok, 'in') AS feminine FROM tokens WHERE lang = 'de' AND length(tok) >= 4)
     GROUP BY ALL HAVING count(*) = 2""".replace("GROUP BY ALL", "GROUP BY doc_id, stem"),
)
def j17(spark, folder):
    """Words that occur in both genders in one text; findings on them are dropped."""
    words = tokens(src.documents(spark, folder).filter("lang = 'de'")).filter("length(tok) >= 4")
    feminine = F.col("tok").endswith("in")
    stem = F.when(feminine, F.expr("left(tok, length(tok) - 2)")).otherwise(F.col("tok"))
    pairs = words.groupBy("doc_id", stem.alias("stem")).agg(F.bool_or(feminine).alias("f"), F.bool_and(feminine).alias("all_f"))
    return pairs.filter("f AND NOT all_f").select("doc_id", "stem")


@query(
    "j18_pair_adjacency",
    q.with_(NEAR.split(",\nannotated AS")[0])
    + """SELECT doc_id, i, tok, n2 AS partner FROM near WHERE lang = 'fr' AND lower(n1) IN ('et', 'ou', '/')
      AND left(lower(tok), 2) = left(lower(n2), 2) AND lower(tok) <> lower(n2) AND length(tok) > 2""",
)
def j18(spark, folder):
    words = tokens(src.documents(spark, folder).filter("lang = 'fr'"), next=2)
    nxt = lambda k: F.regexp_extract(F.get("next", F.lit(k - 1)), f"^[^{q.BLANKS}]*", 0)
    near = words.select("doc_id", "i", "tok", nxt(1).alias("joiner"), nxt(2).alias("partner"))
    return near.filter(
        F.lower("joiner").isin("et", "ou", "/")
        & (F.substring(F.lower("tok"), 1, 2) == F.substring(F.lower("partner"), 1, 2))
        & (F.lower("tok") != F.lower("partner"))
        & (F.length("tok") > 2)
    ).select("doc_id", "i", "tok", "partner")


@query(
    "j19_source_join",
    q.with_(q.RULES, q.LEMMAS, q.SOURCES, NEAR)
    + """SELECT m.rule_id, s.citation, s.url, count(*) AS n FROM matched m JOIN rules r ON r.rule_id = m.rule_id
     LEFT JOIN (SELECT * FROM sources WHERE is_citation_shown) s ON s.source_id = r.source_id GROUP BY ALL""",
)
def j19(spark, folder):
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    shown = packs.sources(spark).filter("is_citation_shown")
    counted = found.groupBy("rule_id", "source_id").agg(F.count("*").alias("n"))
    return counted.join(shown, "source_id", "left").select("rule_id", "citation", "url", "n")


SEVERITY = """severity AS (
  SELECT key || adv AS subcategory, coalesce(parent, key) AS category, icon, label_en, label_de,
    CASE WHEN level IS NULL THEN CASE WHEN parent = 'orthography' THEN 'orthography' END
      WHEN level = 'openly_discriminating' THEN level WHEN inclusive THEN 'inclusive' ELSE 'unconscious_bias' END AS proficiency_level,
    CASE WHEN key = 'corporate_rules' AND adv = '' THEN 0.9 WHEN inclusive THEN NULL WHEN level IS NULL AND coalesce(parent <> 'orthography', true) THEN 2.0
      WHEN level IS NULL OR level = 'openly_discriminating' THEN 1.0 WHEN adv <> '' THEN 3.0 ELSE 2.0 END::DOUBLE AS gravity
  FROM taxonomy LEFT JOIN levels USING (level) CROSS JOIN (VALUES (''), ('_advanced')) v(adv))"""
ENABLED = """enabled AS (
  SELECT rule_id, arg_min(subcategory, pos) AS subcategory FROM (
    SELECT rule_id, unnest(string_split(subcategories, '|')) AS subcategory, generate_subscripts(string_split(subcategories, '|'), 1) AS pos FROM rules) s
  JOIN taxonomy t ON t.key = regexp_replace(s.subcategory, '_advanced$', '')
  WHERE NOT list_contains({off}, subcategory) AND coalesce(NOT list_contains({off}, t.parent), true) GROUP BY rule_id)"""


@query(
    "j20_taxonomy_join",
    q.with_(q.RULES, q.LEMMAS, q.TAXONOMY, q.LEVELS, NEAR, SEVERITY, ENABLED.format(off="['']"))
    + """SELECT m.lang, s.category, e.subcategory, s.proficiency_level, s.gravity, s.icon,
      coalesce(CASE WHEN m.lang = 'de' THEN label_de END, label_en) AS label, count(*) AS n
    FROM matched m JOIN enabled e USING (rule_id) JOIN severity s ON s.subcategory = e.subcategory GROUP BY ALL""",
)
def j20(spark, folder):
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    counted = found.groupBy("lang", "rule_id").agg(F.count("*").alias("n"))
    rows = counted.join(taxonomy.enabled_subcategory(packs.rules(spark), packs.taxonomy(spark), []), "rule_id")
    rows = rows.join(taxonomy.severity(packs.taxonomy(spark), packs.levels(spark)), "subcategory")
    label = F.coalesce(F.when(F.col("lang") == "de", F.col("label_de")), F.col("label_en")).alias("label")
    keys = ["lang", "category", "subcategory", "proficiency_level", "gravity", "icon", label]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


@query(
    "j24_rewrite_retry",
    q.with_(q.VOCABULARY, "spelling AS " + literal.values(packs.US_COLUMNS, packs.US_SPELLING))
    + """SELECT v.tok, coalesce(s.us, v.tok) AS retried, v.n FROM vocabulary v LEFT JOIN spelling s ON s.uk = lower(v.tok)
      WHERE v.lang = 'en' AND (s.us IS NOT NULL OR lower(v.tok) IN ('the', 'and'))""",
)
def j24(spark, folder):
    words = vocabulary(tokens(src.documents(spark, folder).filter("lang = 'en'")))
    spelling = literal.frame(spark, packs.US_COLUMNS, packs.US_SPELLING)
    joined = words.join(spelling, F.lower("tok") == F.col("uk"), "left")
    kept = joined.filter(F.col("us").isNotNull() | F.lower("tok").isin("the", "and"))
    return kept.select("tok", F.coalesce("us", "tok").alias("retried"), "n")
