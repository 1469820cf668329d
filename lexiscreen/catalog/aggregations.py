"""Aggregations: counts, verdicts, counters, paradigms, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as w
from ..operators import guardrail
from ..operators.tokens import tokens, vocabulary
from ..packs import fixed, literal, rules as packs
from ..plans import check, review
from ..sources import texts as src
from . import sql as q
from .joins import NEAR
from .ordered import screening
from .registry import query

# Findings with category, gravity and the number of usable suggestions.
GRADED = """graded AS (SELECT k.*, s.category, s.gravity, s.proficiency_level, coalesce(a.n, 0) AS n_alts, a.names, a.removals
  FROM kept k JOIN severity s ON s.subcategory = k.subcategory
  LEFT JOIN (SELECT doc_id, i, count(DISTINCT coalesce(alt, '')) AS n, bool_or(is_remove) AS removals,
      string_agg(alt, ' / ' ORDER BY pos) FILTER (WHERE NOT is_remove) AS names FROM (
      SELECT k.doc_id, k.i, b.alt, any_value(b.is_remove) AS is_remove, min(b.ord) AS pos FROM kept k
      JOIN best b ON b.rule_id = k.rule_id AND b.number = k.number
      WHERE coalesce(NOT contains(b.alt, '^'), true) AND (b.is_remove OR b.alt IS DISTINCT FROM k.text) GROUP BY k.doc_id, k.i, b.alt)
    GROUP BY doc_id, i) a ON a.doc_id = k.doc_id AND a.i = k.i)"""
LEVEL = """CASE WHEN category = 'corporate_rules' THEN 'corporate_rules' WHEN gravity < 1.5 THEN 'openly_discriminating'
   WHEN gravity <= 2.5 THEN 'basic' WHEN gravity IS NOT NULL THEN 'advanced' END"""
COUNTS = f"""counts AS (SELECT doc_id, level, count(*) AS found FROM (
    SELECT doc_id, 'overall' AS level FROM graded WHERE n_alts > 0 UNION ALL
    SELECT doc_id, {LEVEL} FROM graded WHERE n_alts > 0) WHERE level IS NOT NULL GROUP BY ALL)"""
WORDS = r"""worded AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\r\n\f\x{b}\x{a0}]+')) AS words FROM documents)"""
LIMITS = [("overall", 40, None, 0), ("openly_discriminating", 1, None, 2), ("basic", None, 0.08, 3), ("advanced", 5, 0.5, 4)]
LIMITS_SQL = "limits AS " + literal.values(review.LIMIT_COLUMNS, LIMITS)
VERDICTS = """failing AS (SELECT c.doc_id, string_agg(c.level, ',' ORDER BY l.ord) AS failed_on FROM counts c
    JOIN limits l ON l.level = c.level JOIN worded w ON w.doc_id = c.doc_id
    WHERE coalesce(c.found >= l.max_count, false) OR coalesce(w.words > 0 AND c.found / w.words >= l.max_ratio, false) GROUP BY c.doc_id)"""


def found(spark, folder):
    return check.findings(src.documents(spark, folder), spark)


@query("a01_level_counts", screening() + ",\n" + GRADED + ",\n" + COUNTS + "\nSELECT * FROM counts")
def a01(spark, folder):
    return guardrail.level_counts(found(spark, folder))


@query(
    "a02_threshold_verdict",
    screening() + ",\n" + ",\n".join((GRADED, COUNTS, WORDS, LIMITS_SQL, VERDICTS))
    + "\nSELECT w.doc_id, w.words, CASE WHEN f.failed_on IS NULL THEN 'pass' ELSE 'fail' END AS verdict, f.failed_on FROM worded w LEFT JOIN failing f USING (doc_id)",
)
def a02(spark, folder):
    docs = src.documents(spark, folder)
    words = docs.select("doc_id", w.word_count(F.col("text")).alias("words"))
    counts = guardrail.level_counts(check.findings(docs, spark))
    return guardrail.verdicts(words, counts, review.limits(spark, LIMITS))


@query("a03_word_count", "WITH " + WORDS + " SELECT * FROM worded")
def a03(spark, folder):
    return src.documents(spark, folder).select("doc_id", w.word_count(F.col("text")).alias("words"))


@query(
    "a04_usage_counters",
    """WITH e AS (SELECT event_type AS endpoint, user_id::VARCHAR AS client_user, coalesce(regexp_extract(props, '"k": ?([0-9]+)', 1), 'none') AS origin,
       (event_id % 3)::VARCHAR AS version FROM events)
     SELECT endpoint, version, 'user' AS kind, client_user AS key, count(*) AS n FROM e GROUP BY ALL
     UNION ALL SELECT endpoint, version, 'origin', origin, count(*) FROM e GROUP BY ALL""",
)
def a04(spark, folder):
    """Requests by endpoint, version and user, and by endpoint, version and origin:
    both counters in one pass as grouping sets."""
    e = src.table(spark, folder, "events").select(
        F.col("event_type").alias("endpoint"),
        F.col("user_id").cast("string").alias("client_user"),
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("origin"),
        (F.col("event_id") % 3).cast("string").alias("version"),
    )
    e.createOrReplaceTempView("usage_events")
    return spark.sql(
        """SELECT endpoint, version, if(grouping(client_user) = 0, 'user', 'origin') AS kind,
             if(grouping(client_user) = 0, client_user, origin) AS key, count(*) AS n
           FROM usage_events GROUP BY GROUPING SETS ((endpoint, version, client_user), (endpoint, version, origin))"""
    )


@query(
    "a06_ambiguous_forms",
    q.with_(q.VOCABULARY)
    + """, nouns AS (SELECT tok, n FROM vocabulary WHERE lang = 'de' AND regexp_matches(tok, '^[A-ZÄÖÜ][a-zäöü]{3,}$'))
     SELECT DISTINCT s.form FROM (SELECT tok AS base, tok AS form FROM nouns UNION SELECT tok, tok || 's' FROM nouns) s
     JOIN (SELECT tok AS base, CASE WHEN ends_with(tok, 'er') THEN tok ELSE tok || 'en' END AS form FROM nouns) p ON p.base = s.base AND p.form = s.form""",
)
def a06(spark, folder):
    """Forms that are singular and plural of the same noun, per noun row: both
    columns sets lie in one row, so no join is needed."""
    nouns = vocabulary(tokens(src.documents(spark, folder).filter("lang = 'de'")))
    nouns = nouns.filter(F.col("tok").rlike("^[A-ZÄÖÜ][a-zäöü]{3,}$"))
    singular = F.array(F.col("tok"), F.concat("tok", F.lit("s")))
    plural = F.array(F.when(F.col("tok").endswith("er"), F.col("tok")).otherwise(F.concat("tok", F.lit("en"))))
    return nouns.select(F.explode(F.array_intersect(singular, plural)).alias("form")).distinct()


@query("a07_surface_forms", q.with_(q.TOKENS) + "SELECT DISTINCT lang, lower(tok) AS form FROM tokens WHERE lang <> 'es'")
def a07(spark, folder):
    words = tokens(src.documents(spark, folder).filter("lang <> 'es'"))
    return words.select("lang", F.lower("tok").alias("form")).distinct()


@query(
    "a08_person_words",
    q.with_(q.VOCABULARY) + "SELECT lower(tok) AS word, sum(n)::BIGINT AS n FROM vocabulary WHERE lang = 'de' AND regexp_matches(tok, '(er|erin|ist|ent)$') GROUP BY 1",
)
def a08(spark, folder):
    words = tokens(src.documents(spark, folder).filter("lang = 'de'")).filter(F.col("tok").rlike("(er|erin|ist|ent)$"))
    return words.groupBy(F.lower("tok").alias("word")).agg(F.count("*").alias("n"))


@query(
    "a09_group_keys",
    q.with_(q.RULES, q.LEMMAS, q.TAXONOMY, NEAR)
    + """SELECT coalesce(t.parent, t.key) AS category, min(t.ord)::BIGINT AS ord, max(CASE WHEN t.level IS NOT NULL THEN t.key || '_advanced' END) AS advanced_key, count(*) AS n
     FROM matched m JOIN rules r ON r.rule_id = m.rule_id JOIN taxonomy t ON t.key = regexp_replace(string_split(r.subcategories, '|')[1], '_advanced$', '') GROUP BY 1""",
)
def a09(spark, folder):
    """Categories in first-seen order with the advanced key of their drivers, and
    how many matches fall under them."""
    counts = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    counts = counts.groupBy("subcategories").agg(F.count("*").alias("n"))
    first = F.regexp_replace(F.element_at(F.split("subcategories", r"\|"), 1), "_advanced$", "")
    rows = counts.withColumn("key", first).join(packs.taxonomy(spark), "key")
    advanced = F.when(F.col("level").isNotNull(), F.concat("key", F.lit("_advanced")))
    return rows.groupBy(F.coalesce("parent", "key").alias("category")).agg(
        F.min("ord").cast("long").alias("ord"), F.max(advanced).alias("advanced_key"), F.sum("n").alias("n")
    )


@query(
    "a10_findings_per_doc",
    screening() + "SELECT doc_id, string_agg(rule_id || '@' || start, ' ' ORDER BY start) AS results FROM kept GROUP BY doc_id",
)
def a10(spark, folder):
    """Findings nested per document, in text order."""
    rows = found(spark, folder).select("doc_id", "start", F.concat("rule_id", F.lit("@"), "start").alias("item"))
    nested = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "item"))).alias("r"))
    return nested.select("doc_id", F.array_join(F.transform("r", lambda s: s["item"]), " ").alias("results"))


@query(
    "a11_corpus_summary",
    screening() + ",\n" + GRADED
    + "\nSELECT lang, category, proficiency_level, count(*) AS n, count(DISTINCT doc_id) AS texts FROM graded GROUP BY CUBE (lang, category, proficiency_level)",
)
def a11(spark, folder):
    cube = found(spark, folder).cube("lang", "category", "proficiency_level")
    return cube.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("texts"))


@query(
    "a12_reask_issue_list",
    screening() + ",\n" + GRADED
    + """,\nitems AS (SELECT doc_id, start, n_alts > 0 AS has, CASE WHEN n_alts > 0 THEN '{"issue":"' || text || '","alternatives":[' ||
        CASE WHEN removals THEN '{"remove":true}' ELSE '{"alt":"' || replace(names, ' / ', '"},{"alt":"') || '"}' END || ']}'
       ELSE '{"issue":"' || text || '","alternatives":[],"explanation":"' || explanation || '"}' END AS item FROM graded)
     SELECT doc_id, count(*) FILTER (WHERE has) AS changes, '[' || string_agg(item, ',' ORDER BY NOT has, start) || ']' AS issues FROM items WHERE item IS NOT NULL GROUP BY doc_id""",
)
def a12(spark, folder):
    return guardrail.quoted(found(spark, folder))


@query(
    "a13_note_text",
    screening() + ",\n" + GRADED
    + """\nSELECT doc_id, string_agg('"' || text || '" → ' || coalesce(names, '') || CASE WHEN explanation IS NULL THEN '' ELSE ' (' || explanation || ')' END, '; ' ORDER BY start) AS note
     FROM graded WHERE n_alts > 0 GROUP BY doc_id""",
)
def a13(spark, folder):
    return guardrail.note(found(spark, folder), explain=True)


@query(
    "a14_dedupe_alternatives",
    screening() + ",\n" + GRADED + "\nSELECT rule_id, n_alts::BIGINT AS n_alts, names, count(*) AS n FROM graded GROUP BY ALL",
)
def a14(spark, folder):
    names = F.array_join(F.transform(F.filter("alternatives", lambda a: ~a["is_remove"]), lambda a: a["alt"]), " / ")
    rows = found(spark, folder).select("rule_id", F.size("alternatives").cast("long").alias("n_alts"), F.when(names != "", names).alias("names"))
    return rows.groupBy("rule_id", "n_alts", "names").agg(F.count("*").alias("n"))


@query(
    "a15_case_distinct",
    q.with_(q.VOCABULARY, "articles AS " + literal.values("form, masculine, feminine, neuter, plural, pair, inclusive", fixed.article_rows()))
    + """SELECT s.masculine, s.n, CASE WHEN count(DISTINCT inclusive) = 1 THEN min(inclusive) ELSE min(inclusive) FILTER (WHERE form = 'nominativ') END AS inclusive
     FROM (SELECT lower(tok) AS masculine, sum(n)::BIGINT AS n FROM vocabulary WHERE lang = 'de' GROUP BY 1) s JOIN articles a USING (masculine) GROUP BY ALL""",
)
def a15(spark, folder):
    """The inclusive article of every masculine article the texts use: one form
    where all cases agree, else the nominative."""
    from .scalars import article_frame, vocab

    spoken = vocab(spark, folder, "lang = 'de'").groupBy(F.lower("tok").alias("masculine")).agg(F.sum("n").alias("n"))
    forms = article_frame(spark).groupBy("masculine").agg(
        F.when(F.countDistinct("inclusive") == 1, F.min("inclusive"))
        .otherwise(F.min(F.when(F.col("form") == "nominativ", F.col("inclusive")))).alias("inclusive")
    )
    return spoken.join(forms, "masculine").select("masculine", "n", "inclusive")
