"""Spans against spans: external matches, markup, covered findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import external, suppress, sweep
from ..operators.tokens import BLANKS
from ..packs import fixed, lexicon, literal, rules as packs
from ..plans import check
from ..sources import markup, texts as src
from . import sql as q
from .joins import IN_SCOPE, NEAR
from .registry import query
from .scans import RUNS

EXTERNAL = r"""behind AS (SELECT doc_id, i, lag(piece) OVER (PARTITION BY doc_id ORDER BY i) AS prior FROM pieces),
external AS (
  SELECT arg_min(doc_id, (doc_id, start)) AS doc_id, lang, arg_min(start, (doc_id, start)) AS start, arg_min("end", (doc_id, start)) AS "end", 'SPELL' AS rule_id, 'TYPOS' AS category
    FROM tokens WHERE regexp_matches(tok, '^\p{L}{4,}$') GROUP BY lang, lower(tok) HAVING count(*) = 1
  UNION ALL SELECT doc_id, lang, "end", "end" + length(ws), 'WHITESPACE_RULE', 'TYPOGRAPHY' FROM tokens WHERE length(ws) > 1
  UNION ALL SELECT t.doc_id, lang, start, "end", 'DE_CASE', 'CASING' FROM tokens t JOIN behind b ON b.doc_id = t.doc_id AND b.i = t.i
    WHERE lang = 'de' AND regexp_matches(tok, '^\p{Ll}') AND regexp_matches(prior, '^[.!?]|\n')
  UNION ALL SELECT t.doc_id, lang, start - 1, "end", 'LEERZEICHEN_HINTER_DOPPELPUNKT', 'TYPOGRAPHY' FROM tokens t JOIN behind b ON b.doc_id = t.doc_id AND b.i = t.i
    WHERE lang = 'de' AND prior = ':'),
names AS (SELECT t.doc_id, start, "end", 'PER' AS label FROM tokens t JOIN behind b ON b.doc_id = t.doc_id AND b.i = t.i
    WHERE regexp_matches(tok, '^\p{Lu}\p{Ll}{2,}$') AND lang <> 'de' AND NOT regexp_matches(prior, '^[.!?]|\n|^[ \t]*$')),
crossed AS (SELECT m.doc_id, m.start, m."end", m.rule_id, arg_min(e.label, e.start) AS name FROM external m JOIN names e ON e.doc_id = m.doc_id
    AND ((e.start >= m.start AND e.start < m."end" AND e."end" >= m."end") OR (e.start <= m.start AND e."end" > m.start AND e."end" <= m."end")) GROUP BY ALL)"""


def found(spark, folder):
    docs = src.documents(spark, folder)
    return docs, external.spelling(docs), external.names(docs)


@query(
    "j11_span_overlap",
    q.with_(q.TOKENS, EXTERNAL)
    + """SELECT m.doc_id, m.start::INT AS start, m."end"::INT AS "end", c.name FROM external m LEFT JOIN crossed c
      ON c.doc_id = m.doc_id AND c.start = m.start AND c."end" = m."end" AND c.rule_id = m.rule_id WHERE m.category = 'TYPOS'""",
)
def j11(spark, folder):
    """Spell-check matches with the label of the first name that crosses them."""
    _, matches, names = found(spark, folder)
    typos = matches.filter("category = 'TYPOS'").select("doc_id", "start", "end")
    return sweep.first_crossing(typos, names, "label", "name").select("doc_id", "start", "end", "name")


def _openings(lang: str) -> str:
    words = ", ".join("'" + w.lower().replace("'", "''") + " '" for w in fixed.SALUTATIONS[lang])
    return f"list_min(list_transform(list_filter([{words}], lambda w: contains(line, w)), lambda w: lead + strpos(line, w) - 1 + length(w)))"


_FEMININE = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({n[2] for n in lexicon.FRENCH_NOUNS if n[2]} | {n[0] for n in lexicon.FRENCH_NOUNS if n[3] == "feminine" and not n[4]}))
_LABELS = ", ".join(f"'{x}'" for x in fixed.NAME_LABELS)
_ENDINGS = " OR ".join(f"starts_with(after, '{e}')" for e in fixed.GERMAN_ENDINGS_BEHIND)


#: Needs tokens and what EXTERNAL makes of them.
JUDGED = rf"""lines AS (SELECT doc_id, text, lead, lower(regexp_extract(substr(text, lead + 1), '^[^\n]*')) AS line FROM (
      SELECT doc_id, text, length(regexp_extract(text, '^[{BLANKS}]*')) AS lead FROM documents)),
    first AS (SELECT l.doc_id, l.text, l.lead, l.lead + length(l.line) AS stop, CASE d.lang WHEN 'de' THEN {_openings('de')} WHEN 'en' THEN {_openings('en')} END AS greeted
      FROM lines l JOIN documents d ON d.doc_id = l.doc_id),
    seen AS (SELECT m.*, substr(f.text, m.start + 1, m."end" - m.start) AS text, substr(f.text, greatest(m.start - 10, 0) + 1, m.start - greatest(m.start - 10, 0)) AS before,
      substr(f.text, m."end" + 1, 8) AS after, m.start = 0 OR m."end" <= f.lead AS is_leading, coalesce(f.greeted <= m.start AND m.start <= f.stop, false) AS is_greeted, c.name
      FROM external m JOIN first f ON f.doc_id = m.doc_id LEFT JOIN crossed c ON c.doc_id = m.doc_id AND c.start = m.start AND c."end" = m."end" AND c.rule_id = m.rule_id),
    judged AS (SELECT doc_id, lang, start::INT AS start, "end"::INT AS "end", rule_id, text, CASE
      WHEN rule_id = 'DE_CASE' AND regexp_matches(rtrim(before, ' '), '[\n\t]$') THEN 'line start'
      WHEN rule_id = 'WHITESPACE_RULE' AND is_leading THEN 'leading blanks'
      WHEN category = 'TYPOS' AND regexp_matches(text, '^\p{{Lu}}') AND name IN ({_LABELS}) THEN 'name'
      WHEN category = 'TYPOS' AND is_greeted THEN 'salutation'
      WHEN lang = 'fr' AND text IN ({_FEMININE}) THEN 'feminine noun'
      WHEN lang = 'fr' AND start > 5 AND (right(before, 1) = '·' OR starts_with(text, '·')) THEN 'separator'
      WHEN regexp_matches(text, '^[@#]') OR right(before, 1) IN ('@', '#') THEN 'mention'
      WHEN lang = 'de' AND ({_ENDINGS}) THEN 'gender ending' END AS reason FROM seen)"""


@query("p17_external_matches", q.with_(q.TOKENS, EXTERNAL, JUDGED) + "SELECT * FROM judged")
def p17(spark, folder):
    """Matches of the corpus's own spell checks with the reason to drop each."""
    return external.judged(*found(spark, folder)).drop("category")


@query(
    "p18_category_map",
    q.with_(q.TOKENS, EXTERNAL, q.TAXONOMY)
    + """SELECT m.lang, m.rule_id, CASE WHEN lower(m.category) IN (SELECT key FROM taxonomy) THEN lower(m.category) ELSE 'orthography' END AS subcategory, count(*) AS n FROM external m GROUP BY ALL""",
)
def p18(spark, folder):
    """External matches by what they are reported under."""
    _, matches, _ = found(spark, folder)
    known = [r[0] for r in packs.TAXONOMY]
    return matches.groupBy("lang", "rule_id", external.subcategory(known).alias("subcategory")).agg(F.count("*").alias("n"))


FLAT = (
    RUNS
    + """, flat AS (SELECT page_id AS doc_id, string_agg(CASE WHEN NOT is_markup THEN r WHEN regexp_matches(r, '(?i)^<(br|/p)') THEN rpad(chr(10), length(r)::INT, ' ') ELSE repeat(' ', length(r)) END, '' ORDER BY k) AS text
       FROM runs GROUP BY page_id),
     sources AS (SELECT f.doc_id, f.text, regexp_extract(p.html, 'lang="([a-z]+)"', 1) AS lang FROM flat f JOIN pages p ON p.page_id = f.doc_id)"""
)


@query(
    "j12_markup_anti",
    q.with_(FLAT, q.RULES, q.LEMMAS, NEAR.replace("FROM documents", "FROM sources"))
    + """, marks AS (SELECT page_id AS doc_id, stop - length(r) AS start, stop FROM runs WHERE is_markup)
    SELECT doc_id AS page_id, rule_id, count(*) AS n FROM matched m WHERE NOT EXISTS (SELECT 1 FROM marks k
      WHERE k.doc_id = m.doc_id AND k.start < m.start + length(m.text) AND m.start < k.stop) GROUP BY ALL""",
)
def j12(spark, folder):
    """Rule matches in the text of web pages that cross no markup."""
    pages = src.spread(src.table(spark, folder, "pages"))
    flat = markup.flatten(pages).select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), "text")
    found = check.matched(flat, packs.rules(spark), packs.lemmas(spark)).select("doc_id", "start", "end", "rule_id")
    kept = suppress.without_overlaps(found, markup.spans(pages).withColumnRenamed("page_id", "doc_id"))
    return kept.groupBy(F.col("doc_id").alias("page_id"), "rule_id").agg(F.count("*").alias("n"))


@query(
    "j13_covered_spans",
    q.with_(q.RULES, q.LEMMAS, NEAR)
    + """SELECT t.doc_id, t.i, t.rule_id FROM matched t WHERE t.n_words = 1 AND NOT EXISTS (
      SELECT 1 FROM matched m WHERE m.n_words > 1 AND m.doc_id = t.doc_id AND m.start <= t.start AND t.start + length(t.text) <= m.start + length(m.text))""",
)
def j13(spark, folder):
    """One-word matches that no longer match covers."""
    docs = src.documents(spark, folder).filter(IN_SCOPE)
    found = check.matched(docs, packs.rules(spark), packs.lemmas(spark)).select("doc_id", "i", "rule_id", "start", "end", "n_words")
    return suppress.without_covered(found.filter("n_words = 1"), found.filter("n_words > 1")).select("doc_id", "i", "rule_id")
