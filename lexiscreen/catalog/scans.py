"""Sources, sinks and format switching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gender
from ..operators import suppress, switch
from ..operators.tokens import tokens
from ..plans import check
from ..sources import conllu, lexicon, markup, sinks, texts as src
from . import sql as q
from .aggregations import GRADED
from .ordered import screening
from .registry import query

_RUN = markup.RUN
RUNS = rf"""runs AS (SELECT page_id, r, k, sum(length(r)) OVER (PARTITION BY page_id ORDER BY k)::BIGINT AS stop, starts_with(r, '<') AND r <> '<' AS is_markup FROM (
   SELECT page_id, unnest(rs) AS r, unnest(range(len(rs))) AS k FROM (SELECT page_id, regexp_extract_all(html, '{_RUN}') AS rs FROM pages)))"""


@query(
    "s06_markup_flatten",
    "WITH " + RUNS
    + r""" SELECT page_id, md5(string_agg(CASE WHEN NOT is_markup THEN r WHEN regexp_matches(r, '(?i)^<(br|/p)') THEN rpad(chr(10), length(r)::INT, ' ') ELSE repeat(' ', length(r)) END, '' ORDER BY k)) AS text_hash, max(stop) AS n FROM runs GROUP BY page_id""",
)
def s06(spark, folder):
    pages = src.spread(src.table(spark, folder, "pages"))
    return markup.flatten(pages).select("page_id", F.md5("text").alias("text_hash"), F.length("text").cast("long").alias("n"))


@query(
    "s02_load_lexicon",
    q.with_(q.VOCABULARY)
    + """SELECT DISTINCT base, form_name, form FROM (SELECT tok AS base, unnest(['sg_gen', 'pl_nom']) AS form_name, unnest([CASE WHEN length(tok) > 4 THEN tok || 's' ELSE '' END, tok || 'en']) AS form FROM vocabulary
      WHERE lang = 'de' AND regexp_matches(tok, '^[A-ZÄÖÜ][a-zäöü]{2,}$')) WHERE form <> ''""",
)
def s02(spark, folder):
    from ..operators.tokens import vocabulary

    words = vocabulary(tokens(src.documents(spark, folder).filter("lang = 'de'"))).filter(F.col("tok").rlike("^[A-ZÄÖÜ][a-zäöü]{2,}$"))
    wide = words.select(
        F.col("tok").alias("base"),
        F.when(F.length("tok") > 4, F.concat("tok", F.lit("s"))).otherwise("").alias("sg_gen"),
        F.concat("tok", F.lit("en")).alias("pl_nom"),
    )
    return lexicon.forms(wide, ["base"], ["sg_gen", "pl_nom"]).distinct()


CONLLU = r"""blocks AS (SELECT conv_id, turn, string_split(text, ' ') AS ws, text FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations) WHERE text <> '')"""


@query(
    "s07_conllu_scan",
    "WITH " + CONLLU
    + """, rows AS (SELECT conv_id, turn, text AS sentence, unnest(ws) AS form, unnest(range(1, len(ws) + 1)) AS k, len(ws) AS size FROM blocks)
     SELECT conv_id, turn, sentence, form, CASE WHEN k = 1 AND size > 2 THEN NULL ELSE CASE WHEN length(form) > 3 THEN 'NOUN' ELSE 'X' END END AS upos FROM rows WHERE NOT (k IN (2) AND size > 2) AND form <> ''""",
)
def s07(spark, folder):
    """The turns, line breaks as blanks, written as treebank blocks (words 1-2 as one multiword range)
    and read back."""
    turns = src.table(spark, folder, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))).filter("text <> ''")
    ws = F.split("text", " ")
    row = lambda w, k: F.concat_ws("\t", k + 1, w, w, F.when(F.length(w) > 3, "NOUN").otherwise("X"))
    rows = F.array_join(F.transform(F.filter(F.transform(ws, lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda s: s["w"] != ""), lambda s: row(s["w"], s["k"])), "\n")
    whole = F.when(F.size(ws) > 2, F.concat(F.lit("1-2\t"), ws[0], F.lit("\t_\t_\n"))).otherwise("")
    block = F.concat(F.lit("# text = "), F.col("text"), F.lit("\n"), whole, rows)
    parsed = conllu.parse(turns.select(F.struct("conv_id", "turn").alias("sent"), block.alias("block")))
    return parsed.select("sent.conv_id", "sent.turn", "sentence", "form", "upos")


@query(
    "s10_rule_db_etl",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey",
)
def s10(spark, folder):
    """Orders as rules, their lines as alternatives: inactive rules go, and with
    them their alternatives."""
    rules = src.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("rule_id"), (F.col("o_orderstatus") != "P").alias("is_active"), F.lit("x").alias("notes")
    )
    lines = src.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("rule_id"), "l_linenumber", "l_quantity")
    return lexicon.active(rules, lines)[1].withColumnRenamed("rule_id", "l_orderkey")


@query(
    "s11_findings_sink",
    screening() + ",\n" + GRADED
    + """\nSELECT doc_id, '{"start":' || start || ',"text":"' || text || '"' || CASE WHEN explanation IS NULL THEN '' ELSE ',"explanation":"' || explanation || '"' END || '}' AS json FROM graded""",
)
def s11(spark, folder):
    return sinks.as_json(check.findings(src.documents(spark, folder), spark), "start", "text", "explanation")


@query(
    "s12_match_sink",
    screening() + ",\n" + GRADED
    + """\nSELECT g.doc_id, coalesce(g.explanation, s.label_en, g.subcategory) AS message, g.start AS "offset", length(g.text) AS length,
      CASE WHEN g.removals THEN '' ELSE coalesce(replace(names, ' / ', '|'), '') END AS replacements,
      substr(d.text, greatest(g.start - 40, 0)::BIGINT + 1, (g.start + length(g.text) + 40 - greatest(g.start - 40, 0))::BIGINT) AS context,
      'SCREEN_' || upper(g.subcategory) AS rule_id, CASE WHEN g.category = 'orthography' THEN 'misspelling' ELSE 'style' END AS issue_type
     FROM graded g JOIN documents d USING (doc_id) JOIN severity s ON s.subcategory = g.subcategory""",
)
def s12(spark, folder):
    docs = src.documents(spark, folder)
    return sinks.as_matches(check.findings(docs, spark), docs)


@query(
    "s13_report_sink",
    screening() + ",\n" + GRADED
    + """,\nlines AS (SELECT doc_id, string_agg('#' || r || ' ' || text || ' (' || category || ', ' || coalesce(proficiency_level, '-') || ')', chr(10) ORDER BY start) AS body, count(*) AS n
       FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS r FROM graded) GROUP BY doc_id)
     SELECT d.doc_id, 'Language: ' || lang || ', issues: ' || coalesce(n, 0) || coalesce(chr(10) || body, '') AS report FROM documents d LEFT JOIN lines USING (doc_id)""",
)
def s13(spark, folder):
    docs = src.documents(spark, folder)
    return sinks.as_report(check.findings(docs, spark), docs)


# -- format switch: the texts with gendered forms put in ---------------------
_PARTS_RE = gender.PARTS
MARKED_SQL = r"regexp_replace(text, '([A-ZÄÖÜ][a-zäöü]{3,})e ', '\1*innen ', 'g')"


def marked(spark, folder):
    """German texts in which every capitalised word in -e carries an ending."""
    text = F.regexp_replace("text", "([A-ZÄÖÜ][a-zäöü]{3,})e ", "$1*innen ")
    return src.documents(spark, folder).filter("lang = 'de'").withColumn("text", text)


@query(
    "c06_mismatch_rules",
    rf"""SELECT doc_id, w AS written, regexp_replace(w, '[*].*$', '') AS stem, 'innen' AS ending, '*in' AS found_format, regexp_replace(w, '[*]', ':') AS converted
     FROM (SELECT doc_id, unnest(regexp_extract_all({MARKED_SQL}, '[A-ZÄÖÜ][a-zäöüß]+\*innen')) AS w FROM documents WHERE lang = 'de')""",
)
def c06(spark, folder):
    return switch.mismatches(marked(spark, folder), ":in")


@query(
    "c04_format_switch",
    rf"SELECT doc_id, md5(regexp_replace({MARKED_SQL}, '([A-ZÄÖÜ][a-zäöüß]+)\*innen', '\1(innen)', 'g')) AS text_hash FROM documents WHERE lang = 'de'",
)
def c04(spark, folder):
    return switch.switch(marked(spark, folder), "()").select("doc_id", F.md5("text").alias("text_hash"))
