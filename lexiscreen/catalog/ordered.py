"""Ordered processing: ranking, greedy selection, neighbours, runs, parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import privacy
from ..operators import guardrail, ranking
from ..operators.tokens import BLANKS, piece_token, sentences, tokens
from ..packs import fixed, literal, rules as packs
from ..plans import check
from ..sources import texts as src
from . import sql as q
from .joins import ENABLED, FP_SQL, NEAR, NUMBER, SENTENCES, TIERS, SEVERITY
from .registry import query

FOUND = FP_SQL + ",\n" + f"""found AS (SELECT * FROM (
    SELECT m.*, e.subcategory, {NUMBER} AS number FROM matched m JOIN enabled e USING (rule_id)
    WHERE NOT (m.lang = 'de' AND m.lemma = 'aber' AND (regexp_matches(right(left5, 5), '^ {{0,5}}$') OR regexp_matches(right(left5, 5), '[.!?:,]\\s{{0,5}}$'))))
  WHERE NOT (pluralization = 'plural_only' AND number = 'singular') AND NOT (pluralization = 'singular_only' AND number = 'plural')),
cleared AS (SELECT f.* FROM found f ANTI JOIN fp ON fp.doc_id = f.doc_id AND fp.i = f.i AND fp.rule_id = f.rule_id),
ranked AS (SELECT * FROM cleared QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY stage,
    CASE WHEN n_words > 1 THEN length(words) ELSE 0 END DESC, rule_word_type DESC, length(words) DESC, lemmatize, rule_id) = 1),
chained AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS chain FROM (
    SELECT *, CASE WHEN i < max(skip) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ranked)),
linked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chain ORDER BY i) AS pos FROM chained),
walk AS (SELECT doc_id, chain, pos, skip AS reach, true AS kept FROM linked WHERE pos = 1
  UNION ALL SELECT l.doc_id, l.chain, l.pos, CASE WHEN l.i >= w.reach THEN l.skip ELSE w.reach END, l.i >= w.reach
  FROM walk w JOIN linked l ON l.doc_id = w.doc_id AND l.chain = w.chain AND l.pos = w.pos + 1),
kept AS (SELECT l.* FROM linked l JOIN walk w ON w.doc_id = l.doc_id AND w.chain = l.chain AND w.pos = l.pos WHERE w.kept)"""
SUGGESTED = TIERS.replace("* EXCLUDE (rule_id_1)", "*").replace("r.rule_id, n.number, a.*", "r.rule_id, n.number, a.ord, a.alt, a.is_remove")
PACKS = (q.RULES, q.LEMMAS, q.ALTERNATIVES, q.FALSE_POSITIVES, q.TAXONOMY, q.LEVELS)


def screening(off: str = "['']") -> str:
    return q.with_(*PACKS, NEAR, ENABLED.format(off=off), SEVERITY, SUGGESTED, FOUND, recursive=True)


@query(
    "w01_rule_rank",
    screening() + "SELECT doc_id, i, rule_id FROM (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY stage,"
    " CASE WHEN n_words > 1 THEN length(words) ELSE 0 END DESC, rule_word_type DESC, length(words) DESC, lemmatize, rule_id) = 1)",
)
def w01(spark, folder):
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    return ranking.best_rule(found).select("doc_id", "i", "rule_id")


@query("w02_greedy_skip", screening() + 'SELECT doc_id, start, start + length(text) AS "end", text, rule_id FROM kept')
def w02(spark, folder):
    return check.findings(src.documents(spark, folder), spark).select("doc_id", "start", "end", "text", "rule_id")


_ARTS = "arts AS " + literal.values("art", [(a,) for a in sorted({x for r in fixed.article_rows() for x in (r[1], r[2], r[3], r[4]) if x} | {a for a, _ in fixed.FRENCH_MASCULINE + fixed.FRENCH_FEMININE} | {"the", "a", "an"})])


def article_words() -> list[str]:
    german = {x for r in fixed.article_rows() for x in r[1:5] if x}
    return sorted(german | {a for a, _ in fixed.FRENCH_MASCULINE + fixed.FRENCH_FEMININE} | {"the", "a", "an"})


@query(
    "w04_previous_article",
    q.with_(q.RULES, q.LEMMAS, NEAR, _ARTS)
    + """SELECT doc_id, i, tok, CASE WHEN lang = 'fr' AND lower(p1) = 'la' AND lower(p2) IN ('de', 'à') THEN p2 || ' ' || p1 ELSE p1 END AS article
    FROM annotated WHERE lower(p1) IN (SELECT art FROM arts)""",
)
def w04(spark, folder):
    words = tokens(src.documents(spark, folder).filter("lang IN ('en', 'de', 'fr')"), prev=2)
    back = lambda k: piece_token(F.try_element_at("prev", F.lit(-k)))
    near = words.select("doc_id", "lang", "i", "tok", back(1).alias("p1"), back(2).alias("p2"))
    near = near.filter(F.lower("p1").isin(*article_words()))
    double = (F.col("lang") == "fr") & (F.lower("p1") == "la") & F.lower("p2").isin("de", "à")
    return near.select("doc_id", "i", "tok", F.when(double, F.concat("p2", F.lit(" "), "p1")).otherwise(F.col("p1")).alias("article"))


_PLURAL = ("viele", "alle", "diese", "many", "these", "les", "des", "die")
_SINGULAR = ("ein", "eine", "der", "das", "the", "a", "un", "une", "le", "la")
_MOD = ("nicht", "very", "très", "für", "that")


@query(
    "w05_determiner_number",
    q.with_(q.TOKENS)
    + f"""SELECT doc_id, i, tok, CASE WHEN l1 IN {_PLURAL} THEN 'plural' WHEN l1 IN {_SINGULAR} THEN 'singular' WHEN l1 NOT IN {_MOD} THEN NULL
        WHEN l2 IN {_PLURAL} THEN 'plural' WHEN l2 IN {_SINGULAR} THEN 'singular' WHEN l2 NOT IN {_MOD} THEN NULL
        WHEN l3 IN {_PLURAL} THEN 'plural' WHEN l3 IN {_SINGULAR} THEN 'singular' END AS number
      FROM (SELECT *, CASE WHEN lag(sent) OVER w = sent THEN lower(lag(tok) OVER w) END AS l1,
         CASE WHEN lag(sent, 2) OVER w = sent THEN lower(lag(tok, 2) OVER w) END AS l2,
         CASE WHEN lag(sent, 3) OVER w = sent THEN lower(lag(tok, 3) OVER w) END AS l3 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i))
      WHERE regexp_matches(tok, '\\p{{Lu}}') AND number IS NOT NULL""".replace("\\\\", "\\"),
)
def w05(spark, folder):
    """Number from the determiner up to three tokens back in the sentence, past
    modifiers only."""
    words = tokens(src.documents(spark, folder), prev=3).filter(F.col("tok").rlike(r"\p{Lu}"))
    number, open_ = F.lit(None).cast("string"), []
    piece = lambda k: F.try_element_at("prev", F.lit(-k))
    # A piece that ends a sentence hides itself and everything before it.
    hidden = lambda k: F.exists(F.slice("prev", F.greatest(F.size("prev") - k + 1, F.lit(1)), F.lit(k)), lambda p: p.rlike(r"^[.!?]|\n"))
    for k in (3, 2, 1):
        word = F.lower(piece_token(piece(k)))
        here = F.when(hidden(k) | piece(k).isNull(), None).when(word.isin(*_PLURAL), "plural").when(word.isin(*_SINGULAR), "singular")
        number = here.when(word.isin(*_MOD), number) if k < 3 else here
    return words.withColumn("number", number).filter("number IS NOT NULL").select("doc_id", "i", "tok", "number")


@query(
    "w07_symbol_runs",
    q.with_(q.TOKENS)
    + r"""SELECT doc_id, min(start)::BIGINT AS start, count(*) AS size, CASE WHEN count(DISTINCT tok) = 1 OR count(*) >= 3 THEN 'ability' ELSE 'ability_advanced' END AS subcategory
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM tokens WHERE regexp_matches(tok, '^[^\p{L}\p{N}_]$'))
    GROUP BY doc_id, island HAVING count(*) >= 2""",
)
def w07(spark, folder):
    """Runs of symbols (emoji and others): the same repeated, or three and more."""
    symbols = tokens(src.documents(spark, folder)).filter(F.col("tok").rlike(r"^[^\p{L}\p{N}_]$"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    runs = symbols.withColumn("island", island).groupBy("doc_id", "island").agg(
        F.min("start").cast("long").alias("start"), F.count("*").alias("size"),
        (F.min("tok") == F.max("tok")).alias("same"),
    )
    kind = F.when(F.col("same") | (F.col("size") >= 3), "ability").otherwise("ability_advanced")
    return runs.filter("size >= 2").select("doc_id", "start", "size", kind.alias("subcategory"))


_SIZE = 200
PARTS = rf"""cuts(doc_id, part_no, part_start, rest, part) AS (
  SELECT doc_id, -1::BIGINT, 0::BIGINT, text, '' FROM source
  UNION ALL SELECT doc_id, part_no + 1, part_start + length(part), substr(rest, cut + 1), left(rest, cut) FROM (
    SELECT *, CASE WHEN length(rest) <= {{size}} THEN length(rest)
        WHEN length(regexp_extract(left(rest, {{size}}), '(?s)^.*(?:[.!?] |\n)')) > {{size}} // 2 THEN length(regexp_extract(left(rest, {{size}}), '(?s)^.*(?:[.!?] |\n)'))
        WHEN contains(left(rest, {{size}}), ' ') THEN length(regexp_extract(left(rest, {{size}}), '(?s)^.* ')) ELSE {{size}} END AS cut
    FROM cuts WHERE rest <> ''))"""


@query(
    "w09_chunk_parts",
    q.with_("source AS (SELECT conv_id || ':' || turn AS doc_id, text FROM conversations WHERE role = 'assistant')", PARTS.format(size=_SIZE), recursive=True)
    + "SELECT doc_id, part_no, part_start, part AS text FROM cuts WHERE part_no >= 0",
)
def w09(spark, folder):
    return guardrail.parts(src.answers(spark, folder), _SIZE, keep=("doc_id",))


@query("w10_sentence_ranges", q.with_(SENTENCES) + 'SELECT doc_id, sent_no, start, "end" FROM sentences')
def w10(spark, folder):
    return sentences(src.documents(spark, folder)).select("doc_id", "sent_no", "start", "end")


@query(
    "w12_doublet",
    q.with_(q.TOKENS)
    + """SELECT doc_id, i, tok AS first, n2 AS second FROM (
      SELECT *, lead(tok) OVER w AS n1, lead(tok, 2) OVER w AS n2 FROM tokens WHERE lang = 'fr' WINDOW w AS (PARTITION BY doc_id ORDER BY i))
      WHERE lower(n1) IN ('et', 'ou') AND regexp_matches(tok, '^\\p{L}+$') AND regexp_matches(n2, '^\\p{L}+$') AND lower(tok) NOT IN ('le', 'la', 'les', 'un', 'une', 'des', 'aux')
        AND lower(n2) NOT IN ('le', 'la', 'les', 'un', 'une', 'des', 'aux')""".replace("\\\\", "\\"),
)
def w12(spark, folder):
    """Two words joined by et/ou without articles: the shape of a doublet."""
    words = tokens(src.documents(spark, folder).filter("lang = 'fr'"), next=2)
    ahead = lambda k: piece_token(F.get("next", F.lit(k - 1)))
    near = words.select("doc_id", "i", F.col("tok").alias("first"), ahead(1).alias("joiner"), ahead(2).alias("second"))
    alpha, arts = r"^\p{L}+$", ("le", "la", "les", "un", "une", "des", "aux")
    shape = F.lower("joiner").isin("et", "ou") & F.col("first").rlike(alpha) & F.col("second").rlike(alpha)
    bare = ~F.lower("first").isin(*arts) & ~F.lower("second").isin(*arts)
    return near.filter(shape & bare).select("doc_id", "i", "first", "second")


PAGE_TOKENS = q.TOKENS.replace("FROM documents", "FROM (SELECT page_id AS doc_id, 'x' AS lang, html AS text FROM pages)")


@query(
    "w13_split_form_end",
    q.with_(PAGE_TOKENS)
    + r"""SELECT doc_id, i, tok, CASE WHEN sep = '(' AND n3 = ')' THEN i + 3 ELSE i + 2 END AS last_i FROM (
      SELECT *, lead(tok) OVER w AS sep, lead(tok, 2) OVER w AS n2, lead(tok, 3) OVER w AS n3 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i))
      WHERE ws = '' AND sep IN ('/', '(') AND regexp_matches(n2, '^[0-9\p{L}]{1,4}$')""",
)
def w13(spark, folder):
    """Word, slash or bracket and a short ending written as separate tokens: the
    index of the last one."""
    pages = src.spread(src.table(spark, folder, "pages")).select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    words = tokens(pages, keep=("doc_id",), next=3)
    ahead = lambda k: piece_token(F.get("next", F.lit(k - 1)))
    near = words.filter("ws = ''").select("doc_id", "i", "tok", ahead(1).alias("sep"), ahead(2).alias("n2"), ahead(3).alias("n3"))
    near = near.filter(F.col("sep").isin("/", "(") & F.col("n2").rlike(r"^[0-9\p{L}]{1,4}$"))
    last = F.when((F.col("sep") == "(") & (F.col("n3") == ")"), F.col("i") + 3).otherwise(F.col("i") + 2)
    return near.select("doc_id", "i", "tok", last.alias("last_i"))


@query(
    "w16_filler_start",
    q.with_(SENTENCES)
    + r"""SELECT doc_id, sent_no, upper(left(rest, 1)) || substr(rest, 2) AS sentence FROM (
      SELECT doc_id, sent_no, regexp_replace(sentence, '^(?:And|Und|Et),? ', '') AS rest FROM sentences WHERE regexp_matches(sentence, '^(?:And|Und|Et),? '))""",
)
def w16(spark, folder):
    opening = r"^(?:And|Und|Et),? "
    rows = sentences(src.documents(spark, folder)).filter(F.col("sentence").rlike(opening))
    rest = F.regexp_replace("sentence", opening, "")
    cap = F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))
    return rows.select("doc_id", "sent_no", cap.alias("sentence"))


@query(
    "w17_context_snippet",
    q.with_(q.RULES, q.LEMMAS, NEAR)
    + f"""SELECT m.doc_id, m.i, m.rule_id, {privacy.masked_sql('substr(d.text, greatest(m.start - 100, 0)::BIGINT + 1, (m.start + length(m.text) + 100 - greatest(m.start - 100, 0))::BIGINT)')} AS context
      FROM matched m JOIN documents d ON d.doc_id = m.doc_id WHERE m.n_words > 1""",
)
def w17(spark, folder):
    """A hundred characters on either side of each multi-word match, masked."""
    docs = src.documents(spark, folder)
    found = check.matched(docs, packs.rules(spark), packs.lemmas(spark)).filter("n_words > 1")
    shown = src.snippets(docs, found.select("doc_id", "i", "rule_id", "start", "end"), 100)
    return shown.select("doc_id", "i", "rule_id", privacy.mask(F.col("context")).alias("context"))
