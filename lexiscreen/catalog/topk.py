"""Orders, limits and top-k reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import langid, matching
from ..operators.tokens import tokens, vocabulary
from ..packs import rules as packs
from ..sources import texts as src
from . import joins, setops, sql as q  # noqa: F401  their queries are read below
from .registry import ORACLES, QUERIES, query


@query(
    "t01_best_form",
    q.with_(q.VOCABULARY)
    + """SELECT lang, form, base FROM (SELECT lang, lower(tok) AS form, tok AS base, row_number() OVER (PARTITION BY lang, lower(tok) ORDER BY (tok = lower(tok)) DESC, length(tok) DESC, tok) AS r
      FROM vocabulary) WHERE r = 1""",
)
def t01(spark, folder):
    """The spelling a form is looked up under: exact first, then the longest.  A
    minimum over a sort key merges before the shuffle, unlike a ranking window."""
    words = vocabulary(tokens(src.documents(spark, folder)))
    key = F.struct((F.col("tok") != F.lower("tok")).alias("a"), (-F.length("tok")).alias("b"), F.col("tok").alias("c"))
    return words.groupBy("lang", F.lower("tok").alias("form")).agg(F.min_by("tok", key).alias("base"))


@query(
    "t02_max_alternatives",
    q.with_(q.VOCABULARY)
    + """SELECT lang, stem, string_agg(tok, ',' ORDER BY n DESC, tok) AS top FROM (SELECT *, left(lower(tok), 3) AS stem, row_number() OVER (PARTITION BY lang, left(lower(tok), 3) ORDER BY n DESC, tok) AS r
      FROM vocabulary) WHERE r <= 5 GROUP BY lang, stem""",
)
def t02(spark, folder):
    """At most five candidates per language and stem.  The limit on the rank is pushed below
    the shuffle, so a hot stem sends five rows per task."""
    words = vocabulary(tokens(src.documents(spark, folder))).withColumn("stem", F.substring(F.lower("tok"), 1, 3))
    order = Window.partitionBy("lang", "stem").orderBy(F.desc("n"), "tok")
    top = words.withColumn("r", F.row_number().over(order)).filter("r <= 5")
    listed = top.groupBy("lang", "stem").agg(F.array_sort(F.collect_list(F.struct("r", "tok"))).alias("t"))
    return listed.select("lang", "stem", F.array_join(F.transform("t", lambda s: s["tok"]), ",").alias("top"))


@query("c10_language_profile", langid.profile_sql())
def c10p(spark, folder):
    return langid.profile(src.documents(spark, folder)).select("lang", "gram", "n")


@query("t03_language_topk", langid.scores_sql())
def t03(spark, folder):
    docs = src.documents(spark, folder)
    return langid.best(langid.scores(docs, langid.profile(docs)))


@query(
    "t06_suffix_order",
    q.with_(q.VOCABULARY)
    + """SELECT tok, regexp_extract(tok, '(trice|rice|ice|euse|se|ière|ère|e)$', 1) AS suffix FROM vocabulary WHERE lang = 'fr' AND regexp_matches(tok, '(trice|rice|ice|euse|se|ière|ère|e)$')""",
)
def t06(spark, folder):
    """Longest suffix first: one alternation ordered by length."""
    suffixes = "(" + "|".join(sorted(("e", "rice", "trice", "ice", "euse", "se", "ère", "ière"), key=lambda s: (-len(s), s))) + ")$"
    words = vocabulary(tokens(src.documents(spark, folder).filter("lang = 'fr'"))).filter(F.col("tok").rlike(suffixes))
    return words.select("tok", F.regexp_extract("tok", suffixes, 1).alias("suffix"))


@query(
    "t08_accept_language",
    """WITH headers AS (SELECT event_id, ['de-CH,de;q=0.9,en;q=0.8', 'es,fr;q=0.5', 'it;q=0.3', 'en;q=0.2,fr;q=0.9', ''][(event_id % 5 + 1)::INT] AS h FROM events),
     items AS (SELECT event_id, unnest(string_split(h, ',')) AS item, generate_subscripts(string_split(h, ','), 1) AS pos FROM headers),
     parsed AS (SELECT event_id, left(lower(trim(item)), 2) AS lang, coalesce(try_cast(nullif(regexp_extract(item, 'q=([0-9.]+)', 1), '') AS DOUBLE), 1.0) AS q, pos FROM items)
     SELECT h.event_id, coalesce(arg_min(p.lang, (-p.q, p.pos)), 'en') AS lang FROM headers h LEFT JOIN parsed p ON p.event_id = h.event_id AND p.lang IN ('en', 'de', 'fr') GROUP BY h.event_id""",
)
def t08(spark, folder):
    """Per access-log row the best supported language of its header; header order
    on ties.  A fold over a short array in the row: nothing is shuffled."""
    headers = F.array(*map(F.lit, ("de-CH,de;q=0.9,en;q=0.8", "es,fr;q=0.5", "it;q=0.3", "en;q=0.2,fr;q=0.9", "")))
    rows = src.table(spark, folder, "events").select("event_id", F.element_at(headers, (F.col("event_id") % 5 + 1).cast("int")).alias("h"))
    weight = lambda item: F.coalesce(F.regexp_extract(item, "q=([0-9.]+)", 1).try_cast("double"), F.lit(1.0))
    options = F.transform(
        F.split("h", ","),
        lambda item, k: F.struct((-weight(item)).alias("q"), k.alias("pos"), F.substring(F.lower(F.trim(item)), 1, 2).alias("lang")),
    )
    best = F.array_min(F.filter(options, lambda o: o["lang"].isin("en", "de", "fr")))
    return rows.select("event_id", F.coalesce(best["lang"], F.lit("en")).alias("lang"))


@query(
    "t04_result_order",
    ORACLES["u02_findings_union"].replace("SELECT doc_id, start::BIGINT AS start, text, 1 AS origin", "SELECT doc_id, start, text, origin, row_number() OVER (PARTITION BY doc_id ORDER BY origin, start, text) AS place FROM (SELECT doc_id, start::BIGINT AS start, text, 1 AS origin", 1)
    + ")",
)
def t04(spark, folder):
    """Findings of a text in the order of a result: matches of other tools first, then by their start."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("origin", "start", "text"))
    return QUERIES["u02_findings_union"](spark, folder).withColumn("place", place)


@query("t05_log_newest", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations")
def t05(spark, folder):
    """A user's log read newest last: the age of every entry, 1 for the newest."""
    turns = src.table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("age"))


@query(
    "t07_substring_order",
    "SELECT lang, tok, rule_id FROM (" + ORACLES["j03_substring_join"].replace("SELECT v.lang, v.tok, v.n, r.rule_id", "SELECT v.lang, v.tok, r.words, r.rule_id")
    + ") QUALIFY row_number() OVER (PARTITION BY lang, tok ORDER BY length(words) DESC, rule_id) = 1",
)
def t07(spark, folder):
    """The substring rule that decides for a word: the longest that is in it, then the first."""
    rules = packs.rules(spark)
    hits = matching.substring_hits(vocabulary(tokens(src.documents(spark, folder))), rules)
    lengths = rules.select("rule_id", F.length("words").alias("size"))
    best = F.max_by("rule_id", F.struct("size", -F.col("rule_id"))).alias("rule_id")
    return hits.join(lengths, "rule_id").groupBy("lang", "tok").agg(best)
