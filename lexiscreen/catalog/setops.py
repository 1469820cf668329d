"""Set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import external
from ..operators.tokens import tokens, vocabulary
from ..packs import fixed, rules as packs
from ..plans import check
from ..sources import texts as src
from . import sql as q
from .joins import NEAR
from .registry import query
from .spans import EXTERNAL, JUDGED


@query(
    "u01_lookup_union",
    q.with_(q.LEMMAS, q.VOCABULARY)
    + "SELECT lang, form, lemma FROM lemmas UNION SELECT lang, lower(tok), lower(tok) FROM vocabulary WHERE lang = 'fr'",
)
def u01(spark, folder):
    pins = packs.lemmas(spark).select("lang", "form", "lemma")
    nouns = vocabulary(tokens(src.documents(spark, folder).filter("lang = 'fr'")))
    return pins.union(nouns.select("lang", F.lower("tok"), F.lower("tok"))).distinct()


@query(
    "u02_findings_union",
    q.with_(q.RULES, q.LEMMAS, NEAR, EXTERNAL, JUDGED)
    + r"""SELECT doc_id, start::BIGINT AS start, text, 1 AS origin FROM matched
    UNION ALL SELECT doc_id, start::BIGINT, text, 0 FROM judged WHERE reason IS NULL""",
)
def u02(spark, folder):
    """The check's own matches and what is kept of the external ones."""
    docs = src.documents(spark, folder)
    own = check.matched(docs, packs.rules(spark), packs.lemmas(spark))
    external_ = external.judged(docs, external.spelling(docs), external.names(docs)).filter("reason IS NULL")
    shape = lambda df, origin: df.select("doc_id", F.col("start").cast("long").alias("start"), "text", F.lit(origin).alias("origin"))
    return shape(own, 1).unionByName(shape(external_, 0))


@query(
    "u03_number_intersect",
    q.with_(q.VOCABULARY)
    + "SELECT lower(tok) AS form FROM vocabulary WHERE lang = 'en' INTERSECT SELECT lower(tok) FROM vocabulary WHERE lang = 'de'",
)
def u03(spark, folder):
    words = vocabulary(tokens(src.documents(spark, folder)))
    side = lambda lang: words.filter(F.col("lang") == lang).select(F.lower("tok").alias("form"))
    return side("en").intersect(side("de"))


@query(
    "u04_ignore_union",
    """SELECT c_custkey, array_to_string(list_sort(list_distinct([lower(c_mktsegment), 'the', lower(n_name)] || ['the', lower(r_name)])), ',') AS ignored
     FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def u04(spark, folder):
    t = lambda name: src.table(spark, folder, name)
    joined = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    user = F.array(F.lower("c_mktsegment"), F.lit("the"), F.lower("n_name"))
    org = F.array(F.lit("the"), F.lower("r_name"))
    return joined.select("c_custkey", F.array_join(F.array_sort(F.array_union(user, org)), ",").alias("ignored"))


@query(
    "u05_term_merge",
    """SELECT c_custkey, term, coalesce(o.alt, u.alt) AS alt FROM (
      SELECT c_custkey, unnest([lower(c_mktsegment), 'shared']) AS term, unnest(['user:' || c_custkey, 'user']) AS alt, c_nationkey FROM customer) u
     LEFT JOIN (SELECT n_nationkey, 'shared' AS t, 'org:' || n_name AS alt FROM nation WHERE n_nationkey % 2 = 0) o ON o.n_nationkey = u.c_nationkey AND o.t = u.term""",
)
def u05(spark, folder):
    """Terms of the user with those of the organisation on top: a map union in
    which the right side wins."""
    users, orgs = src.table(spark, folder, "customer"), src.table(spark, folder, "nation")
    own = F.create_map(F.lower("c_mktsegment"), F.concat(F.lit("user:"), "c_custkey"), F.lit("shared"), F.lit("user"))
    theirs = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("shared"), F.concat(F.lit("org:"), "n_name")))
    rows = users.join(orgs, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    merged = F.map_concat(own, F.coalesce(theirs, F.create_map().cast("map<string,string>")))
    return rows.select("c_custkey", F.explode(merged).alias("term", "alt"))


@query(
    "u06_inactive_except",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
)
def u06(spark, folder):
    """Rows of inactive parents removed with an anti-join on the parent key."""
    lines = src.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    inactive = src.table(spark, folder, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lines.join(inactive, "l_orderkey", "left_anti")


@query(
    "u08_article_sets",
    q.with_(q.VOCABULARY)
    + f"""SELECT v.lang, lower(v.tok) AS article, sum(v.n)::BIGINT AS n FROM vocabulary v JOIN (
       SELECT unnest({[a for a, _ in fixed.FRENCH_MASCULINE]}) AS art UNION SELECT unnest({[a for a, _ in fixed.FRENCH_FEMININE]}) UNION SELECT unnest({list(fixed.FRENCH_INCLUSIVE)})) a ON a.art = lower(v.tok)
     WHERE v.lang = 'fr' GROUP BY ALL""",
)
def u08(spark, folder):
    every = sorted({a for a, _ in fixed.FRENCH_MASCULINE + fixed.FRENCH_FEMININE} | set(fixed.FRENCH_INCLUSIVE))
    words = tokens(src.documents(spark, folder).filter("lang = 'fr'")).filter(F.lower("tok").isin(*every))
    return words.groupBy("lang", F.lower("tok").alias("article")).agg(F.count("*").alias("n"))
