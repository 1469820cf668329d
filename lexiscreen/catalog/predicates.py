"""Predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plain, words as w
from ..operators import configs, matching, taxonomy
from ..operators.tokens import tokens, vocabulary
from ..packs import fixed, literal, rules as packs
from ..plans import check
from ..sources import texts as src
from . import sql as q
from .joins import CHECKABLE, ENABLED, NEAR
from .registry import query


@query(
    "p01_truncate_limit",
    """SELECT doc_id, length(text) > 1000 AS limit_reached, md5(CASE WHEN length(text) <= 1000 THEN text
       WHEN contains(left(text, 1000), ' ') THEN regexp_replace(left(text, 1000), ' [^ ]*$', '') ELSE left(text, 1000) END) AS kept FROM documents""",
)
def p01(spark, folder):
    kept, reached = w.truncate(F.col("text"), 1000)
    return src.documents(spark, folder).select("doc_id", reached.alias("limit_reached"), F.md5(kept).alias("kept"))


@query("p02_valid_text", q.with_(q.VOCABULARY) + f"SELECT lang, tok FROM vocabulary WHERE {CHECKABLE}")
def p02(spark, folder):
    rows = vocabulary(tokens(src.documents(spark, folder)))
    return rows.filter(matching.is_checkable(F.col("lang"), F.col("tok"))).select("lang", "tok")


OFF = ["clarity", "titles", "filler_advanced"]


@query(
    "p03_category_enabled",
    q.with_(q.RULES, q.LEMMAS, q.TAXONOMY, NEAR, ENABLED.format(off=str(OFF)))
    + "SELECT m.rule_id, e.subcategory, count(*) AS n FROM matched m JOIN enabled e USING (rule_id) GROUP BY ALL",
)
def p03(spark, folder):
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    counted = found.groupBy("rule_id").agg(F.count("*").alias("n"))
    return counted.join(taxonomy.enabled_subcategory(packs.rules(spark), packs.taxonomy(spark), OFF), "rule_id")


@query(
    "p04_addon_filter",
    q.with_(q.RULES, q.LEMMAS, NEAR) + "SELECT rule_id, count(*) AS n FROM matched WHERE NOT is_hr GROUP BY rule_id",
)
def p04(spark, folder):
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark), addons=["other"])
    return found.groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "p06_camelcase_guard",
    q.with_(q.VOCABULARY)
    + r"""SELECT lang, tok FROM vocabulary WHERE length(regexp_replace(tok, '[^\p{Lu}]', '', 'g')) > 1
      AND length(tok) - length(replace(tok, '-', '')) < length(regexp_replace(tok, '[^\p{Lu}]', '', 'g')) - 1""",
)
def p06(spark, folder):
    return vocabulary(tokens(src.documents(spark, folder))).filter(matching.looks_like_name(F.col("tok"))).select("lang", "tok")


@query(
    "p08_plural_filter",
    q.with_(q.RULES, q.LEMMAS, NEAR)
    + """SELECT rule_id, lemma, count(*) AS n FROM matched WHERE NOT (pluralization = 'plural_only' AND is_plural IS NOT DISTINCT FROM false)
      AND NOT (pluralization = 'singular_only' AND is_plural IS NOT DISTINCT FROM true) AND pluralization <> 'default' GROUP BY ALL""",
)
def p08(spark, folder):
    """Unknown number passes: the comparison is null-safe."""
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    plural_only, singular_only = F.col("pluralization") == "plural_only", F.col("pluralization") == "singular_only"
    kept = found.filter(
        ~(plural_only & F.col("is_plural").eqNullSafe(False)) & ~(singular_only & F.col("is_plural").eqNullSafe(True))
    )
    return kept.filter("pluralization <> 'default'").groupBy("rule_id", "lemma").agg(F.count("*").alias("n"))


@query(
    "p11_formal_pronoun",
    q.with_(q.TOKENS)
    + f"""SELECT doc_id, i, tok, CASE WHEN regexp_matches(tok, '^\\p{{Ll}}') THEN 'informal' WHEN NOT first THEN 'formal' WHEN signals > 1 OR aux THEN 'formal' ELSE 'unknown' END AS kind FROM (
      SELECT *, coalesce(lag(sent) OVER w <> sent, true) AS first, lower(lead(tok) OVER w) IN {tuple(fixed.AUXILIARIES)} AS aux,
        count(*) FILTER (WHERE tok IN {tuple(fixed.FORMAL_WORDS)}) OVER (PARTITION BY doc_id, sent) AS signals
      FROM tokens WHERE lang = 'de' WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE lower(tok) IN ('sie', 'ihr', 'ihre', 'ihnen', 'sich')""".replace("\\\\", "\\"),
)
def p11(spark, folder):
    """Formal or informal address: lower case is informal, a capital inside the
    sentence formal; at its start an auxiliary or a second signal word decides.
    Signals are counted per sentence and joined to the pronouns only."""
    words = tokens(src.documents(spark, folder).filter("lang = 'de'"), prev=1, next=1)
    signals = words.filter(F.col("tok").isin(*fixed.FORMAL_WORDS)).groupBy("doc_id", "sent").agg(F.count("*").alias("signals"))
    pronouns = words.filter(F.lower("tok").isin("sie", "ihr", "ihre", "ihnen", "sich")).join(signals, ["doc_id", "sent"], "left")
    before = F.get("prev", F.lit(0))
    first = before.isNull() | before.rlike(r"^[.!?]|\n|^[ \t]")
    following = F.lower(F.regexp_extract(F.get("next", F.lit(0)), f"^[^{q.BLANKS}]*", 0))
    kind = (
        F.when(F.col("tok").rlike(r"^\p{Ll}"), "informal").when(~first, "formal")
        .when((F.coalesce("signals", F.lit(0)) > 1) | following.isin(*fixed.AUXILIARIES), "formal").otherwise("unknown")
    )
    return pronouns.select("doc_id", "i", "tok", kind.alias("kind"))


@query(
    "p12_gendered_rule_filter",
    q.with_(q.RULES, q.LEMMAS, NEAR)
    + """SELECT rule_id, count(*) AS n FROM matched m WHERE lang <> 'de' OR len(list_filter(string_split(subcategories, '|'), lambda s:
      regexp_replace(s, '_advanced$', '') IN ('titles', 'function', 'gender_identity', 'hidden_image', 'leadership', 'male_stereotype', 'female_stereotype', 'gendered_denominations_ending'))) = 0 GROUP BY rule_id""",
)
def p12(spark, folder):
    gendered = F.array(*map(F.lit, (
        "titles", "function", "gender_identity", "hidden_image", "leadership", "male_stereotype", "female_stereotype",
        "gendered_denominations_ending",
    )))
    keys = F.transform(F.split("subcategories", r"\|"), taxonomy.base_key)
    kept = packs.rules(spark).filter(~((F.col("lang") == "de") & F.arrays_overlap(keys, gendered)))
    found = check.matched(src.documents(spark, folder), kept, packs.lemmas(spark))
    return found.groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "p13_hashtag_case",
    r"""WITH tags AS (SELECT doc_id, '#' || unnest(regexp_extract_all(text, '[\p{L}_]+')) AS tag FROM documents)
    SELECT tag, count(*) AS n FROM tags WHERE regexp_matches(tag, '^#[^\p{Lu}]{5,}$') GROUP BY tag""",
)
def p13(spark, folder):
    """Lower-case tags of five letters and more; the texts have no tags, so each
    word is taken as one."""
    words = src.documents(spark, folder).select(F.explode_outer(F.regexp_extract_all("text", F.lit(r"[\p{L}_]+"), F.lit(0))).alias("word"))
    tag = F.concat(F.lit("#"), F.col("word"))
    return words.select(tag.alias("tag")).filter(F.col("tag").rlike(plain.HASHTAG)).groupBy("tag").agg(F.count("*").alias("n"))


@query(
    "f12_gender_abbreviation",
    """WITH ads AS (SELECT doc_id, lang, ['m/w', 'M/F/X', 'w/m', 'f/m/d', 'm/f/*'][(n_chars % 5 + 1)::INT] AS written FROM documents),
    letters AS (SELECT *, list_transform(list_filter(string_split(upper(written), '/'), lambda x: x NOT IN ('X', 'V')), lambda x: CASE WHEN x = 'W' THEN 'F' ELSE x END) AS l FROM ads),
    joined AS (SELECT *, array_to_string(list_sort(CASE WHEN list_contains(l, 'D') OR list_contains(l, '*') THEN l ELSE l || ['D'] END), '/') AS j FROM letters),
    cased AS (SELECT *, CASE WHEN left(written, 1) = lower(left(written, 1)) THEN lower(j) ELSE j END AS c FROM joined)
    SELECT doc_id, written, CASE WHEN lang = 'de' THEN replace(c, 'f', 'w') ELSE c END AS inclusive FROM cased""",
)
def f12(spark, folder):
    docs = src.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    forms = F.array(*map(F.lit, ("m/w", "M/F/X", "w/m", "f/m/d", "m/f/*")))
    rows = docs.withColumn("written", F.element_at(forms, (F.col("n_chars") % 5 + 1).cast("int")))
    return rows.select("doc_id", "written", plain.abbreviation(F.col("written"), F.col("lang")).alias("inclusive"))


MINIMUM = "minimum AS " + literal.values("client, minimum", [("view", "1.2.0"), ("click", "2.0"), ("error", "0.9.9")])


@query(
    "p15_client_gate",
    "WITH " + MINIMUM
    + """, calls AS (SELECT event_id, event_type AS client, (user_id % 3) || '.' || (event_id % 4) || '.' || (user_id % 2) || CASE WHEN event_id % 7 = 0 THEN '-beta' ELSE '' END AS version FROM events),
    numbered AS (SELECT *, list_transform(string_split(regexp_replace(version, '-.*$', ''), '.'), lambda p: p::INT) AS v,
        list_transform(string_split(minimum, '.'), lambda p: p::INT) AS m FROM calls LEFT JOIN minimum USING (client))
    SELECT event_id, version, minimum IS NULL OR v > m OR (v = m AND NOT contains(version, '-')) AS allowed FROM numbered""",
)
def p15(spark, folder):
    e = src.table(spark, folder, "events")
    beta = F.when(F.col("event_id") % 7 == 0, "-beta").otherwise("")
    version = F.concat_ws(".", F.col("user_id") % 3, F.col("event_id") % 4, F.concat((F.col("user_id") % 2).cast("string"), beta))
    calls = e.select("event_id", F.col("event_type").alias("client"), version.alias("version"))
    minimum = literal.frame(spark, "client, minimum", [("view", "1.2.0"), ("click", "2.0"), ("error", "0.9.9")])
    joined = calls.join(minimum, "client", "left")
    return joined.select("event_id", "version", configs.client_allowed(F.col("client"), F.col("version"), F.col("minimum")).alias("allowed"))


@query(
    "p16_config_changed",
    """SELECT o_orderkey, o.copy IS DISTINCT FROM md5(c_name || c_mktsegment) AS changed FROM (
      SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN md5('Customer#' || o_custkey) END AS copy FROM orders) o
      LEFT JOIN customer ON c_custkey = o_custkey""",
)
def p16(spark, folder):
    orders, users = src.table(spark, folder, "orders"), src.table(spark, folder, "customer")
    copy = F.when(F.col("o_orderkey") % 3 == 1, F.md5(F.concat(F.lit("Customer#"), "o_custkey")))
    stored = users.select("c_custkey", F.md5(F.concat("c_name", "c_mktsegment")).alias("stored"))
    joined = orders.select("o_orderkey", "o_custkey", copy.alias("copy")).join(stored, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", (~F.col("copy").eqNullSafe(F.col("stored"))).alias("changed"))


@query(
    "p19_review_disable",
    f"""SELECT c_custkey, array_to_string(list_sort(list_distinct([lower(c_mktsegment), 'orthography'] || {list(fixed.INCLUSIVE_CATEGORIES)})), ',') AS disabled FROM customer""",
)
def p19(spark, folder):
    own = F.array(F.lower("c_mktsegment"), F.lit("orthography"))
    all_off = F.array_sort(F.array_union(own, F.array(*map(F.lit, fixed.INCLUSIVE_CATEGORIES))))
    return src.table(spark, folder, "customer").select("c_custkey", F.array_join(all_off, ",").alias("disabled"))


@query(
    "p21_access_policy",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN false WHEN 'MACHINERY' THEN true
      ELSE lower(trim(c_name)) IN (SELECT lower(s_name) FROM (SELECT replace(s_name, 'Supplier', 'Customer') AS s_name FROM supplier)) END AS allowed FROM customer""",
)
def p21(spark, folder):
    """Off, on for all, or on for the listed users, by the segment's policy."""
    users = src.table(spark, folder, "customer").withColumn("key", F.lower(F.trim("c_name")))
    listed = src.table(spark, folder, "supplier").select(F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("key"))
    joined = users.join(listed.distinct().withColumn("listed", F.lit(True)), "key", "left")
    allowed = (
        F.when(F.col("c_mktsegment") == "BUILDING", False).when(F.col("c_mktsegment") == "MACHINERY", True)
        .otherwise(F.coalesce("listed", F.lit(False)))
    )
    return joined.select("c_custkey", allowed.alias("allowed"))


_ACCEPTED = [("AUTOMOBILE", "*in"), ("BUILDING", ":in"), ("MACHINERY", "In")]


@query(
    "p22_validate_config",
    "WITH accepted AS " + literal.values("segment, value", _ACCEPTED)
    + """SELECT c_custkey, a.value, a.value IS NOT NULL AND c_acctbal > 0 AS valid FROM customer LEFT JOIN accepted a ON a.segment = c_mktsegment""",
)
def p22(spark, folder):
    """Enum and range checks; what fails is kept apart, not fatal."""
    accepted = literal.frame(spark, "segment, value", _ACCEPTED)
    rows = src.table(spark, folder, "customer").join(accepted, F.col("segment") == F.col("c_mktsegment"), "left")
    return rows.select("c_custkey", "value", (F.col("value").isNotNull() & (F.col("c_acctbal") > 0)).alias("valid"))


@query(
    "p24_debug_defaults",
    """SELECT c_custkey, CASE WHEN list_contains(d, 'none') THEN '' WHEN len(d) = 0 THEN 'plain_language_advanced' ELSE array_to_string(d, ',') END AS disabled FROM (
      SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['none', lower(c_mktsegment)] WHEN 1 THEN []::VARCHAR[] ELSE [lower(c_mktsegment)] END AS d FROM customer)""",
)
def p24(spark, folder):
    own = F.lower("c_mktsegment")
    empty = F.array().cast("array<string>")
    d = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("none"), own)).when(F.col("c_custkey") % 3 == 1, empty).otherwise(F.array(own))
    rows = src.table(spark, folder, "customer").withColumn("d", d)
    shown = F.when(F.array_contains("d", "none"), "").when(F.size("d") == 0, "plain_language_advanced").otherwise(F.array_join("d", ","))
    return rows.select("c_custkey", shown.alias("disabled"))


# -- layered configuration over orders (requests), customers (users), nations --

LAYERS = """requests AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS req_flag,
   CASE o_orderstatus WHEN 'F' THEN ':in' WHEN 'P' THEN '_in' END AS req_ending FROM orders),
layers AS (SELECT r.*, c_acctbal > 0 AS user_flag, c_custkey % 3 = 0 AS user_force, CASE WHEN c_custkey % 4 = 0 THEN 'In' END AS user_ending,
   n_nationkey % 2 = 0 AS org_flag, n_nationkey % 5 = 0 AS org_force, CASE WHEN n_nationkey % 7 = 0 THEN '/in' END AS org_ending
  FROM requests r LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""


def layers(spark, folder):
    key = F.col("o_orderkey")
    requests = src.table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("req_flag"),
        F.when(F.col("o_orderstatus") == "F", ":in").when(F.col("o_orderstatus") == "P", "_in").alias("req_ending"),
    )
    status = lambda forced: F.when(forced, "force").otherwise("suggestion").alias("status")
    record = lambda value, forced: F.struct(value.alias("value"), status(forced))
    users = src.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey",
        record(F.col("c_acctbal") > 0, F.col("c_custkey") % 3 == 0).alias("user_flag"),
        record(F.when(F.col("c_custkey") % 4 == 0, "In"), F.lit(True)).alias("user_ending"),
    )
    orgs = src.table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"),
        record(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") % 5 == 0).alias("org_flag"),
        record(F.when(F.col("n_nationkey") % 7 == 0, "/in"), F.lit(True)).alias("org_ending"),
    )
    return requests.join(users, "o_custkey", "left").join(orgs, "c_nationkey", "left")


_SETTLED = """coalesce(CASE WHEN org_force THEN org_flag END, CASE WHEN user_force THEN user_flag END, req_flag,
   CASE WHEN NOT user_force THEN user_flag END, CASE WHEN NOT org_force THEN org_flag END, {built_in}) AS store_context,
   coalesce(org_ending, user_ending, req_ending, '*in') AS ending"""


@query("j21_config_merge", "WITH " + LAYERS + " SELECT o_orderkey, " + _SETTLED.format(built_in="true") + " FROM layers")
def j21(spark, folder):
    none = F.lit(None).cast("boolean")
    text = F.lit(None).cast("string")
    rows = layers(spark, folder)
    return rows.select(
        "o_orderkey",
        configs.settle_flag(F.col("req_flag"), none, F.col("user_flag"), F.col("org_flag"), F.lit(True), True).alias("store_context"),
        configs.settle_value(F.col("req_ending"), text, F.col("user_ending"), F.col("org_ending"), F.lit("*in")).alias("ending"),
    )


@query(
    "j27_org_config",
    "WITH " + LAYERS + " SELECT o_orderkey, coalesce(org_flag, true) AS store_context, coalesce(org_ending, '*in') AS ending FROM layers",
)
def j27(spark, folder):
    """A run for the organisation alone: its suggestions count as forces."""
    rows = layers(spark, folder)
    return rows.select(
        "o_orderkey", F.coalesce(F.col("org_flag.value"), F.lit(True)).alias("store_context"),
        F.coalesce(F.col("org_ending.value"), F.lit("*in")).alias("ending"),
    )


@query(
    "p23_config_view",
    """SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN n_nationkey END AS organization_id, n_name AS organization_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def p23(spark, folder):
    """The effective record of a user; the organisation's id is hidden for those
    who opted out of analytics."""
    users, orgs = src.table(spark, folder, "customer"), src.table(spark, folder, "nation")
    joined = users.join(orgs, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    org = F.when(F.col("c_acctbal") > 0, F.col("n_nationkey")).alias("organization_id")
    return joined.select("c_custkey", "c_name", org, F.col("n_name").alias("organization_name"))


@query(
    "s15_config_upsert",
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""",
)
def s15(spark, folder):
    """The current record per key of a change log (an `error` event deletes)."""
    log = src.table(spark, folder, "events").select("user_id", "ts", "event_id", "value", (F.col("event_type") == "error").alias("deleted"))
    return configs.latest(log, "user_id").select("user_id", "event_id", "value")


@query(
    "s09_config_source",
    """SELECT e.event_id, coalesce(c_mktsegment, 'default') AS config, coalesce(n_name, 'none') AS organization FROM events e
     LEFT JOIN customer ON c_custkey = e.user_id * 7 LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def s09(spark, folder):
    events = src.table(spark, folder, "events").select("event_id", (F.col("user_id") * 7).alias("c_custkey"))
    joined = events.join(src.table(spark, folder, "customer"), "c_custkey", "left").join(
        src.table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left"
    )
    return joined.select(
        "event_id", F.coalesce("c_mktsegment", F.lit("default")).alias("config"), F.coalesce("n_name", F.lit("none")).alias("organization")
    )
