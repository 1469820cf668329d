"""Lexicon lookups, inflection, alternatives, guidance and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import privacy, words as w
from ..operators import context, edits, matching, suppress
from ..operators.tokens import BLANKS, aligned, piece_token, sentences, tokens
from ..packs import fixed, literal, rules as packs
from ..plans import check
from ..session import checkpoint_dir
from ..sources import lexicon, texts as src
from . import sql as q
from .joins import CHECKABLE, NEAR
from .registry import query
from .scalars import GENDERED, PAIRED, gendered, paired, vocab

NOUN = "^[A-ZÄÖÜ][a-zäöü]{2,}$"
FORMS = f"""nouns AS (SELECT tok AS base FROM vocabulary WHERE lang = 'de' AND regexp_matches(tok, '{NOUN}')),
forms AS (SELECT base, unnest(['sg_nom', 'sg_gen', 'pl_nom']) AS form_name, unnest([base, base || 's', base || 'en']) AS form FROM nouns)"""


def form_table(spark, folder):
    """Declension rows of the nouns the texts use, unpivoted."""
    nouns = vocab(spark, folder, "lang = 'de'").filter(F.col("tok").rlike(NOUN)).select(F.col("tok").alias("base"))
    wide = nouns.select(
        "base", F.col("base").alias("sg_nom"), F.concat("base", F.lit("s")).alias("sg_gen"), F.concat("base", F.lit("en")).alias("pl_nom")
    )
    return lexicon.forms(wide, ["base"], ["sg_nom", "sg_gen", "pl_nom"])


@query(
    "j09_declension_lookup",
    q.with_(q.VOCABULARY, FORMS)
    + """SELECT tok, base FROM (SELECT v.tok, f.base, row_number() OVER (PARTITION BY v.tok ORDER BY (f.base = v.tok) DESC, length(f.base) DESC, f.base) AS r
      FROM (SELECT DISTINCT tok FROM vocabulary WHERE lang = 'de') v JOIN forms f ON lower(f.form) = lower(v.tok)) WHERE r = 1""",
)
def j09(spark, folder):
    words = vocab(spark, folder, "lang = 'de'").select("tok", F.lower("tok").alias("key"))
    forms = form_table(spark, folder).select("base", F.lower("form").alias("key"))
    rank = F.struct((F.col("base") != F.col("tok")).alias("a"), (-F.length("base")).alias("b"), F.col("base").alias("c"))
    return words.join(forms, "key").groupBy("tok").agg(F.min_by("base", rank).alias("base"))


@query(
    "f25_noun_lookup",
    q.with_(q.VOCABULARY)
    + f"""SELECT tok, arg_min(tail, k) AS tail, left(tok, min(k)::BIGINT - 1) AS prefix FROM (
      SELECT v.tok, k, n.base AS tail FROM (SELECT tok, unnest(range(3, length(tok) - 2)) AS k FROM vocabulary WHERE lang = 'de' AND regexp_matches(tok, '^[A-ZÄÖÜ][a-zäöü]{{6,}}$')) v
      JOIN (SELECT tok AS base FROM vocabulary WHERE lang = 'de' AND regexp_matches(tok, '^[A-ZÄÖÜ][a-zäöü]{{3,}}$')) n ON lower(n.base) = substr(v.tok, k)) GROUP BY tok""",
)
def f25(spark, folder):
    """Compounds by their longest known tail of four letters or more.  Tails are
    unfolded per distinct word and joined by equality."""
    nouns = vocab(spark, folder, "lang = 'de'").select("tok")
    known = nouns.filter(F.col("tok").rlike("^[A-ZÄÖÜ][a-zäöü]{3,}$")).select(F.lower("tok").alias("tail_key"), F.col("tok").alias("tail"))
    starts = F.sequence(F.lit(3), F.length("tok") - 3)
    tails = nouns.filter(F.col("tok").rlike("^[A-ZÄÖÜ][a-zäöü]{6,}$")).select("tok", F.explode(starts).alias("k"))
    tails = tails.withColumn("tail_key", F.substring("tok", F.col("k"), F.length("tok")))
    best = tails.join(known, "tail_key").groupBy("tok").agg(F.min(F.struct("k", "tail")).alias("b"))
    return best.select("tok", F.col("b.tail").alias("tail"), F.substring("tok", F.lit(1), F.col("b.k") - 1).alias("prefix"))


_PREFIX = """list_max(list_filter(range(0, length(masculine) + 1), lambda k: k <= length(feminine) AND left(masculine, k) = left(feminine, k)))"""
INCLUSIVE = f"""pref AS (SELECT *, CASE WHEN ends_with(masculine, 'mann') OR contains(masculine, 'ä') <> contains(feminine, 'ä') THEN 0 ELSE {_PREFIX} END AS p FROM paired),
inclusive AS (SELECT masculine, feminine, CASE WHEN length(masculine) - p > 2 THEN feminine || '*' || masculine
   WHEN length(feminine) >= length(masculine) THEN left(masculine, p) || '*' || substr(feminine, p + 1) ELSE left(masculine, p) || '*' || substr(masculine, p + 1) END AS form FROM pref)"""


def inclusive_nouns(spark, folder):
    rows = paired(spark, folder).select("masculine", "feminine")
    m, f = F.col("masculine"), F.col("feminine")
    prefix = F.when(m.endswith("mann"), "").otherwise(w.common_prefix(m, f, False, False))
    rows = rows.withColumn("_p", prefix)
    size, star = F.length("_p"), F.lit("*")
    rest = lambda c: F.substring(c, size + 1, F.length(c))
    form = (
        F.when(F.length(m) - size > 2, F.concat(f, star, m))
        .when(F.length(f) >= F.length(m), F.concat("_p", star, rest(f)))
        .otherwise(F.concat("_p", star, rest(m)))
    )
    return rows.withColumn("form", form).drop("_p")


@query("f13_inclusive_noun", q.with_(q.VOCABULARY, PAIRED, INCLUSIVE) + "SELECT masculine, feminine, form FROM inclusive")
def f13(spark, folder):
    return inclusive_nouns(spark, folder)


@query(
    "f39_gendered_alternatives",
    q.with_(q.VOCABULARY, PAIRED, INCLUSIVE)
    + """SELECT masculine, 'inclusive_gender' AS role, form AS alternative FROM inclusive UNION ALL SELECT masculine, 'binary_gender', feminine || ' und ' || masculine FROM inclusive
      UNION ALL SELECT masculine, 'collective', masculine || 'schaft' FROM inclusive WHERE ends_with(masculine, 'er')""",
)
def f39(spark, folder):
    """Inclusive, binary and collective variants of a pair, unfolded in the row."""
    rows = inclusive_nouns(spark, folder)
    variant = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("alternative"))
    collective = F.when(F.col("masculine").endswith("er"), variant("collective", F.concat("masculine", F.lit("schaft"))))
    variants = F.array_compact(F.array(
        variant("inclusive_gender", F.col("form")),
        variant("binary_gender", F.concat("feminine", F.lit(fixed.CONJUNCTIONS[0][2]), "masculine")),
        collective,
    ))
    return rows.select("masculine", F.inline(variants))


@query(
    "j25_star_retry",
    GENDERED.rstrip() + f""", tries AS (SELECT written, stem || ending AS plain, stem FROM written)
    SELECT t.written, coalesce(d.tok, r.tok, s.tok) AS hit, CASE WHEN d.tok IS NOT NULL THEN 1 WHEN r.tok IS NOT NULL THEN 2 ELSE 3 END AS tier FROM tries t
    LEFT JOIN (SELECT tok FROM vocabulary WHERE lang = 'de') d ON d.tok = t.written LEFT JOIN (SELECT tok FROM vocabulary WHERE lang = 'de') r ON r.tok = t.plain
    LEFT JOIN (SELECT tok FROM vocabulary WHERE lang = 'de') s ON s.tok = t.stem""",
)
def j25(spark, folder):
    """A written form without a hit is retried without its separator, then as
    its stem; the first tier that hits is kept."""
    rows = gendered(spark, folder).withColumn("plain", F.concat("stem", "ending"))
    words = vocab(spark, folder, "lang = 'de'").select("tok")
    probes = F.array(*[F.struct(F.lit(k).alias("tier"), F.col(c).alias("tok")) for k, c in ((1, "written"), (2, "plain"), (3, "stem"))])
    tries = rows.select("written", F.explode(probes).alias("p")).select("written", "p.*")
    best = tries.join(words, "tok").groupBy("written").agg(F.min(F.struct("tier", "tok")).alias("b"))
    return best.select("written", F.col("b.tok").alias("hit"), F.col("b.tier").alias("tier"))


#: Rules whose words are harmless in some sentences.
CONTEXT_RULES = (6, 12, 44)


@query("j15_context_check")
def j15(spark, folder):
    """Findings without those of context-dependent rules whose sentence the model clears.  A learned model has no plain-SQL
    counterpart."""
    docs = src.documents(spark, folder)
    model = context.train(docs, src.table(spark, folder, "labels"))
    found = check.findings(docs, spark).select("doc_id", "start", "end", "rule_id", "text")
    return context.cleared(found, docs, model, CONTEXT_RULES, least=0.2)


@query(
    "j22_term_rules",
    q.with_(q.TOKENS)
    + """SELECT t.doc_id, t.start::INT AS start, t.tok, n.n_name AS alternative FROM tokens t JOIN nation n ON n.n_nationkey = t.doc_id % 25
      AND lower(t.tok) = ['the', 'der', 'le', 'and', 'of'][(n.n_nationkey % 5 + 1)::INT] AND (n.n_nationkey % 2 = 0 OR t.lang = 'en')""",
)
def j22(spark, folder):
    """Each tenant's own terms, some restricted to a language."""
    terms = src.table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("config_id"),
        F.element_at(F.array(*map(F.lit, ("the", "der", "le", "and", "of"))), F.col("n_nationkey") % 5 + 1).alias("term"),
        F.when(F.col("n_nationkey") % 2 != 0, "en").alias("only"), F.col("n_name").alias("alternative"),
    )
    words = tokens(src.documents(spark, folder)).withColumn("config_id", F.col("doc_id") % 25).withColumn("term", F.lower("tok"))
    joined = words.join(terms, ["config_id", "term"]).filter("only IS NULL OR only = lang")
    return joined.select("doc_id", "start", "tok", "alternative")


@query(
    "j26_gold_align",
    q.with_(q.TOKENS)
    + rf""", gold AS (SELECT doc_id, w, stop - length(w) - length(b) AS start FROM (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS stop FROM (
        SELECT doc_id, p, k, regexp_extract(p, '^[^{BLANKS}]*') AS w, regexp_extract(p, '[{BLANKS}]*$') AS b FROM (
          SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^{BLANKS}]+[{BLANKS}]*|[{BLANKS}]+') AS ps FROM documents)))) WHERE w <> '')
      SELECT t.doc_id, t.i, g.w AS gold FROM tokens t JOIN gold g ON g.doc_id = t.doc_id AND g.start = t.start AND length(g.w) = length(t.tok)""",
)
def j26(spark, folder):
    """Two tokenisations of the same texts paired where start and end agree.

    A text whose id no other has is paired with itself where it is read; rows that share an id meet by it."""
    docs = src.documents(spark, folder)
    # Written, so that its size is known: mostly nothing, and then no text is shuffled.
    path = f"{checkpoint_dir(spark).rstrip('/')}/repeated-{uuid.uuid4().hex}"
    docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id").write.parquet(path)
    repeated = spark.read.schema(T.StructType([docs.schema["doc_id"]])).parquet(path)
    alone = aligned(docs.filter("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti"))
    shared = docs.join(repeated, "doc_id", "left_semi")
    gold = tokens(shared, keep=("doc_id",), words_only=True).select("doc_id", "start", "end", F.col("tok").alias("gold"))
    met = tokens(shared, keep=("doc_id",)).join(gold, ["doc_id", "start", "end"]).select("doc_id", "i", "gold")
    return alone.select("doc_id", "i", F.col("word").alias("gold")).unionAll(met)


@query(
    "w11_article_agreement",
    q.with_(q.TOKENS)
    + r"""SELECT doc_id, i, noun, CASE WHEN regexp_matches(before, '^\p{L}{5,}$') THEN 'genitiv plural' ELSE 'nominativ singular' END AS reading FROM (
      SELECT doc_id, i, tok, lead(tok) OVER w AS noun, coalesce(lag(tok) OVER w, '') AS before FROM tokens WHERE lang = 'de' WINDOW w AS (PARTITION BY doc_id ORDER BY i))
      WHERE lower(tok) = 'der' AND regexp_matches(noun, '^\p{L}{5,}$')""",
)
def w11(spark, folder):
    """`der` before a noun: a genitive only where it is attached to a noun before
    it.  Without annotations a word of five letters or more stands for a noun."""
    words = tokens(src.documents(spark, folder).filter("lang = 'de'"), prev=1, next=1).filter(F.lower("tok") == "der")
    is_noun = lambda piece: piece_token(piece).rlike(r"^\p{L}{5,}$")
    noun = F.get("next", F.lit(0))
    attached = F.coalesce(is_noun(F.get("prev", F.lit(0))), F.lit(False))
    reading = F.when(attached, "genitiv plural").otherwise("nominativ singular")
    return words.filter(is_noun(noun)).select("doc_id", "i", piece_token(noun).alias("noun"), reading.alias("reading"))


@query(
    "w14_separable_verb",
    q.with_(q.TOKENS)
    + """, verbs AS (SELECT * FROM (VALUES ('ist', 'zu'), ('und', 'auf'), ('die', 'an'), ('sich', 'ein')) v(form, particle))
     SELECT t.doc_id, t.i, v.particle, max(p.i)::INT AS particle_i FROM tokens t JOIN verbs v ON v.form = lower(t.tok)
     JOIN tokens p ON p.doc_id = t.doc_id AND p.sent = t.sent AND lower(p.tok) = v.particle WHERE t.lang = 'de' GROUP BY ALL HAVING max(p.i) > t.i""",
)
def w14(spark, folder):
    """A verb linked to the last particle of its sentence.  Particles are reduced
    to one row per sentence before the join, so the join never fans out."""
    words = tokens(src.documents(spark, folder).filter("lang = 'de'"))
    verbs = literal.frame(spark, "form, particle", [("ist", "zu"), ("und", "auf"), ("die", "an"), ("sich", "ein")])
    low = words.withColumn("low", F.lower("tok"))
    heads = low.join(verbs, F.col("low") == F.col("form")).select("doc_id", "sent", "i", "particle")
    particles = low.filter(F.col("low").isin("zu", "auf", "an", "ein")).groupBy("doc_id", "sent", F.col("low").alias("particle")).agg(F.max("i").alias("particle_i"))
    return heads.join(particles, ["doc_id", "sent", "particle"]).filter("particle_i > i").select("doc_id", "i", "particle", "particle_i")


@query(
    "p07_entity_filter",
    q.with_(q.RULES, q.LEMMAS, NEAR)
    + r"""SELECT rule_id, count(*) AS n FROM matched m WHERE NOT (regexp_matches(tok, '^\p{Lu}') AND left5 <> '' AND NOT regexp_matches(left5, '(?s)([.!?][ \n]*|\n)$')) GROUP BY rule_id""",
)
def p07(spark, folder):
    """Matches on words that are names by shape (a capital inside a sentence)
    are dropped."""
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    before = F.array_join("prev", "")
    name = F.col("tok").rlike(r"^\p{Lu}") & (before != "") & ~before.rlike(r"(?s)([.!?][ \n]*|\n)$")
    return found.filter(~name).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "p10_clause_start_guard",
    q.with_(q.RULES, q.LEMMAS, NEAR)
    + r"""SELECT doc_id, i, tok, lower(tok) = 'aber' AND (regexp_matches(right(left5, 5), '^ {0,5}$') OR regexp_matches(right(left5, 5), '[.!?:,]\s{0,5}$')) AS is_ignored FROM annotated
      WHERE lang = 'de' AND lower(tok) IN ('aber', 'und', 'oder')""",
)
def p10(spark, folder):
    """German conjunctions; of them `aber` is left alone at the start of a sentence or clause."""
    words = tokens(src.documents(spark, folder).filter("lang = 'de'"), prev=5).filter(F.lower("tok").isin("aber", "und", "oder"))
    return words.select("doc_id", "i", "tok", ((F.lower("tok") == "aber") & check.at_clause_start()).alias("is_ignored"))


@query(
    "f21_is_upper",
    q.with_(q.RULES, q.LEMMAS, NEAR)
    + r"""SELECT rule_id, regexp_matches(text, '^\p{Lu}') AND (regexp_matches(words, '^\p{Ll}') OR regexp_matches(right(left5, 5), '^ {0,5}$') OR regexp_matches(right(left5, 5), '[ \n]{3,5}$')
       OR regexp_matches(right(left5, 5), CASE WHEN lang = 'de' THEN '[.!?:][ \n]{0,5}$' ELSE '[.!?][ \n]{0,5}$' END)) AS is_upper, count(*) AS n FROM matched GROUP BY ALL""",
)
def f21(spark, folder):
    """Whether suggestions are capitalised for a match."""
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    before = F.expr("right(array_join(slice(prev, greatest(size(prev) - 4, 1), 5), ''), 5)")
    start = F.when(F.col("lang") == "de", before.rlike(r"[.!?:][ \n]{0,5}$")).otherwise(before.rlike(r"[.!?][ \n]{0,5}$"))
    opened = before.rlike(r"^ {0,5}$") | before.rlike(r"[ \n]{3,5}$") | start
    upper = F.col("text").rlike(r"^\p{Lu}") & (F.col("words").rlike(r"^\p{Ll}") | opened)
    return found.groupBy("rule_id", upper.alias("is_upper")).agg(F.count("*").alias("n"))


@query(
    "f43_resolve_locale",
    """SELECT doc_id, CASE WHEN two IN ('de-DE', 'de-CH', 'de-AT', 'en-US', 'en-GB', 'fr-FR') THEN two WHEN lang IN ('de', 'en', 'fr') THEN CASE lang WHEN 'de' THEN 'de-DE' WHEN 'en' THEN 'en-US' ELSE 'fr-FR' END END AS locale
     FROM (SELECT doc_id, lang, lang || '-' || ['CH', 'AT', 'GB', 'XX'][(doc_id % 4 + 1)::INT] AS two FROM documents)""",
)
def f43(spark, folder):
    """`de-CH-x-simple` to a supported locale: the first two subtags, else the
    default locale of the language."""
    code = F.concat_ws("-", "lang", F.element_at(F.array(*map(F.lit, ("CH", "AT", "GB", "XX"))), (F.col("doc_id") % 4 + 1).cast("int")), F.lit("x"), F.lit("simple"))
    two, one = F.substring_index(code, "-", 2), F.substring_index(code, "-", 1)
    default = F.create_map(*map(F.lit, ("de", "de-DE", "en", "en-US", "fr", "fr-FR")))
    locale = F.when(two.isin("de-DE", "de-CH", "de-AT", "en-US", "en-GB", "fr-FR"), two).otherwise(F.try_element_at(default, one))
    return src.table(spark, folder, "documents").select("doc_id", locale.alias("locale"))


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


GUIDE_DE = fixed.GUIDANCE + "\n" + fixed.GUIDANCE_GERMAN.format("Lehrer*in") + "\n" + fixed.GUIDANCE_FRENCH.format("étudiant·e")


@query(
    "f45_merge_guidance",
    f"""WITH firsts AS (SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS turn FROM conversations GROUP BY conv_id)
    SELECT c.conv_id, c.turn, c.role, md5(CASE WHEN c.turn = f.turn AND f.role = 'system' AND NOT contains(c.text, {_lit(GUIDE_DE)}) THEN c.text || chr(10) || chr(10) || {_lit(GUIDE_DE)} ELSE c.text END) AS text_hash
    FROM conversations c JOIN firsts f USING (conv_id) UNION ALL SELECT conv_id, -1, 'system', md5({_lit(GUIDE_DE)}) FROM firsts WHERE role <> 'system'""",
)
def f45(spark, folder):
    """Guidance added to the system turn, or in a new one ahead.  The first turn
    comes from an aggregate, so a very long conversation is never one group."""
    turns = src.table(spark, folder, "conversations")
    firsts = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("f"))
    firsts = firsts.select("conv_id", F.col("f.turn").alias("first_turn"), F.col("f.role").alias("first_role"))
    guide = F.lit(GUIDE_DE)
    merge = (F.col("turn") == F.col("first_turn")) & (F.col("first_role") == "system") & ~F.col("text").contains(guide)
    text = F.when(merge, F.concat("text", F.lit("\n\n"), guide)).otherwise(F.col("text"))
    kept = turns.join(firsts, "conv_id").select("conv_id", "turn", "role", F.md5(text).alias("text_hash"))
    added = firsts.filter("first_role <> 'system'").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.md5(guide).alias("text_hash"))
    return kept.unionByName(added)


@query(
    "f49_config_options",
    "WITH labels_ AS " + literal.values("fmt, lang, label", fixed.FORMAT_LABELS)
    + """ SELECT c_custkey, fmt, coalesce(l.label, e.label) AS label, left(fmt, -2) AS separator FROM (
      SELECT c_custkey, ['en', 'de', 'fr'][(c_nationkey % 3 + 1)::INT] AS lang, CASE WHEN c_custkey % 2 = 0 THEN '*in' ELSE '_in' END AS fmt FROM customer) c
     LEFT JOIN labels_ l USING (fmt, lang) LEFT JOIN (SELECT fmt, label FROM labels_ WHERE lang = 'en') e USING (fmt)""",
)
def f49(spark, folder):
    """Label of each user's format in their language, English where there is
    none, and its separator."""
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), F.col("c_nationkey") % 3 + 1)
    users = src.table(spark, folder, "customer").select("c_custkey", lang.alias("lang"), F.when(F.col("c_custkey") % 2 == 0, "*in").otherwise("_in").alias("fmt"))
    labels = literal.frame(spark, "fmt, lang, label", fixed.FORMAT_LABELS)
    english = labels.filter("lang = 'en'").select("fmt", F.col("label").alias("fallback"))
    joined = users.join(labels, ["fmt", "lang"], "left").join(english, "fmt", "left")
    return joined.select("c_custkey", "fmt", F.coalesce("label", "fallback").alias("label"), w.drop_last(F.col("fmt"), 2).alias("separator"))


@query(
    "f50_redact_event",
    """SELECT event_id, 'k=' || regexp_replace(regexp_extract(props, '"k": ?([0-9]+)', 1), '[0-9]+', '<NUMBER>', 'g') || ';page_index=' || user_id || ';url=<URL>' AS props FROM events""",
)
def f50(spark, folder):
    """Credentials dropped, the query string cut, other values masked; values
    under `_index` stay."""
    e = src.table(spark, folder, "events")
    raw = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("authorization"), F.lit("secret"), F.lit("page_index"), F.col("user_id").cast("string"), F.lit("url"), F.lit("https://example.org/a?token=1")),
    )
    kept = F.map_filter(raw, lambda k, v: ~k.isin("authorization", "cookie", "x-api-key"))
    clean = F.transform_values(kept, lambda k, v: F.when(k.endswith("_index") | k.endswith("_form"), v).otherwise(privacy.mask(F.regexp_replace(v, r"\?.*$", ""))))
    entries = F.array_sort(F.transform(F.map_entries(clean), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return e.select("event_id", F.array_join(entries, ";").alias("props"))


TAG = r"""CASE WHEN regexp_matches(tok, '^[0-9]+$') THEN 'cardinal' WHEN NOT valid THEN 'invalid-text' WHEN word_type = 'article' THEN 'article-list'
   WHEN word_type IS NOT NULL THEN word_type WHEN lang = 'de' AND regexp_matches(tok, '^\p{Lu}') AND ends_with(tok, '-') THEN 'dash-noun'
   WHEN lang = 'de' AND regexp_matches(tok, '^\p{Lu}') THEN 'noun' ELSE 'no-match' END"""


def tagged(spark, folder):
    """Word type by the first branch that fires, and which branch that was."""
    words = matching.annotate(tokens(src.documents(spark, folder)), packs.lemmas(spark))
    tok, lang = F.col("tok"), F.col("lang")
    branch = (
        F.when(tok.rlike("^[0-9]+$"), "cardinal").when(~matching.is_checkable(lang, tok), "invalid-text")
        .when(F.col("word_type") == "article", "article-list").when(F.col("word_type").isNotNull(), F.col("word_type"))
        .when((lang == "de") & tok.rlike(r"^\p{Lu}") & tok.endswith("-"), "dash-noun")
        .when((lang == "de") & tok.rlike(r"^\p{Lu}"), "noun").otherwise("no-match")
    )
    return words.withColumn("branch", branch)


TAGGED = q.with_(q.LEMMAS, q.TOKENS) + f""", tagged AS (SELECT *, {TAG} AS branch FROM (SELECT t.*, l.word_type, {CHECKABLE.replace("(lang", "(t.lang")} AS valid
   FROM tokens t LEFT JOIN lemmas l ON l.lang = t.lang AND l.form = lower(t.tok)))"""


@query("f23_word_type", TAGGED + "SELECT doc_id, i, branch FROM tagged")
def f23(spark, folder):
    return tagged(spark, folder).select("doc_id", "i", "branch")


@query(
    "a05_branch_stats",
    TAGGED
    + """, per_word AS (SELECT lang, branch, tok, count(*) AS n FROM tagged GROUP BY ALL)
     SELECT lang, branch, sum(n)::BIGINT AS fires, round(sum(n) / sum(sum(n)) OVER (PARTITION BY lang), 6) AS share, string_agg(tok, ' ' ORDER BY n DESC, tok) FILTER (WHERE r <= 5) AS examples
     FROM (SELECT *, row_number() OVER (PARTITION BY lang, branch ORDER BY n DESC, tok) AS r FROM per_word) GROUP BY lang, branch""",
)
def a05(spark, folder):
    """Per branch how often it fires, its share, and its five commonest words.
    Words are counted before anything is ranked, and the rank limit is pushed
    below the shuffle."""
    per_word = tagged(spark, folder).groupBy("lang", "branch", "tok").agg(F.count("*").alias("n"))
    fires = per_word.groupBy("lang", "branch").agg(F.sum("n").alias("fires"))
    share = F.round(F.col("fires") / F.sum("fires").over(Window.partitionBy("lang")), 6)
    order = Window.partitionBy("lang", "branch").orderBy(F.desc("n"), "tok")
    top = per_word.withColumn("r", F.row_number().over(order)).filter("r <= 5").groupBy("lang", "branch").agg(F.array_sort(F.collect_list(F.struct("r", "tok"))).alias("t"))
    examples = F.array_join(F.transform("t", lambda s: s["tok"]), " ")
    return fires.withColumn("share", share).join(top, ["lang", "branch"]).select("lang", "branch", "fires", "share", examples.alias("examples"))


@query("c08_word_edits")
def c08(spark, folder):
    """Edit script from each sentence to its masked version."""
    docs = src.documents(spark, folder)
    pairs = sentences(docs).select(
        F.concat_ws("-", "doc_id", "sent_no").alias("doc_id"), F.col("sentence").alias("before"), privacy.mask(F.col("sentence")).alias("after")
    )
    return edits.word_edits(pairs)


@query(
    "c09_rephrase_drafts",
    q.with_(q.RULES, q.LEMMAS, q.ALTERNATIVES, NEAR)
    + """SELECT m.doc_id, m.i, a.ord, left5 || '[' || a.alt || ']' || CASE WHEN n_words = 1 THEN m.ws ELSE coalesce(w1, '') END AS draft FROM matched m JOIN alternatives a ON a.rule_id = m.rule_id
      WHERE a.alt IS NOT NULL AND NOT contains(a.alt, '^')""",
)
def c09(spark, folder):
    """Each suggestion put in place of a match, marked, after what precedes it."""
    found = check.matched(src.documents(spark, folder), packs.rules(spark), packs.lemmas(spark))
    alts = packs.alternatives(spark).filter("alt IS NOT NULL AND NOT contains(alt, '^')").select("rule_id", "ord", "alt")
    before = F.array_join(F.slice("prev", F.greatest(F.size("prev") - 4, F.lit(1)), F.lit(5)), "")
    behind = F.when(F.col("n_words") == 1, F.col("ws")).otherwise(F.regexp_extract(F.get("next", F.col("n_words") - 2), f"[{BLANKS}]*$", 0))
    return found.join(alts, "rule_id").select("doc_id", "i", "ord", F.concat(before, F.lit("["), "alt", F.lit("]"), behind).alias("draft"))
