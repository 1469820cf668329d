"""Token table joined to rule table.

Only the first word of a rule is a join key; the rest of a phrase, a pattern or
a window is verified on the bounded neighbourhood each token row carries.  The
joins carry no hint: a rule pack is broadcast when its size is known to be below
the session's threshold, and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..packs import fixed
from .tokens import _PY_BLANKS, PIECE, Wanted, piece_token

SPAN = ("doc_id", "lang", "i", "start", "tok")


def annotate(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Add lemma, word type and plural flag from the pinned lemmas; a word that
    is not pinned is its own lemma."""
    pins = lemmas.select("lang", F.col("form").alias("_form"), F.col("lemma").alias("_lemma"), "word_type", "is_plural")
    joined = tokens.withColumn("_form", F.lower("tok")).join(pins, ["lang", "_form"], "left")
    return joined.withColumn("lemma", F.coalesce("_lemma", "tok")).drop("_form", "_lemma")


def rule_words() -> Column:
    """The tokens of a rule's text, cut like any other text."""
    return F.transform(F.regexp_extract_all("words", F.lit(PIECE), F.lit(0)), piece_token)


def keyed(rules: DataFrame) -> DataFrame:
    words = rule_words()
    return rules.select(
        "*",
        F.size(words).alias("n_words"),
        F.element_at(words, 1).alias("first_token"),
        F.lower(F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).alias("tail"),
    )


def allowed(rules: DataFrame, rtype: str, addons: list[str] | None) -> DataFrame:
    """Rules of one type that can be candidates: with a subcategory, and not
    bound to an add-on that is off (no list means all are on)."""
    kept = rules.filter((F.col("rtype") == rtype) & (F.col("subcategories") != ""))
    return kept if addons is None or "hr" in addons else kept.filter(~F.col("is_hr"))


def is_checkable(lang: Column, tok: Column) -> Column:
    """Whether a token is looked at: an opening bracket, the one-letter words of
    the language, else two characters or more with a letter or digit."""
    one = F.lower(tok)
    return (
        (tok == "(")
        | ((lang == "en") & one.isin("a", "i", "o"))
        | ((lang == "fr") & one.isin("a", "à", "y"))
        | ((F.length(tok) > 1) & tok.rlike(r"[\p{L}\p{N}]"))
    )


def looks_like_name(tok: Column) -> Column:
    """Inner capitals without a hyphen for each of them: `ElitePartner` is a
    name, `Elite-Partner` is not."""
    capitals = F.regexp_count(tok, F.lit(r"\p{Lu}"))
    return (capitals > 1) & (F.regexp_count(tok, F.lit("-")) < capitals - 1)


def _last4(word: str) -> Column:
    return F.lower(F.expr(f"right({word}, 4)"))


#: Probes of a pack up to which texts are asked for them while they are cut; with more, every token meets the pack by the joins alone.
MOST_PROBES = 1 << 18


def asked_words(rules: DataFrame, lemmas: DataFrame, addons: list[str] | None = None, more=None, before=None, substrings: bool = False) -> Wanted | None:
    """Tokens that can be candidates of a pack: the joins of ``candidates`` decide, this only spares the others the way there.
    ``more`` is a further question to a token; ``substrings`` adds words with a substring rule's text in them."""
    kinds = ["default", "suffix"] + (["substring"] if substrings else [])
    pack = keyed(rules.filter(F.col("rtype").isin(*kinds) & (F.col("subcategories") != "")))
    pack = pack if addons is None or "hr" in addons else pack.filter(~F.col("is_hr"))
    probe = F.when(F.col("rtype") == "suffix", _last4("first_token")).when(F.col("rtype") == "substring", F.lower("words"))
    follows = F.when((F.col("rtype") == "default") & (F.col("n_words") > 1), F.translate(F.lower(F.element_at(rule_words(), 2)), "’", "'"))
    probes = pack.select("rtype", F.coalesce(probe, F.lower("first_token")).alias("probe"), follows.alias("second"))
    forms = lemmas.select(F.lower("lemma").alias("probe"), "form").join(probes.filter("rtype = 'default'"), "probe")
    every = probes.union(forms.select("rtype", F.col("form").alias("probe"), "second")).distinct().limit(MOST_PROBES + 1).collect()
    if len(every) > MOST_PROBES:
        return None
    first, last, inside = (frozenset(r["probe"] for r in every if r["rtype"] == kind and r["probe"] and r["second"] is None) for kind in ("default", "suffix", "substring"))
    # A word that only begins phrases is asked for where a second word of one follows.
    begin = frozenset(r["probe"] for r in every if r["second"] is not None) - first
    second = frozenset(r["second"] for r in every if r["second"] is not None)
    sizes = {min(len(p), GRAM) for p in inside}
    begins = frozenset(p[:GRAM] for p in inside)

    def word(tok: str, _) -> bool:
        low = tok.lower()
        if low in first or low[-4:] in last or (more is not None and more(tok)):
            return True
        held = any(low[k : k + n] in begins for n in sizes for k in range(len(low) - n + 1))
        return held and any(p in low for p in inside if p[:GRAM] in low)

    pair = (lambda piece: piece.rstrip(_PY_BLANKS).lower() in begin, lambda piece: piece.rstrip(_PY_BLANKS).replace("’", "'").lower() in second)
    return Wanted(word, before, pair=pair if begin else None)


def candidates(tokens: DataFrame, rules: DataFrame, addons: list[str] | None = None, shapes: Column | None = None) -> DataFrame:
    """Default and suffix rules in one join on (language, rule type, probe).

    A default rule's probe is its first word in lower case, tried against the
    token and its lemma and then verified in the case the rule asks for.  A
    suffix rule's probe is the last four letters of its first word, verified as
    a suffix; a first word shorter than that is never a candidate.

    ``shapes`` is an array of (key, said, written) that a token has by its form alone: rules of type ``shape`` are found
    by such a key, ``said`` is the text they match and ``written`` what could stand instead."""
    first = F.col("first_token")
    default = keyed(allowed(rules, "default", addons)).withColumn("probe", F.lower(first))
    suffix = keyed(allowed(rules, "suffix", addons)).filter(F.length(first) >= 4).withColumn("probe", _last4("first_token"))
    pack = default.unionByName(suffix)
    if shapes is not None:
        pack = pack.unionByName(keyed(allowed(rules, "shape", addons)).withColumn("probe", F.col("words")))
    pack = pack.withColumnRenamed("word_type", "_rule_type").drop("is_plural")
    # First the cheap question, for every token: does any probe exist?  Three
    # small outer joins stay in one generated stage and copy nothing; only the
    # few tokens that answer yes are unfolded into probes.
    keys = pack.select("lang", "rtype", "probe").distinct()
    known = lambda rtype, column: keys.filter(F.col("rtype") == rtype).select(
        "lang", F.col("probe").alias(column), F.lit(True).alias(f"{column}_known")
    )
    by_suffix = (F.col("lang") == "de") & (F.length("tok") >= 4)
    asking = (
        tokens.withColumn("_tok", F.lower("tok"))
        .withColumn("_lemma", F.when(F.col("lemma") != F.col("tok"), F.lower("lemma")))
        .withColumn("_suffix", F.when(by_suffix, _last4("tok")))
        .join(known("default", "_tok"), ["lang", "_tok"], "left")
        .join(known("default", "_lemma"), ["lang", "_lemma"], "left")
        .join(known("suffix", "_suffix"), ["lang", "_suffix"], "left")
    )
    said = F.coalesce(F.col("_tok_known") | F.col("_lemma_known") | F.col("_suffix_known"), F.lit(False))
    said = said & is_checkable(F.col("lang"), F.col("tok"))
    asking = asking.withColumn("_said", said) if shapes is not None else asking.filter(said)
    if shapes is not None:
        # A token without any is left out when they are unfolded: a filter would work the shapes out twice.
        asking = asking.withColumn("_shapes", shapes)
    none = F.lit(None).cast("string")
    own = [] if shapes is None else [none.alias("said"), none.alias("written")]
    probe = lambda rtype, column, when: F.when(
        F.col(f"{column}_known") & when, F.struct(F.lit(rtype).alias("rtype"), F.col(column).alias("probe"), *own)
    )
    on = F.lit(True) if shapes is None else F.col("_said")
    other = ~F.coalesce(F.col("_tok_known") & (F.col("_lemma") == F.col("_tok")), F.lit(False))
    asked = [probe("default", "_tok", on), probe("default", "_lemma", on & other), probe("suffix", "_suffix", on & ~looks_like_name(F.col("tok")))]
    asked = F.array_compact(F.array(*asked))
    if shapes is not None:
        full = lambda x: F.struct(F.lit("shape").alias("rtype"), x["key"].alias("probe"), x["said"].alias("said"), x["written"].alias("written"))
        asked = F.when(F.size("_shapes") > 0, F.concat(asked, F.transform("_shapes", full))).otherwise(asked)
    probes = asking.select(*tokens.columns, F.explode(asked).alias("_p")).select("*", "_p.*").drop("_p")
    form = F.when(F.col("lemmatize"), F.col("lemma")).otherwise(F.col("tok"))
    form = F.when(F.col("lower_case"), F.lower(form)).otherwise(form)
    fits = F.when(F.col("rtype") == "default", form == first).when(F.col("rtype") == "suffix", F.lower("tok").endswith(F.lower(first))).otherwise(True)
    stage = F.when(F.col("rtype") == "default", 1).otherwise(2).alias("stage")
    # A rule for a word type leaves out tokens that are known to be of another.
    asked_type = F.coalesce("_rule_type", F.lit(""))
    typed = (asked_type == "") | F.col("word_type").isNull() | (F.col("word_type") == asked_type)
    return probes.join(pack, ["lang", "rtype", "probe"]).filter(fits & typed).drop("_rule_type").select("*", stage)


def phrase_matches(candidates: DataFrame) -> DataFrame:
    """Keep candidates whose remaining words follow, and add the matched
    ``text``, its ``end`` and ``skip``, the first token after it."""
    rest = F.slice("next", F.lit(1), F.col("n_words") - 1)
    said = F.array_join(F.transform(rest, lambda p: F.lower(F.translate(piece_token(p), "’", "'"))), " ")
    text = piece_token(F.concat(F.col("tok"), F.col("ws"), F.array_join(rest, "")))
    formed = F.col("said") if "said" in candidates.columns else F.lit(None).cast("string")
    return (
        candidates.filter(formed.isNotNull() | (F.col("n_words") == 1) | (said == F.translate("tail", "’", "'")))
        .withColumn("text", F.when(formed.isNotNull(), formed).when(F.col("n_words") == 1, F.col("tok")).otherwise(text))
        .withColumn("end", F.col("start") + F.length("text"))
        .withColumn("skip", F.col("i") + F.col("n_words"))
    )


#: Letters of a rule's text that are its key.
GRAM = 3


def substring_hits(words: DataFrame, rules: DataFrame, addons: list[str] | None = None) -> DataFrame:
    """Substring rules over *distinct* words: the rule's text is in the word and
    still is after the standard word parts the rule does not contain are cut.

    A word meets the rules whose first letters it holds somewhere: the key is language and letters, not the language alone.
    Rules shorter than a key are few, and meet the words by their own letters in the same way."""
    inside = F.lower("words")
    parts = F.array(*[F.lit(p) for p in fixed.STANDARD_WORDS])
    pack = allowed(rules, "substring", addons).select(
        "rule_id",
        F.col("lang").alias("_lang"),
        inside.alias("inside"),
        "subcategories",
        F.filter(parts, lambda p: ~inside.contains(p)).alias("_parts"),
    )
    size = F.least(F.length("inside"), F.lit(GRAM))
    pack = pack.withColumn("_size", size).withColumn("_gram", F.substring("inside", F.lit(1), size)).filter("_size > 0")
    low = F.lower("tok")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda k: F.struct(F.lit(n).alias("_n"), F.substring(low, k, F.lit(n)).alias("_g")))
    keyed_words = words.withColumn("_k", F.explode(F.array_distinct(F.concat(*[cut(n) for n in range(1, GRAM + 1)]))))
    on = (F.col("lang") == F.col("_lang")) & (F.col("_k._n") == F.col("_size")) & (F.col("_k._g") == F.col("_gram"))
    hits = keyed_words.join(pack, on).filter(low.contains(F.col("inside"))).drop("_k", "_size", "_gram")
    cut = F.aggregate("_parts", F.lower("tok"), lambda w, p: F.replace(w, p, F.lit("")))
    return hits.filter(cut.contains(F.col("inside"))).drop("_lang", "_parts")


# One letter per word type, so a run of tokens becomes a string a regular
# expression can be matched on.
TYPE_CODES = {
    "v": "v", "a": "a", "adv": "d", "n": "n", "pron": "p", "emoji": "e", "conj": "c", "num": "m", "card": "k",
    "article": "r", "adp": "o",
}


def pattern_regex(part: Column) -> Column:
    """`article|adv*` as a regular expression over type letters."""
    code = F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv])
    letter = lambda t: F.concat(
        F.coalesce(F.try_element_at(code, F.regexp_replace(t, r"\*$", "")), F.lit("x")), F.when(t.endswith("*"), "*").otherwise("")
    )
    return F.array_join(F.transform(F.filter(F.split(part, r"\|"), lambda t: t != ""), letter), "")


def pattern_matches(matches: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Keep matches whose rule has no ``pattern``, or whose neighbours have the word types of it around the lemma `l`.
    Only rows that already matched are unfolded, each into its bounded neighbourhood, so the regrouping is small."""
    code = F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv])
    whole = F.concat(F.lit("|"), F.col("pattern"), F.lit("|"))
    side = lambda k: pattern_regex(F.get(F.split(whole, r"\|l\|", 2), F.lit(k)))
    asked = matches.filter("pattern IS NOT NULL").select("doc_id", "lang", "i", "rule_id", "pattern", "prev", "tok", "next")
    near = asked.select(
        "doc_id", "lang", "i", "rule_id", side(0).alias("_before"), side(1).alias("_after"),
        F.posexplode(F.concat("prev", F.array("tok"), "next")).alias("k", "p"), F.size("prev").alias("n_prev"),
    )
    pins = lemmas.select("lang", F.col("form").alias("_form"), "word_type")
    typed = near.withColumn("_form", F.lower(piece_token(F.col("p")))).join(pins, ["lang", "_form"], "left")
    runs = typed.groupBy("doc_id", "i", "rule_id", "_before", "_after").agg(
        F.array_sort(F.collect_list(F.struct("k", F.coalesce(code[F.col("word_type")], F.lit("x")).alias("c")))).alias("c"),
        F.max("n_prev").alias("n_prev"),
    )
    run = F.array_join(F.transform("c", lambda s: s["c"]), "")
    ahead = F.substring(run, F.lit(1), F.col("n_prev")).alias("ahead")
    behind = F.substring(run, F.col("n_prev") + 2, F.length(run)).alias("behind")
    kept = runs.select("doc_id", "i", "rule_id", ahead, behind, "_before", "_after").filter(
        F.regexp(F.col("ahead"), F.concat("_before", F.lit("$"))) & F.regexp(F.col("behind"), F.concat(F.lit("^"), "_after"))
    )
    plain = matches.filter("pattern IS NULL")
    return plain.unionByName(matches.filter("pattern IS NOT NULL").join(kept.select("doc_id", "i", "rule_id"), ["doc_id", "i", "rule_id"], "left_semi"))
