"""Steps that must not carry every token of a corpus along: what leaves the pass over the texts, and what is shuffled."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexiscreen.catalog import QUERIES
from lexiscreen.functions import words as shapes
from lexiscreen.operators import alternatives as alts
from lexiscreen.operators import context, external, langid, matching, people, ranking, suppress
from lexiscreen.operators import tokens as cutting
from lexiscreen.operators.tokens import Wanted, tokens
from lexiscreen.packs import literal, rules as packs
from lexiscreen.plans import check, review, screen

TEXTS = [
    (1, "en", "Only the reed is here. And the cat, of the house."), (2, "de", "Sie sind nicht da: und die Lehrer*innen m/w. Die Aufgabe(n)"),
    (3, "fr", "la femme et les amis étudiant.e.s qui sont"), (4, "en", None), (5, "de", ""), (5, "de", "Freiheit der Astschkunde Ärzt/in"),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id int, lang string, text string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_wanted_tokens_keep_place_and_neighbours(spark):
    texts = frame(spark)
    whole = tokens(texts, prev=2, next=3)
    asked = lambda tok, piece: tok.lower() in ("reed", "nicht", "da", "amis")
    low = F.lower("tok")
    assert rows(tokens(texts, prev=2, next=3, only=Wanted(asked))) == rows(whole.filter(low.isin("reed", "nicht", "da", "amis")))
    told = {(r["doc_id"], r["tok"]) for r in tokens(texts, only=Wanted(asked, lambda p: p[0] in "/*", lambda p: p == ": ")).collect()}
    assert told == {(1, "reed"), (2, "nicht"), (2, "da"), (2, "m"), (2, "und"), (3, "amis"), (5, "Ärzt")}
    held = {(r["doc_id"], r["sent"]) for r in tokens(texts, only=Wanted(asked, sentences=True)).collect()}
    hits = whole.filter(low.isin("reed", "nicht", "da", "amis")).select("doc_id", "sent").distinct()
    assert held == {tuple(r) for r in hits.collect()}
    assert rows(tokens(texts, prev=2, next=3, only=Wanted(asked, sentences=True))) == rows(whole.join(hits, ["doc_id", "sent"], "left_semi").select(whole.columns))


def test_the_pack_finds_the_same_without_the_other_tokens(spark, monkeypatch):
    rng = random.Random(3)
    words = [r[2] for r in packs.RULES] + [x[1] for x in packs.LEMMAS] + "Lehrer*innen LehrerIn m/w (f/m) étudiant.e.s ami·e amis et amies #abcdefg #Abcdefg Freiheit Astschkunde Sie Ihnen Herr only reed".split()
    made = [(k, ("en", "de", "fr")[k % 3], " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "/", "\n"]) for _ in range(40))) for k in range(180)]
    made += [(1000 + k, "de", "x" * 19 + f" {w}") for k, w in enumerate(words)]
    texts = frame(spark, made)
    pack, lemmas = packs.rules(spark), packs.lemmas(spark)
    own, every = check.matched(texts, pack, lemmas), screen.findings(texts.withColumn("config_id", F.lit("src0")), spark)
    own, every = rows(own), rows(every)
    monkeypatch.setattr(matching, "MOST_PROBES", 0)
    monkeypatch.setattr(people, "MOST_PROBES", 0)
    assert matching.asked_words(pack, lemmas) is None
    assert own == rows(check.matched(texts, pack, lemmas)) and len(own) > 500
    assert every == rows(screen.findings(texts.withColumn("config_id", F.lit("src0")), spark)) and len(every) > 500


def test_only_asked_tokens_leave_the_pass(spark):
    texts = frame(spark, [(1, "en", "nothing else matters today " * 50 + "with it")])
    asked = matching.asked_words(packs.rules(spark), packs.lemmas(spark))
    assert tokens(texts, only=asked).count() == 1


def test_words_seen_once_are_counted_by_hash(spark):
    plan = external.spelling(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_sentences_without_a_person_rule_are_not_shuffled(spark):
    texts = frame(spark, [(1, "en", "This is it. Only the woman is here. " + "No word of a rule. " * 40)])
    rule = literal.frame(spark, people.RULE_COLUMNS, [(1, "en", "only")])
    only = people.naming(rule, people.lexicon.words(spark))
    assert people.chunked(texts, only=only).select("sent").distinct().count() == 1
    assert [r["head"] for r in people.not_for_people(texts, rule).collect()] == ["woman"]


def test_findings_without_a_sentence_are_dealt_out(spark):
    found = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("sentence"))

    class Model:
        def transform(self, df):
            from pyspark.ml.functions import array_to_vector

            return df.withColumn("probability", array_to_vector(F.array(F.lit(0.9), F.lit(0.1))))

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = spark.createDataFrame([(5000, "a b")], "doc_id long, sentence string")
        kept = context.without_harmless(found.unionByName(texts), Model())
        sizes = [r["n"] for r in kept.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_touching_matches_are_folded_by_blocks_of_chains(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CHAINS", 3)
    rng = random.Random(5)
    spans = [(d, i, i + rng.choice([1, 1, 1, 2, 3, 7])) for d in (1, 2, None) for i in range(300) if rng.random() < 0.5]
    got = ranking.non_overlapping(spark.createDataFrame(spans, "doc_id int, i int, skip int"))
    want, reach = set(), {}
    for d, i, skip in spans:
        if i >= reach.get(d, 0):
            want.add((d, i, skip))
            reach[d] = skip
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert " div 3)" in got._jdf.queryExecution().optimizedPlan().toString()  # not a group for each chain


def test_the_language_of_frequent_words_needs_no_list_of_words(spark):
    texts = ["", "the", "Le la thé the, isthe", "der1die_das ist", "et,et le the THE of", "ést est esté", "of ofé éof que İs is"]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", shapes.stopword_language(F.col("t")).alias("l"))
    words = F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0)).alias("w")
    for r in frame.select("l", words).collect():
        n = {lang: sum(w in listed for w in r["w"] or []) for lang, listed in shapes.STOPWORDS.items()}
        assert r["l"] == (max(n, key=n.get) if any(n.values()) else None)
    assert "lambda" not in frame._jdf.queryExecution().optimizedPlan().toString()  # no filter over all words of the text


LANGUAGES = [
    (1, "en", "the reed and the İstanbul cat, 2nd of_the THE"), (1, "en", "a second row of one id"), (2, "de", "Straße ÄÖÜ der Hund"), (3, "fr", "l'été où  \n\tles amis"),
    (4, None, "der the où"), (5, "en", None), (6, "en", ""), (7, "de", "123 _ - ²Ⅻ"), (8, "fr", "𝒳𐐀𐐁 e\u0301t ΟΔΟΣ"), (None, "de", "und nichts"), (9, None, "жук"), (10, "de", "x"), (10, None, "жук жук"),
]


def counted_by_hand(spark):
    """(doc_id, lang, {gram: n}) of LANGUAGES, from Spark's own words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w")
    rows = spark.createDataFrame(LANGUAGES, "doc_id int, lang string, text string").select("doc_id", "lang", words).collect()
    return [(d, lang, Counter(f" {w} "[k : k + 3] for w in ws or [] for k in range(len(w)))) for d, lang, ws in rows]


def test_languages_are_told_as_by_hand_however_few_likelihoods_the_tasks_know(spark, monkeypatch):
    texts, hand = frame(spark, LANGUAGES), counted_by_hand(spark)
    counts, sizes, gains = defaultdict(Counter), Counter(), defaultdict(dict)
    for d, lang, grams in hand:
        sizes[d] += sum(grams.values())
        if lang is not None:
            counts[lang].update(grams)
    model = langid.profile(texts)
    assert {(r["lang"], r["gram"]): r["n"] for r in model.collect()} == {(lang, g): n for lang, c in counts.items() for g, n in c.items()}
    for d, _, grams in hand:
        for lang, known in counts.items():
            for g in grams.keys() & known.keys() if d is not None else ():
                logp = math.log((known[g] + 1) / (sum(known.values()) + len(known)))
                gains[d][lang] = gains[d].get(lang, 0) + grams[g] * (logp + 14)
    want = {}
    for d, each in gains.items():
        e = {lang: math.exp(g / sizes[d]) for lang, g in each.items()}
        want |= {(d, lang): x / sum(e.values()) for lang, x in e.items()}
    assert len(want) == 10 and {d for d, _ in want} == {1, 2, 3, 4, 8, 10}
    for most, block in ((langid.MOST_KNOWN, langid._BLOCK), (30, 40), (1, 1)):
        monkeypatch.setattr(langid, "MOST_KNOWN", most)
        monkeypatch.setattr(langid, "_BLOCK", block)
        got = langid.scores(texts, model).collect()
        assert len(got) == len(want)
        assert all(math.isclose(r["score"], want[r["doc_id"], r["lang"]], rel_tol=1e-9) for r in got)
    assert langid.scores(texts, model.filter("lang = 'xx'")).collect() == []


def test_a_text_leaves_the_language_pass_as_a_row_for_each_language(spark):
    rng = random.Random(7)
    words = [("".join(rng.choice("abcdefghij") for _ in range(6))) for _ in range(3000)]
    texts = frame(spark, [(d, ("en", "de")[d % 2], " ".join(words)) for d in range(4)])
    scored = langid.scores(texts, langid.profile(texts))
    assert len(scored.collect()) == 8
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") <= 2  # the languages of a text at the end (initial and final plan), not its words


def test_two_cuts_of_a_text_are_paired_where_it_is_read(spark, tmp_path):
    made = [(1, "de", "  Die Lehrer*innen (m/w) 😀 sagen: l'été!\nGut ."), (2, "en", "one two, three"), (2, "en", "one two"), (None, "en", "lost"), (3, "fr", None), (4, "fr", ""), (5, "en", " \t "), (6, "en", "x")]
    frame(spark, made).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    gold = tokens(docs, keep=("doc_id",), words_only=True).select("doc_id", "start", "end", F.col("tok").alias("gold"))
    want = tokens(docs, keep=("doc_id",)).join(gold, ["doc_id", "start", "end"]).select("doc_id", "i", "gold")
    got = QUERIES["j26_gold_align"](spark, str(tmp_path))
    assert rows(got) == rows(want) and {r["gold"] for r in got.filter("doc_id = 1").collect()} == {"Die", "Lehrer*innen", "😀", "Gut", "."}
    assert got.filter("doc_id = 2").count() == 7  # rows that share an id meet by it
    assert "Exchange" not in cutting.aligned(docs)._jdf.queryExecution().executedPlan().toString()


def test_a_word_that_only_begins_phrases_is_asked_for_before_a_second_word(spark):
    texts = frame(spark, [(1, "en", "of a house of the house OF  The end of\nThe x"), (2, "de", "von uns von der"), (3, "fr", "pour les pour moi de")])
    asked = matching.asked_words(packs.rules(spark).filter("rule_id IN (8, 32, 45)"), packs.lemmas(spark))
    told = [(r["doc_id"], r["i"]) for r in tokens(texts, only=asked).orderBy("doc_id", "i").collect()]
    assert told == [(1, 3), (1, 6), (1, 9), (2, 2), (3, 0)]


def test_parts_of_a_shape_are_worked_out_once(spark):
    texts = frame(spark).withColumn("config_id", F.lit("src0"))
    found = screen.matches(texts, spark, packs.configs(spark), packs.screen_rules(spark), packs.taxonomy(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:et|ou) (?:(?:le|la|les|un|une|des) )?") == 1 and plan.count("[.,;!?»“”") == 1
    texts = frame(spark, [(1, "en", "nothing to see"), (2, "de", "der Hund")])
    assert tokens(texts, next=2).filter(screen._has_sign()).count() == 0


def test_phrases_with_another_meaning_have_a_sign(spark):
    said = ["a Masters of science", "she LED them up", "leads to it", "lead a good life", "let alone that", "of this KIND here", "quick Call now", "of a house", "a quick one", "the leader"]
    words = tokens(frame(spark, [(k, "en", t) for k, t in enumerate(said)]), prev=5, next=6).withColumn("words", F.lit("-"))
    told = {r["doc_id"] for r in words.filter(suppress.in_phrase()).collect()}
    assert told == {0, 1, 2, 3, 4, 5, 6}


def test_suggestions_are_cleaned_by_rule_but_for_a_findings_own_text(spark):
    table = alts.suggestion_table(packs.rules(spark), packs.alternatives(spark))
    found = spark.createDataFrame([(1, n, t) for n in ("singular", "plural", "none") for t in ("the", "this", "a")] + [(6, "unknown", "That"), (9, "unknown", "to")], "rule_id int, number string, text string")
    none = F.array().cast("array<struct<ord:int,alt:string,is_remove:boolean,is_inspiration:boolean,label:string>>")
    for most in (1000, 2, 0):
        want = found.join(table, ["rule_id", "number"], "left").withColumn("alternatives", alts.clean(F.coalesce("alternatives", none), F.col("text"), most))
        assert rows(alts.attached(found, table, most)) == rows(want)


def test_a_review_runs_the_check_once(spark):
    texts = frame(spark, [(1, None, "😀 the reed and that. " * 60), (1, None, "the other row 😀"), (2, None, "12"), (None, None, "the end")])
    judged = review.review(texts, spark, 100)
    assert "mapInArrow" not in judged._jdf.queryExecution().optimizedPlan().toString().replace("MapInArrow", "mapInArrow")
    assert judged.count() == 4
    held = review.places(texts, 100)
    assert {bool(r["_text"]) for r in held.filter("part.doc_id IS NULL OR part.doc_id = 2").collect()} == {False}
