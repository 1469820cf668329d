"""Span lists in one pass, external matches, rules for people."""

import random

import pytest
from pyspark.sql import functions as F

from lexiscreen.catalog.grammar import PEOPLE_RULES
from lexiscreen.operators import external, people, sweep
from lexiscreen.packs import literal

RANDOM = random.Random(5)
_DONE: dict = {}


def spans(n, texts=6, size=60, longest=12):
    made = [(RANDOM.randrange(texts), RANDOM.randrange(size)) for _ in range(n)]
    return [(d, s, s + RANDOM.randrange(longest)) for d, s in made]


def frame(spark, rows, names="doc_id int, start int, end int"):
    return spark.createDataFrame(rows, names)


def test_overlaps_and_containment_by_brute_force(spark):
    rows, others = sorted(set(spans(300))), spans(120)
    left, right = frame(spark, rows), frame(spark, others)
    got = {(r["doc_id"], r["start"], r["end"]): r["hit"] for r in sweep.touched(left, right, "hit").collect()}
    assert got == {(d, s, e): any(d == o and a < e and s < b for o, a, b in others) for d, s, e in rows}
    got = {(r["doc_id"], r["start"], r["end"]): r["hit"] for r in sweep.inside(left, right, "hit").collect()}
    assert got == {(d, s, e): any(d == o and a <= s and e <= b for o, a, b in others) for d, s, e in rows}
    assert 50 < sum(got.values()) < 290


def test_first_crossing_by_brute_force(spark):
    entities = []
    for doc in range(5):
        at = 0
        while at < 200:
            start = at + RANDOM.randrange(4)
            at = start + 1 + RANDOM.randrange(6)
            entities.append((doc, start, at, f"L{start}"))
    rows = sorted(set((d, s, s + 1 + RANDOM.randrange(15)) for d, s, _ in spans(300, 6, 200)))
    got = sweep.first_crossing(frame(spark, rows), frame(spark, entities, "doc_id int, start int, end int, label string"), "label", "name")
    want = {}
    for d, s, e in rows:
        hits = [(a, label) for o, a, b, label in entities if o == d and ((s <= a < e and b >= e) or (a <= s < b <= e))]
        want[d, s, e] = min(hits)[1] if hits else None
    assert {(r["doc_id"], r["start"], r["end"]): r["name"] for r in got.collect()} == want
    assert None in want.values() and len(set(want.values())) > 20


def test_spans_without_partners_and_empty_tables(spark):
    rows, none = frame(spark, [(1, 0, 5), (None, 0, 5)]), frame(spark, [])
    assert [r["hit"] for r in sweep.touched(rows, none, "hit").collect()] == [False, False]
    assert sweep.inside(none, rows, "hit").collect() == []
    assert [r["found"] for r in sweep.last_starting(rows, frame(spark, [(1, 3, 4)]), "found").collect()] == [None, None]


def test_sweep_forms_no_pairs(spark):
    """All spans of one text overlap: the pass still makes one row a span."""
    n = 4000
    rows = spark.range(n).selectExpr("1 AS doc_id", "cast(id AS int) AS start", f"cast(id + {n} AS int) AS end")
    assert sweep.touched(rows, rows, "hit").filter("hit").count() == n


def at(text, word, rule="SPELL", category="TYPOS"):
    start = text.index(word)
    return (start, start + len(word), rule, category)


REASONS = [
    ("de", "Liste:\n  gehen", "gehen", "DE_CASE", "CASING", [], {}, "line start"),
    ("de", "Das \tgehen", "gehen", "DE_CASE", "CASING", [], {}, "line start"),
    ("de", "Das gehen", "gehen", "DE_CASE", "CASING", [], {}, None),
    ("en", "  \n word", "  \n ", "WHITESPACE_RULE", "TYPOGRAPHY", [], {}, "leading blanks"),
    ("en", "a word  here", "  ", "WHITESPACE_RULE", "TYPOGRAPHY", [], {}, None),
    ("en", "we met Konstantina there", "Konstantina", "SPELL", "TYPOS", [(7, 18, "PER")], {}, "name"),
    ("en", "we met Konstantina there", "Konstantina", "SPELL", "TYPOS", [(7, 18, "DATE")], {}, None),
    ("en", "we met konstantina there", "konstantina", "SPELL", "TYPOS", [(7, 18, "PER")], {}, None),
    ("de", "\n Hallo Konstantina\n\nWie geht es dir?", "Konstantina", "SPELL", "TYPOS", [], {}, "salutation"),
    ("de", "Hallo ihr\nKonstantina", "Konstantina", "SPELL", "TYPOS", [], {}, None),
    ("en", "Dear Xaver,", "Xaver", "SPELL", "TYPOS", [], {}, "salutation"),
    ("en", "I liki all the colors.", "liki", "SPELL", "TYPOS", [], {}, None),
    ("fr", "Ma directrice vient", "directrice", "SPELL", "TYPOS", [], {}, "feminine noun"),
    ("fr", "les étudiant·es sont", "es sont", "SPELL", "TYPOS", [], {}, "separator"),
    ("fr", "un étudiant/e sage", "étudiant", "D_N", "GRAMMAR", [], {"separator": "/"}, "separator"),
    ("fr", "un étudiant/e sage", "étudiant", "D_N", "GRAMMAR", [], {}, None),
    ("de", "Folge @nutzername heute", "nutzername", "SPELL", "TYPOS", [], {}, "mention"),
    ("de", "Folge #nutzername heute", "#nutzername", "SPELL", "TYPOS", [], {}, "mention"),
    ("de", "Die Lehrer*innen kommen", "Lehrer", "SPELL", "TYPOS", [], {}, "gender ending"),
    ("de", "Die Lehrer/-innen kommen", "Lehrer", "SPELL", "TYPOS", [], {}, "gender ending"),
    ("de", "Die Lehrer*innen kommen", "Lehrer", "SPELL", "TYPOS", [], {"inclusive_roles": False}, None),
    ("de", "Die Lehrerne kommen", "Lehrerne", "SPELL", "TYPOS", [], {"ending": "de-e"}, "inclusive form"),
    ("de", "mit enserm Team", "enserm", "SPELL", "TYPOS", [], {"ending": "de-e"}, "inclusive form"),
    ("de", "Die Lehrerne kommen", "Lehrerne", "SPELL", "TYPOS", [], {}, None),
    ("de", "die:der kommt", ":der", "LEERZEICHEN_HINTER_DOPPELPUNKT", "TYPOGRAPHY", [], {"ending": ":in"}, "colon ending"),
]


@pytest.mark.parametrize("lang,text,word,rule,category,names,writer,reason", REASONS)
def test_reasons_to_drop_an_external_match(spark, lang, text, word, rule, category, names, writer, reason):
    key = str(writer)
    if key not in _DONE:
        own = [r for r in REASONS if r[6] == writer]
        docs = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(own)], "doc_id int, lang string, text string")
        found = spark.createDataFrame([(k, *at(r[1], *r[2:5])) for k, r in enumerate(own)], "doc_id int, start int, end int, rule_id string, category string")
        entities = spark.createDataFrame([(k, *n) for k, r in enumerate(own) for n in r[5]], "doc_id int, start int, end int, label string")
        done = external.judged(docs, found, entities, **writer).collect()
        _DONE[key] = {str(own[r["doc_id"]]): r["reason"] for r in done}
    assert _DONE[key][str((lang, text, word, rule, category, names, writer, reason))] == reason


PEOPLE = [
    ("en", "Employees are flexible, so are companies.", [("flexible", "Employees", True)]),
    ("en", "You are flexible.", [("flexible", "You", True)]),
    ("en", "We are looking for flexible employees.", [("flexible", "employees", True)]),
    ("en", "We like the flexible car.", [("flexible", "car", False)]),
    ("en", "Competition is our daily life and we love to be challenged.", [("challenged", "life", False)]),
    ("en", "Our life is long and the car is challenged.", [("challenged", "life", False)]),
    ("en", "He is a vegetable.", [("vegetable", "He", True)]),
    ("en", "The project has become a vegetable.", [("vegetable", None, False)]),
    ("en", "So flexible!", [("flexible", None, False)]),
    ("de", "Mitarbeiter sind flexibel.", [("flexibel", "Mitarbeiter", True)]),
    ("de", "Du bist flexibel.", [("flexibel", "Du", True)]),
    ("de", "Wir suchen flexible Mitarbeiterinnen.", [("flexible", "Mitarbeiterinnen", True)]),
    ("de", "Das Haus ist flexibel.", [("flexibel", "Haus", False)]),
]


@pytest.mark.parametrize("lang,text,want", PEOPLE)
def test_rules_for_people_need_a_person(spark, lang, text, want):
    if "people" not in _DONE:
        docs = spark.createDataFrame([(t, l, t) for l, t, _ in PEOPLE], "doc_id string, lang string, text string")
        _DONE["people"] = people.not_for_people(docs, literal.frame(spark, people.RULE_COLUMNS, PEOPLE_RULES)).orderBy("i").collect()
    assert [(r["tok"], r["head"], r["is_kept"]) for r in _DONE["people"] if r["doc_id"] == text] == want


def test_what_an_external_match_is_reported_under(spark):
    cases = [
        ("SONDERZEICHEN", "TYPOS", None, "", None), ("X", "COLLOQUIALISMS", None, "", "plain_language"), ("GONNA_TEMP", "STYLE", None, "", "plain_language"),
        ("RUDE_SARCASTIC", "STYLE", None, "", "offensive_language"), ("X", "STYLE", None, "", "orthography"), ("X", "REDUNDANCY", None, "", "orthography"),
        ("X", "PLAIN_ENGLISH", None, "", "plain_language_advanced"), ("ABKUERZUNG", "DIFFICULT_WORDS", None, "", None), ("ANGLIZISMEN", "DIFFICULT_WORDS", None, "", "anglicism_advanced"),
        ("X", "DIFFICULT_WORDS", None, "Fremdwörter meiden", "anglicism_advanced"), ("X", "DIFFICULT_WORDS", None, "", "plain_language_advanced"),
        ("X", "MISC", "Leichte Sprache", "", "plain_language_advanced"), ("X", "SPELLING", None, "", "spelling"), ("X", "TYPOS", None, "", "orthography"),
    ]
    frame = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, rule_id string, category string, name string, message string")
    got = frame.select("k", external.subcategory(["spelling"], F.col("name"), F.col("message")).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in got] == [c[4] for c in cases]


def test_addresses_are_masked_and_code_is_not(spark):
    from lexiscreen.functions import privacy

    texts = {
        "see ::1 here": "see <URL> here", "on 2001:db8:: now": "on <URL> now", "at 2001:db8::1, ok": "at <URL>, ok", "1:2:3:4:5:6:7:8": "<URL>",
        "a face::book b": "a face::book b", "std::vector<int>": "std::vector<int>", "std::cafe": "std::cafe", "a ::b": "a ::b", "[2001:db8::7]:80/x y": "<URL> y",
        "me@example.org": "<EMAIL>", "127.0.0.1:8080/a": "<URL>", "call 42": "call <NUMBER>",
    }
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["m"] for r in frame.select("t", privacy.mask(F.col("t")).alias("m")).collect()} == texts
    import duckdb

    con = duckdb.connect()
    for text, want in texts.items():
        assert con.execute(f"SELECT {privacy.masked_sql('t')} FROM (SELECT ? AS t)", [text]).fetchall()[0][0] == want
