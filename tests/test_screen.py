"""The whole check on written-out texts: what each stage finds, and which stage wins."""

import pytest

from lexiscreen.packs import rules as packs
from lexiscreen.plans import screen

#: Configurations of the cases: id, disabled, ignored, German and French format, most alternatives, HR rules.
CONFIGS = [
    ("plain", "", "", "*in", "·", 5, True),
    ("colon", "", "", ":in", "·s", 5, True),
    ("capital", "", "", "In", "/", 5, True),
    ("quiet", "plain_language|gender_specific_abbreviation", "of the", "*in", "·", 1, False),
    ("terms", "", "", "*in", "·", 5, True),
    ("no gender", "gender-orientation", "", "*in", "·", 5, True),
]
TERMS = [("terms", "en", "with the", "alongside the"), ("terms", "en", "#teamwork", "cooperation")]
RULES = [
    (301, "de", "Lehrer", "default", False, True, "", "titles", "default", None, False, None, None, None, 6, None, None),
    (302, "en", "guys", "default", True, False, "", "gender_identity", "default", None, False, None, None, None, 6, None, None),
    (303, "en", "master", "default", True, False, "", "culture", "default", None, False, None, None, None, 6, None, None),
    (304, "en", "flexible", "default", True, False, "", "filler", "default", None, False, None, None, None, 6, None, "not_for_people"),
    (305, "fr", "étudiants", "default", True, False, "", "function", "default", None, False, None, None, None, 6, None, None),
    (306, "de", "mann", "substring", True, False, "", "titles", "default", None, False, None, None, None, 8, None, None),
]
LONG = "Donaudampfschifffahrtsgesellschaft"
THIRTY = " ".join(["word"] * 31)

#: config, language, text, expected (text, stage, subcategory, alternatives) in order.
CASES = [
    ("plain", "en", "Say for the best", [("for the", "rule", "filler_advanced", ["a", "this", "these"])]),
    ("plain", "en", "and that is all", [("and that", "rule", "filler", ["plus"]), ("is", "rule", "culture", ["remain", "stay"])]),
    ("plain", "en", "Hello guys, m/f wanted", [("guys", "rule", "gender_identity", []), ("m/f", "abbreviation", "gender_specific_abbreviation", ["d/f/m"])]),
    ("plain", "de", "Job (m/w)", [("m/w", "abbreviation", "gender_specific_abbreviation", ["d/w/m"])]),
    ("plain", "en", "it is a/m/f", [("is", "rule", "culture", ["remain", "stay"])]),
    ("plain", "en", "join #teamwork now", [("#teamwork", "hashtag", "plain_language", [])]),
    ("plain", "en", "join #teamWork now", []),
    ("terms", "en", "walk with the dog", [("with the", "term", "corporate_rules", ["alongside the"])]),
    ("plain", "en", "walk with it", [("with", "rule", "culture", ["idea"])]),
    ("quiet", "en", "walk with it", []),
    ("plain", "de", f"Die {LONG}.", [("Die", "rule", "titles", ["alle"]), (LONG, "long word", "plain_language", [])]),
    ("quiet", "de", f"Das {LONG}.", []),
    ("plain", "de", "Viele Lehrer:innen", [("Lehrer:innen", "german ending", "gendered_denominations_ending_advanced", ["Lehrer*innen"])]),
    ("plain", "de", "Viele Lehrer*innen", [("Lehrer*innen", "german ending", "d_and_i", [])]),
    ("colon", "de", "Viele Lehrer*innen", [("Lehrer*innen", "german ending", "gendered_denominations_ending_advanced", ["Lehrer:innen"])]),
    ("capital", "de", "Viele Lehrer*innen", [("Lehrer*innen", "german ending", "gendered_denominations_ending_advanced", ["LehrerInnen"])]),
    ("plain", "de", "Viele LehrerInnen", [("LehrerInnen", "german ending", "gendered_denominations_ending_advanced", ["Lehrer*innen"])]),
    ("plain", "de", "Viele Schüler/-innen", [("Schüler/-innen", "german ending", "gendered_denominations_ending_advanced", ["Schüler*innen"])]),
    ("plain", "de", "Ein Schüler(in) hier", [("Schüler(in)", "german ending", "gendered_denominations_ending_advanced", ["Schüler*in"])]),
    ("no gender", "de", "Viele Lehrer:innen", []),
    ("plain", "de", "Viele Lehrer hier", [("Lehrer", "rule", "titles", [])]),
    ("plain", "de", "Die Feuerwehrmannschaft", [("Die", "rule", "titles", ["alle"]), ("Feuerwehrmannschaft", "substring", "titles", [])]),
    ("plain", "fr", "un étudiant·e ici", [("étudiant·e", "french ending", "d_and_i", [])]),
    ("plain", "fr", "un étudiant/e ici", [("étudiant/e", "french ending", "gendered_denominations_ending_advanced", ["étudiant·e"])]),
    ("colon", "fr", "cinq étudiant·es ici", [("étudiant·es", "french ending", "gendered_denominations_ending_advanced", ["étudiant·e·s"])]),
    ("plain", "fr", "cinq étudiants et étudiantes ici", [("étudiants et étudiantes", "french pair", "gendered_denominations_ending_advanced", ["étudiant·es"])]),
    ("plain", "fr", "cinq étudiants et directrices", [("étudiants", "rule", "function", [])]),
    ("plain", "fr", "des étudiantes et étudiants", [("étudiantes et étudiants", "french pair", "gendered_denominations_ending_advanced", ["étudiant·es"])]),
    ("plain", "en", "a master plan", [("master", "rule", "culture", [])]),
    ("plain", "en", "a master of arts", []),
    ("plain", "en", "so 🍔 now", [("🍔", "emoji", "culture", ["🥗", "🧆", "🥟", "🍱", "🍛"])]),
    ("quiet", "en", "so 🍔 now", [("🍔", "emoji", "culture", ["🥗"])]),
    ("plain", "en", "go 🚀🚀🚀", [("🚀🚀🚀", "emoji", "ability", ["🚀", "-"])]),
    ("plain", "en", "We like the flexible car.", [("the", "rule", "plain_language", ["a", "this"])]),
    ("plain", "en", "You are flexible.", [("are", "rule", "culture", ["remain", "stay"]), ("flexible", "rule", "filler", [])]),
    ("plain", "de", "Wenn sie gehen", [("sie", "rule", "binary_pronouns", [])]),
    ("plain", "de", "Gehen Sie jetzt", [("Sie", "rule", "formality", [])]),
    ("plain", "de", "Sie, gehen jetzt", [("Sie", "rule", "formality", [])]),
    ("plain", "de", "Sie geht jetzt", [("Sie", "rule", "binary_pronouns", [])]),
    ("plain", "de", "Sie haben Zeit", [("Sie", "rule", "formality", [])]),
    ("quiet", "de", "Sie haben Zeit", []),
    ("quiet", "de", "Sie haben Ihre Zeit", [("Sie", "rule", "formality", [])]),
    ("plain", "en", f"{THIRTY}.", [(f"{THIRTY}.", "long sentence", "plain_language", [])]),
    ("plain", "en", f"{THIRTY[:-10]}.", []),
    ("plain", "en", f"short:\n- {THIRTY}\n- {THIRTY[:-15]}", [(f"- {THIRTY}", "long sentence", "plain_language", [])]),
    (None, "en", "the end", [("the", "rule", "plain_language", ["a", "this"])]),
    ("unknown", "en", "the end", [("the", "rule", "plain_language", ["a", "this"])]),
    ("plain", "es", "the end", []),
    ("plain", "en", "", []),
    ("plain", "en", None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    from lexiscreen.packs import literal

    rows = packs.screen_rows() + RULES
    rows += [(400 + k, lang, words, "default", True, False, "", "corporate_rules", "default", None, False, None, None, None, 2, config, None) for k, (config, lang, words, _) in enumerate(TERMS)]
    old = packs.alternative_rows
    packs.alternative_rows = lambda: old() + [(400 + k, 1, new, False, False, False, "default", None, None) for k, (_, _, _, new) in enumerate(TERMS)]
    try:
        docs = spark.createDataFrame([(k, c[0], c[1], c[2]) for k, c in enumerate(CASES)], "doc_id int, config_id string, lang string, text string")
        configs = literal.frame(spark, packs.CONFIG_COLUMNS, CONFIGS)
        result = screen.findings(docs, spark, configs, literal.frame(spark, packs.SCREEN_COLUMNS, rows)).collect()
    finally:
        packs.alternative_rows = old
    said = {r["text"]: r["explanation"] for r in result}
    assert said[LONG].startswith("Ein langes Wort") and said["🚀🚀🚀"].startswith("Screen readers") and said[f"{THIRTY}."].startswith("A long sentence")
    assert said["🍔"] is None and said["for the"] == "cut"
    names = {v: k for k, v in packs.STAGES.items()}
    by: dict = {}
    for r in sorted(result, key=lambda r: (r["doc_id"], r["start"])):
        assert (CASES[r["doc_id"]][2])[r["start"] : r["end"]] == r["text"]
        by.setdefault(r["doc_id"], []).append((r["text"], names[r["stage"]], r["subcategory"], list(r["alternatives"])))
    return by


@pytest.mark.parametrize("k", range(len(CASES)))
def test_findings(found, k):
    assert found.get(k, []) == CASES[k][3]


def test_rules_for_parts_of_words_of_any_length(spark):
    from lexiscreen.operators import matching

    words = ["Feuerwehrmann", "mann", "XyZ", "ab", "a", "Bahnhof", "manm"]
    frame = spark.createDataFrame([("de", w) for w in words], "lang string, tok string")
    rules = [(1, "mann"), (2, "yz"), (3, "b"), (4, "hnho"), (5, "")]
    rows = [(i, "de", w, "substring", True, False, "", "titles", "default", None, False, None, None, None) for i, w in rules]
    from lexiscreen.packs import literal

    got = matching.substring_hits(frame, literal.frame(spark, packs.RULE_COLUMNS, rows)).select("tok", "rule_id").collect()
    assert sorted(map(tuple, got)) == [("Bahnhof", 3), ("Bahnhof", 4), ("Feuerwehrmann", 1), ("XyZ", 2), ("mann", 1)]  # `ab` is cut as a part of its own
