"""A small rule pack.  Deployments load their own tables with the same columns
(`sources.lexicon.load_rules`); this one has function words that occur in any
text, plus rows for linguistic behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import literal

RULE_COLUMNS = (
    "rule_id, lang, words, rtype, lower_case, lemmatize, word_type, subcategories, pluralization, pattern,"
    " is_hr, source_id, parent_id, explanation"
)
# rule_id, lang, words, type, lower_case, lemmatize, word_type, subcategories,
# pluralization, pattern, is_hr, source_id, parent_id, explanation
RULES = [
    (1, "en", "the", "default", True, False, "", "plain_language", "default", None, False, 1, None, "say less"),
    (2, "en", "and that", "default", True, False, "", "filler|plain_language", "default", None, False, None, None, "long"),
    (3, "en", "with", "default", True, False, "", "culture", "default", None, True, 2, None, None),
    (4, "en", "for the", "default", True, False, "", "filler_advanced", "default", None, False, None, 1, "cut"),
    (5, "en", "be", "default", True, True, "v", "culture|gender_identity", "default", None, False, None, None, None),
    (6, "en", "That", "default", False, False, "", "slur", "default", None, False, 3, None, "hurts"),
    (7, "en", "he", "default", True, True, "pron", "gender_identity", "singular_only", None, False, None, None, "who?"),
    (8, "en", "of the", "default", True, False, "", "unknown_key|titles", "default", None, False, None, None, None),
    (9, "en", "to", "default", True, False, "", "", "default", None, False, None, None, None),
    (10, "en", "is and", "default", True, False, "", "function", "default", None, False, None, None, None),
    (11, "en", "colour", "default", True, False, "", "spelling", "default", None, False, None, None, None),
    (12, "en", "and", "default", True, False, "", "plain_language", "default", "l|article", False, None, None, None),
    (21, "de", "der", "default", True, False, "", "gender_identity", "default", None, False, None, None, "article"),
    (22, "de", "die", "default", True, False, "", "titles", "plural_only", None, False, 1, None, None),
    (23, "de", "und die", "default", True, False, "", "filler|titles", "default", None, False, None, None, "long"),
    (24, "de", "sein", "default", True, True, "v", "function", "default", None, True, None, None, None),
    (25, "de", "aber", "default", True, True, "conj", "filler", "default", None, False, None, None, "cut"),
    (26, "de", "heit", "suffix", True, False, "", "culture", "default", None, False, 2, None, None),
    (27, "de", "keit", "suffix", True, False, "", "plain_language", "default", None, False, None, None, "abstract"),
    (28, "de", "lich", "suffix", True, False, "", "filler_advanced", "default", None, False, None, None, None),
    (29, "de", "stschk", "substring", True, False, "", "slur", "default", None, False, None, None, "hurts"),
    (30, "de", "pftz", "substring", True, False, "", "culture", "default", None, False, None, None, None),
    (31, "de", "Die", "default", False, False, "", "formality", "default", None, False, None, None, None),
    (32, "de", "von der", "default", True, False, "", "function", "default", None, False, None, None, None),
    (33, "de", "sie", "default", True, False, "pron", "formality|binary_pronouns", "default", None, False, None, None, None),
    (41, "fr", "le", "default", True, False, "", "gender_identity", "singular_only", None, False, None, None, "article"),
    (42, "fr", "la", "default", True, False, "", "titles", "default", None, False, 1, None, None),
    (43, "fr", "de la", "default", True, False, "", "filler", "default", None, False, None, None, "long"),
    (44, "fr", "qui", "default", True, True, "pron", "plain_language", "default", "l|v", False, None, None, None),
    (45, "fr", "pour les", "default", True, False, "", "function", "default", None, False, None, None, None),
    (46, "fr", "être", "default", True, True, "v", "culture", "default", None, False, None, None, None),
]

ALTERNATIVE_COLUMNS = (
    "rule_id, ord, alt, is_remove, is_inspiration, is_placeholder, pluralization, label, word_type"
)
ALTERNATIVES = [
    (1, 1, "a", False, False, False, "default", None, "article"),
    (1, 2, "this", False, False, False, "default", "nearer", "pron"),
    (1, 3, "this", False, False, False, "default", "again", "pron"),
    (1, 4, "these", False, False, False, "plural_only", None, "pron"),
    (2, 1, "plus", False, False, False, "default", None, "conj"),
    (2, 2, "^and", False, False, False, "default", None, "conj"),
    (3, 1, "idea", False, True, False, "default", "think", "n"),
    (5, 1, "remain", False, False, False, "default", None, "v"),
    (5, 2, "stay", False, False, False, "default", None, "v"),
    (6, 1, None, True, False, False, "default", "drop it", None),
    (7, 1, "they", False, False, False, "default", None, "pron"),
    (8, 1, "of", False, False, False, "default", None, None),
    (21, 1, "de", False, False, False, "singular_only", None, "article"),
    (21, 2, "die", False, False, False, "default", None, "article"),
    (22, 1, "alle", False, False, False, "plural_only", None, "pron"),
    (23, 1, "sowie", False, False, False, "default", None, "conj"),
    (24, 1, "bleiben", False, False, False, "default", None, "v"),
    (26, 1, "[...]", False, False, True, "default", None, None),
    (27, 1, "Weise", False, True, False, "default", "try", "n"),
    (41, 1, "la·le", False, False, False, "default", None, "article"),
    (42, 1, "la·le", False, False, False, "default", None, "article"),
    (43, 1, "de la·du", False, False, False, "default", None, "article"),
    (46, 1, "rester", False, False, False, "default", None, "v"),
]

FALSE_POSITIVE_COLUMNS = "rule_id, false_positive"
FALSE_POSITIVES = [
    (1, "the and"), (1, "of the"), (1, "and the"), (3, "with of"), (6, "That is"), (7, "he and"),
    (21, "der die"), (21, "in der"), (22, "die und"), (41, "le de"), (42, "la qui"),
]

SOURCE_COLUMNS = "source_id, citation, url, is_citation_shown"
SOURCES = [(1, "Style guide", "https://example.org/1", True), (2, "Study", None, True), (3, "Hidden", None, False)]

LEMMA_COLUMNS = "lang, form, lemma, word_type, is_plural"
LEMMAS = [
    ("en", "is", "be", "v", False), ("en", "are", "be", "v", True), ("en", "was", "be", "v", False),
    ("en", "were", "be", "v", True), ("en", "his", "he", "pron", False), ("en", "the", "the", "article", False),
    ("en", "and", "and", "conj", False), ("en", "that", "that", "pron", False), ("en", "of", "of", "adp", False),
    ("de", "ist", "sein", "v", False), ("de", "war", "sein", "v", False), ("de", "sind", "sein", "v", True),
    ("de", "der", "der", "article", False), ("de", "die", "der", "article", True), ("de", "das", "der", "article", False),
    ("de", "und", "und", "conj", False), ("de", "sich", "sich", "pron", False), ("de", "nicht", "nicht", "adv", False),
    ("fr", "est", "être", "v", False), ("fr", "sont", "être", "v", True), ("fr", "le", "le", "article", False),
    ("fr", "la", "le", "article", False), ("fr", "les", "le", "article", True), ("fr", "et", "et", "conj", False),
    ("fr", "qui", "qui", "pron", False),
]

TAXONOMY_COLUMNS = "key, parent, level, icon, label_en, label_de, ord"
TAXONOMY = [
    ("gender-orientation", None, None, "🏳", "Gender", "Geschlecht", 1),
    ("gender_identity", "gender-orientation", "basic", "👤", "Identity", "Identität", 2),
    ("titles", "gender-orientation", "basic", "🎩", "Titles", None, 3),
    ("function", "gender-orientation", "promoting", "💼", "Function", "Funktion", 4),
    ("binary_pronouns", "gender-orientation", "basic", "⚥", "Pronouns", None, 5),
    ("clarity", None, None, "✏", "Clarity", "Klarheit", 6),
    ("plain_language", "clarity", "basic", "📖", "Plain language", "Einfache Sprache", 7),
    ("filler", "clarity", "basic", "🫧", "Filler", "Füllwort", 8),
    ("formality", "clarity", "promoting", "🤝", "Formality", None, 9),
    ("origin", None, None, "🌍", "Origin", "Herkunft", 10),
    ("culture", "origin", "basic", "🎭", "Culture", "Kultur", 11),
    ("slur", "origin", "openly_discriminating", "⛔", "Slur", None, 12),
    ("orthography", None, None, "🔤", "Orthography", "Rechtschreibung", 13),
    ("spelling", "orthography", None, "🔡", "Spelling", None, 14),
    ("gender_specific_abbreviation", "gender-orientation", "basic", "🔣", "Abbreviation", None, 15),
    ("gendered_denominations_ending", "gender-orientation", "basic", "✳", "Gender format", "Genderform", 16),
    ("d_and_i", "gender-orientation", "promoting", "🤲", "Inclusive form", "Inklusive Form", 17),
    ("sexual_orientation", "gender-orientation", "basic", "💞", "Orientation", None, 18),
    ("access", None, None, "♿", "Access", "Zugang", 19),
    ("ability", "access", "basic", "👓", "Ability", None, 20),
    ("belief", "origin", "basic", "🛐", "Belief", "Glaube", 21),
    ("sports_terms", "origin", "basic", "🏏", "Sports", None, 22),
    ("military_source", "origin", "basic", "🕊", "Military", None, 23),
    ("offensive_language", "origin", "openly_discriminating", "🛑", "Offence", None, 24),
    ("corporate_rules", None, None, "🏢", "House rules", "Hausregeln", 25),
]
LEVEL_COLUMNS = "level, inclusive"
LEVELS = [("basic", False), ("promoting", True), ("openly_discriminating", False)]

#: Columns that the whole check adds to a rule: the stage it runs in, the configuration it belongs to, its label.
SCREEN_COLUMNS = RULE_COLUMNS + ", stage, config_id, label_type"
STAGES = {"french ending": 0, "french pair": 1, "term": 2, "abbreviation": 3, "emoji": 4, "hashtag": 5, "rule": 6, "suffix": 7, "substring": 8, "german ending": 9, "long word": 10, "long sentence": 11}
#: What a word is reported for by its shape: id, language, key, stage, subcategories.
SHAPE_RULES = [
    (901, "fr", "french own form", "french ending", "d_and_i"),
    (902, "fr", "french other form", "french ending", "gendered_denominations_ending_advanced"),
    (903, "fr", "french pair", "french pair", "gendered_denominations_ending_advanced"),
    (904, "en", "abbreviation", "abbreviation", "gender_specific_abbreviation"),
    (905, "de", "abbreviation", "abbreviation", "gender_specific_abbreviation"),
    (906, "fr", "abbreviation", "abbreviation", "gender_specific_abbreviation"),
    (907, "en", "hashtag", "hashtag", "plain_language"),
    (908, "de", "hashtag", "hashtag", "plain_language"),
    (909, "fr", "hashtag", "hashtag", "plain_language"),
    (910, "de", "german own form", "german ending", "d_and_i"),
    (911, "de", "german other form", "german ending", "gendered_denominations_ending_advanced"),
    (912, "en", "long word", "long word", "plain_language"),
    (913, "de", "long word", "long word", "plain_language"),
    (914, "fr", "long word", "long word", "plain_language"),
]
EMOJI_RULE, SENTENCE_RULE = 920, 921
#: Words that a configuration wants replaced: id, configuration, language, words, what to write.
TERMS = [(951, "src0", "en", "for the", "to the"), (952, "src0", "de", "und die", "sowie die"), (953, "src5", "fr", "pour", "afin de"), (954, "src7", "en", "with", "alongside")]
#: Rules that hold for people only.
PEOPLE_RULES = [(961, "en", "only", "filler"), (962, "en", "reed", "culture"), (963, "de", "nicht", "filler")]
#: Settings of a writer or an organisation; what is not set is the default.
CONFIG_COLUMNS = "config_id, disabled, ignored, german_format, french_format, most, hr"
CONFIGS = [
    ("src0", "culture", "of the|und", "*in", "·", 3, True),
    ("src3", "plain_language", "", ":in", "·s", 1, False),
    ("src5", "gender-orientation|filler_advanced", "le", "In", "/", 5, True),
    ("src8", "", "", "(-)", ".", 0, False),
]
DEFAULT_CONFIG = (None, "", "", "*in", "·", 5, True)

US_COLUMNS = "uk, us"
US_SPELLING = [("thour", "thor"), ("our", "or"), ("colour", "color"), ("ise", "ize")]


def _load(spark: SparkSession, columns: str, rows) -> DataFrame:
    return literal.frame(spark, columns, rows)


def rules(spark: SparkSession) -> DataFrame:
    return _load(spark, RULE_COLUMNS, RULES)


def screen_rows() -> list[tuple]:
    """All rules of the whole check in one table."""
    stage = {"default": "rule", "suffix": "suffix", "substring": "substring"}
    rows = [(*r, STAGES[stage[r[3]]], None, None) for r in RULES]
    shape = lambda i, lang, words, kind, sub, name, config=None, label=None: (
        i, lang, words, kind, True, False, "", sub, "default", None, False, None, None, None, STAGES[name], config, label
    )
    rows += [shape(i, lang, key, "shape", sub, name) for i, lang, key, name, sub in SHAPE_RULES]
    rows += [shape(i, lang, words, "default", "corporate_rules", "term", config) for i, config, lang, words, _ in TERMS]
    return rows + [shape(i, lang, words, "default", sub, "rule", None, "not_for_people") for i, lang, words, sub in PEOPLE_RULES]


def screen_rules(spark: SparkSession) -> DataFrame:
    return _load(spark, SCREEN_COLUMNS, screen_rows())


def alternative_rows() -> list[tuple]:
    return ALTERNATIVES + [(i, 1, new, False, False, False, "default", None, None) for i, _, _, _, new in TERMS]


def configs(spark: SparkSession) -> DataFrame:
    return _load(spark, CONFIG_COLUMNS, CONFIGS)


def alternatives(spark: SparkSession) -> DataFrame:
    return _load(spark, ALTERNATIVE_COLUMNS, ALTERNATIVES)


def false_positives(spark: SparkSession) -> DataFrame:
    return _load(spark, FALSE_POSITIVE_COLUMNS, FALSE_POSITIVES)


def sources(spark: SparkSession) -> DataFrame:
    return _load(spark, SOURCE_COLUMNS, SOURCES)


def lemmas(spark: SparkSession) -> DataFrame:
    return _load(spark, LEMMA_COLUMNS, LEMMAS)


def taxonomy(spark: SparkSession) -> DataFrame:
    return _load(spark, TAXONOMY_COLUMNS, TAXONOMY)


def levels(spark: SparkSession) -> DataFrame:
    return _load(spark, LEVEL_COLUMNS, LEVELS)
