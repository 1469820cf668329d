"""Cells, inflection, coordination and agreement on written-out cases."""

import pytest

from lexiscreen.operators import coordination, declension, they, verbs
from lexiscreen.packs import literal


_DONE: dict = {}
_LISTS: dict = {}


def of(spark, cases, text, make, lang="de"):
    """Rows that ``make`` gives for one text; the texts of all cases go through it together."""
    texts = sorted({c[0] for c in cases})
    if id(cases) not in _DONE:
        docs = spark.createDataFrame([(k, lang, t) for k, t in enumerate(texts)], "doc_id int, lang string, text string")
        _DONE[id(cases)] = make(docs).collect()
    return [r for r in _DONE[id(cases)] if r["doc_id"] == texts.index(text)]


CELLS = [
    ("Wir danken dem Lehrer sehr.", "Lehrer", ["sg_dat"], "sg_dat"),
    ("Das ist das Haus des Lehrers.", "Lehrers", ["sg_gen"], "sg_gen"),
    ("Der Lehrer kommt.", "Lehrer", None, None),
    ("Ein guter Lehrer kommt.", "Lehrer", ["sg_nom"], "sg_nom"),
    ("Wir sehen den Kollegen.", "Kollegen", ["sg_acc", "pl_dat"], None),
    ("mit den Kollegen", "Kollegen", ["pl_dat"], "pl_dat"),
    ("für den Kollegen", "Kollegen", ["sg_acc"], "sg_acc"),
    ("mit dem netten jungen Kollegen", "Kollegen", ["sg_dat"], "sg_dat"),
    ("Der Kollege kommt.", "Kollege", ["sg_nom"], "sg_nom"),
    ("Die Lehrer kommen.", "Lehrer", ["pl_nom", "pl_acc"], None),
    ("Die Häuser der Lehrer", "Lehrer", ["sg_nom", "pl_gen"], None),
    ("wegen der Lehrerin", "Lehrerin", ["sg_gen", "sg_dat"], None),
    ("mit der Lehrerin", "Lehrerin", ["sg_dat"], "sg_dat"),
    ("mit den Kund*innen", "Kund*innen", ["pl_dat"], "pl_dat"),
    ("Lehrer- und Elternabend", "Lehrer-", [], "no_change"),
    ("Das ist es. Lehrer kommen.", "Lehrer", ["sg_nom", "sg_acc", "sg_dat", "pl_nom", "pl_acc", "pl_gen"], None),
]


@pytest.mark.parametrize("text,tok,cells,cell", CELLS)
def test_noun_cells(spark, text, tok, cells, cell):
    (row,) = [r for r in of(spark, CELLS, text, declension.noun_cells) if r["tok"] == tok]
    if cells is not None:
        assert sorted(row["cells"]) == sorted(cells)
    assert row["cell"] == cell


ALTERNATIVES = [
    ("mit dem Lehrer", "Lehrer", "Fachkraft", "Fachkraft", "der"),
    ("mit den Lehrern", "Lehrer", "Fachkraft", "Fachkräften", "den"),
    ("das Haus des Kollegen", "Kollege", "Mensch", "Menschen", "des"),
    ("für einen Kunden", "Kunde", "Person", "Person", "eine"),
    ("Die Kunden kommen.", "Kunde", "Person", "Personen", None),
    ("Der Verein kommt.", "Verein", "Team", "Team", "das"),
    ("trotz des Vereins", "Verein", "Team", "Teams", "des"),
    ("mit dem Kunden", "Kunde", "Unbekanntes", "Unbekanntes", None),
]


@pytest.mark.parametrize("text,base,alternative,suggestion,article", ALTERNATIVES)
def test_alternatives_take_the_cell(spark, text, base, alternative, suggestion, article):
    alts = literal.frame(spark, "base_form, alternative", sorted({(b, a) for _, b, a, _, _ in ALTERNATIVES}))
    rows = of(spark, ALTERNATIVES, text, lambda docs: declension.inflected(declension.noun_cells(docs), alts))
    (row,) = [r for r in rows if r["alternative"] == alternative and r["base_form"] == base]
    assert (row["suggestion"], row["new_article"]) == (suggestion, article)


VERBS = [
    ("de", "ist", "sein", "bleiben", "bleibt"),
    ("de", "führte", "führen", "leiten", "leitete"),
    ("de", "anzuführen", "anführen", "ansehen", "anzusehen"),
    ("de", "anzuführen", "anführen", "bleiben", "zu bleiben"),
    ("de", "angeführt", "anführen", "ansehen", "angesehen"),
    ("de", "angeführt", "anführen", "durchgehen", "durchgegehen"),
    ("de", "gekauft", "kaufen", "erwerben", "erwerbt"),
    ("de", "kaufte", "kaufen", "besorgen", "besorgte"),
    ("de", "kaufst", "kaufen", "besorgen", "besorgst"),
    ("de", "kaufst", "kaufen", "warten", "wartest"),
    ("de", "gewannen", "gewinnen", "siegen", "siegen"),
    ("en", "leads", "lead", "guide", "guides"),
    ("en", "led", "lead", "guide", "guided"),
    ("en", "leading", "lead", "guide", "guiding"),
    ("en", "taken", "take", "carry", "carried"),
    ("en", "takes", "take", "carry", "carries"),
    ("en", "mastering", "master", "tie", "tying"),
    ("en", "cracked", "crack", "take", "took"),
    ("en", "cracks", "crack", "push", "pushes"),
    ("en", "crack", "crack", "push", "push"),
]


@pytest.mark.parametrize("lang,source,lemma,target,want", VERBS)
def test_verbs_take_the_form_of_the_one_they_replace(spark, lang, source, lemma, target, want):
    if "verbs" not in _DONE:
        pairs = spark.createDataFrame([v[:4] for v in VERBS], "lang string, source string, lemma string, target string")
        _DONE["verbs"] = {r[:4]: r["aligned"] for r in verbs.aligned(pairs).collect()}
    assert _DONE["verbs"][lang, source, lemma, target] == want


def test_longest_loose_prefix(spark):
    want = {
        "ansehen": "an", "übereinkommen": "überein", "umherlaufen": "umher", "beibringen": None, "verstehen": None, "durchgehen": "durch", "durchdenken": None, "laufen": None,
    }
    got = verbs.with_prefix(spark.createDataFrame([(v,) for v in want], "target string")).collect()
    assert {r["target"]: r["prefix"] for r in got} == want


COORDINATED = [
    ("die*der Lehrer*in", None, ["sg_nom"]),
    ("des*der Lehrer*in", None, ["sg_gen"]),
    ("Der/die Lehrer/in", None, ["sg_nom"]),
    ("des Lehrers", None, ["sg_gen"]),
    ("den Lehrer*innen", None, ["pl_dat"]),
    ("den Lehrer(innen) und Kolleg*innen", None, ["pl_dat", "pl_dat"]),
    ("mit Lehrer*innen", None, [None]),
    ("mit Lehrer*innen", {1: "dativ"}, ["pl_dat"]),
    ("den Lehrer*innen und Kolleg*innen oder Student*innen sowie Kund*innen bzw. Geber*innen", None, ["pl_dat"] * 5),
    ("des Lehrers und Kolleg*innen und Lehrer*in", None, ["sg_gen", "pl_nom", "sg_gen"]),
    ("den Katzen und Lehrer*innen", None, ["pl_dat"]),
    ("und Lehrer*innen", None, [None]),
]


@pytest.mark.parametrize("text,morphology,want", COORDINATED)
def test_coordinated_nouns_share_their_case(spark, text, morphology, want):
    def make(docs):
        if morphology is None:
            return coordination.cases(docs)
        morph = [(d, i, c) for d in range(len(COORDINATED)) for i, c in morphology.items()]
        return coordination.cases(docs, spark.createDataFrame(morph, "doc_id int, i int, morph_case string"))

    own = [c for c in COORDINATED if c[1] == morphology]
    _LISTS.setdefault(str(morphology), own)
    assert [r["target"] for r in sorted(of(spark, _LISTS[str(morphology)], text, make), key=lambda r: r["i"])] == want


THEY = [
    ("So he is here.", "he is", "they are"),
    ("She has time.", "She has", "they have"),
    ("he builds houses", "he builds", "they build"),
    ("She builds, cleans and refurbishes houses.", "She builds, cleans and refurbishes", "they build, clean and refurbish"),
    ("he rests and ties , heats or rents things", "he rests and ties , heats or rents", "they rest and tie , heat or rent"),
    ("he and rents", "he and rents", "they and rent"),
    ("he was here", "he", "they"),
    ("then he", "he", "they"),
]


@pytest.mark.parametrize("text,changed,suggestion", THEY)
def test_they_changes_the_verbs_behind_it(spark, text, changed, suggestion):
    (row,) = of(spark, THEY, text, they.agreement, "en")
    assert (row["text"], row["suggestion"]) == (changed, suggestion)
