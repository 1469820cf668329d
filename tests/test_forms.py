from pyspark.sql import functions as F

from lexiscreen.functions import french, gender, inklusivum, privacy
from lexiscreen.operators import switch


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr).first()[0]


def test_every_format_reads_back(spark):
    rows = [(f, g, e) for f in gender.FORMATS for g in gender.FORMATS for e in ("innen", "in")]
    df = spark.createDataFrame(rows, "fmt string, target string, ending string")
    df = df.withColumn("written", F.concat(F.lit("Lehrer"), gender.render_ending(F.col("ending"), F.col("fmt"))))
    back = gender.convert_nouns(gender.convert_nouns(df).select("fmt", "ending", F.col("written").alias("was"), F.col("converted").alias("written"), F.col("fmt").alias("target")))
    assert all(r.converted == r.was for r in back.collect())


def test_noun_forms(spark):
    words = ["Lehrer*innen", "LehrerInnen", "Lehrer(innen)", "Lehrer/-in", "Lehrer", "der*die"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = [tuple(r) for r in df.select(gender.form_format(F.col("t")), gender.remove_ending(F.col("t")), gender.feminine_form(F.col("t"))).collect()]
    assert got[:4] == [("*in", "Lehrerinnen", "Lehrerin"), ("In", "LehrerInnen", "Lehrerin"), ("()", "Lehrerinnen", "Lehrerin"), ("/-in", "Lehrerin", "Lehrerin")]
    assert got[4] == (None, "Lehrer", None) and got[5][0] is None


def test_paradigm_cells(spark):
    pairs = [
        ("Schüler", "Schülerin", "Schülere", "Schülerne"), ("Kollege", "Kollegin", "Kollegere", "Kollegerne"),
        ("Arzt", "Ärztin", "Arzte", "Ärzterne"), ("Student", "Studentin", "Studente", "Studenterne"),
        ("Wanderer", "Wanderin", "Wandere", "Wanderne"), ("Bauer", "Bäuerin", "Bauere", "Bauerne"),
        ("Kaufmann", "Kauffrau", "Kaufperson", "Kaufleute"), ("Gast", "Gästin", "Gast", "Gast"), ("Alumnus", "Alumna", "Alumne", "Alumnerne"),
    ]
    df = spark.createDataFrame([p[:2] for p in pairs], "masculine string, feminine string")
    got = {(r.masculine, r.target): r.form for r in inklusivum.paradigm(df, targets=("sg_nom", "pl_nom", "pl_dat")).collect()}
    for masculine, _, singular, plural in pairs:
        assert got[masculine, "sg_nom"] == singular and got[masculine, "pl_nom"] == plural
    assert got["Schüler", "pl_dat"] == "Schülernen"


def test_articles(spark):
    from lexiscreen.catalog.scalars import article_frame

    pairs = {r.pair_key: (r.inclusive, r.grammatical_case) for r in inklusivum.article_pairs(article_frame(spark)).collect()}
    assert pairs["der~die"] == ("de", "nominativ") and pairs["zum~zur"] == ("zurm", None)


def test_french(spark):
    assert [one(spark, french.feminine_adjective(F.col("w")), w=x) for x in ("actif", "acteur", "roux", "complet", "net", "nouveau", "ancien")] == [
        "active", "actrice", "rousse", "complète", "nette", "nouvelle", "ancienne"
    ]
    parts = french.read(F.col("w"))
    shown = lambda target: french.render(parts["stem"], parts["suffix"], parts["plural"], F.lit(target))
    assert one(spark, shown("·"), w="enseignant.e.s") == "enseignant·es"
    assert one(spark, shown("/s"), w="enseignant·es") == "enseignant/e/s"
    assert one(spark, french.with_article(F.lit("la·le"), F.col("w")), w="étudiant") == "l'étudiant"


def test_masked_text_has_no_personal_data(spark):
    got = one(spark, privacy.mask(F.col("t")), t="Mail jo.doe@example.org, see https://example.org/a?b=1 or call 0123 456. ")
    assert got == "Mail <EMAIL>, see <URL> or call <NUMBER> <NUMBER>."


def test_switched_text_has_nothing_left_to_switch(spark):
    text = "Die Lehrer*innen und Schüler/-innen, Kolleg(inn)en, Ärzt:in; Angestellte(r), Lehrer_innengruppe"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for target in ("*in", ":in", "/-in", "()", "(-)"):
        done = switch.switch(df, target)
        left = switch.mismatches(done, target).count()
        assert left == 0, (target, done.first().text)
