from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiscreen.functions import words as w
from lexiscreen.operators.guardrail import part_pattern
from lexiscreen.operators.tokens import sentences, tokens
from lexiscreen.sources import texts as src


def texts(spark, *rows):
    return spark.createDataFrame([(k, "de", t) for k, t in enumerate(rows)], "doc_id long, lang string, text string")


def test_offsets_slice_to_the_token(spark):
    df = texts(spark, "  Die Lehrer*innen (m/w) sagen: l'été!\nGut.", "ein Wort 😀 x", "", None)
    rows = df.join(tokens(df), "doc_id").collect()
    assert rows and all(r.text[r.start : r.end] == r.tok for r in rows)
    assert "Lehrer*innen" in {r.tok for r in rows}


def test_neighbours_and_pieces_rebuild_the_text(spark):
    text = "eins zwei, drei.\nvier fünf sechs sieben"
    rows = tokens(texts(spark, text), prev=2, next=3).orderBy("i").collect()
    assert "".join(r.tok + r.ws for r in rows) == text
    assert [p.strip() for p in rows[2].prev] == ["eins", "zwei"]
    assert [p.strip() for p in rows[0].next] == ["zwei", ",", "drei"]


def test_long_text_in_one_batch(spark):
    text = "wort " * 150_000
    got = tokens(texts(spark, text), prev=1).agg(F.count("*"), F.max("end")).first()
    assert got[0] == 150_000 and got[1] == len(text) - 1


def test_corpus_offsets(spark, folder):
    docs = src.documents(spark, folder).filter("length(text) < 3000")
    joined = docs.join(tokens(docs).drop("lang"), "doc_id")
    assert joined.filter("substring(text, start + 1, end - start) <> tok").count() == 0


def test_sentences(spark):
    rows = sentences(texts(spark, "Eins. Zwei!  \n Drei")).collect()
    assert [r.sentence for r in rows] == ["Eins.", "Zwei!", "Drei"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. !?\n", max_size=120), st.integers(min_value=2, max_value=30))
def test_parts_are_the_text(text, size):
    cut = [(m.start(), m[0]) for m in part_pattern(size).finditer(text)]
    assert "".join(part for _, part in cut) == text
    assert all(len(part) <= size and text[at : at + len(part)] == part for at, part in cut)


def test_utf16_and_prefix(spark):
    row = spark.createDataFrame([("a😀b", "Käufer", "Käuferin", "Arzt", "Ärztin")], "t string, a string, b string, c string, d string")
    got = row.select(
        w.utf16_length(F.col("t")), w.common_prefix(F.col("a"), F.col("b"), False, False), w.common_prefix(F.col("c"), F.col("d"), False, False)
    ).first()
    assert tuple(got) == (4, "Käufer", "")
