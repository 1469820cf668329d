"""Switching a corpus to one gender format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gender
from ..packs import fixed

# A noun with an ending in any separator format, inside a text.  Only `innen`
# may go on as a compound (`Lehrer*innengruppe`); the short endings end the word.
_NOUN = "([A-ZÄÖÜ][a-zäöüß]+)"
_SHORT = "|".join(p for p in fixed.GENDER_PARTS if p != "innen")
_ENDING = f"(innen|(?:{_SHORT})(?![a-zäöüß]))"
_SEPARATED = rf"{_NOUN}(/-|[*_:/]){_ENDING}"
_BRACKETED = rf"{_NOUN}(\(-?)({'|'.join(fixed.GENDER_PARTS)})\)"


def mismatches(texts: DataFrame, target: str) -> DataFrame:
    """(doc_id, written, stem, ending, found_format, converted): forms written in
    another format than ``target``.  One pass over the text per shape."""

    def hits(pattern):
        return F.transform(
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
            lambda written: F.struct(
                written.alias("written"),
                F.regexp_extract(written, f"^{pattern}", 1).alias("stem"),
                F.regexp_extract(written, f"^{pattern}", 2).alias("mark"),
                F.regexp_extract(written, f"^{pattern}", 3).alias("ending"),
            ),
        )

    found = texts.select("doc_id", F.inline_outer(F.concat(hits(_SEPARATED), hits(_BRACKETED)))).filter("written IS NOT NULL")
    mark = F.col("mark")
    fmt = F.when(mark == "(", "()").when(mark == "(-", "(-)").otherwise(F.concat(mark, F.lit("in")))
    rows = found.select("doc_id", "written", "stem", "ending", fmt.alias("found_format"))
    converted = F.concat("stem", gender.render_ending(F.col("ending"), F.lit(target)))
    return rows.filter(F.col("found_format") != target).withColumn("converted", converted)


def switch(texts: DataFrame, target: str) -> DataFrame:
    """(doc_id, text) with every separator form rewritten to ``target``.  Forms
    never overlap: each is first marked by two control characters, then the
    marks are written in the target format, all in native expressions."""
    text = F.regexp_replace("text", _BRACKETED, "$1\x01$3\x02")
    text = F.regexp_replace(text, _SEPARATED, "$1\x01$3\x02")
    if target == "In":
        text = F.replace(F.replace(text, F.lit("\x01in"), F.lit("In")), F.lit("\x01"), F.lit("/"))
        return texts.withColumn("text", F.replace(text, F.lit("\x02"), F.lit("")))
    marks = {"()": ("(", ")"), "(-)": ("(-", ")")}.get(target) or (gender.NOUN_SEPARATORS[target], "")
    return texts.withColumn("text", F.replace(F.replace(text, F.lit("\x01"), F.lit(marks[0])), F.lit("\x02"), F.lit(marks[1])))
