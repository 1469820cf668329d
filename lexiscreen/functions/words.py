"""Word shapes: case, prefixes, lengths, offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it: a column that a filter or a later column
    names is written out, and worked out, in each place."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def drop_last(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - n)


def fold_umlauts(text: Column) -> Column:
    return F.translate(text, "äöü", "aou")


def common_prefix(one: Column, other: Column, lower: bool = True, umlauts: bool = True) -> Column:
    """Longest common prefix; empty where the words differ in how many `ä` they have."""
    a = fold_umlauts(one) if umlauts else one
    a = F.lower(a) if lower else a
    b = fold_umlauts(other) if umlauts else other
    count = lambda t: F.regexp_count(F.lower(t), F.lit("ä"))
    size = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))),
        F.lit(0),
        lambda n, k: F.when((n == k - 1) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
                            & (k <= F.length(b)), k).otherwise(n),
    )
    return F.when(count(one) != count(other), F.lit("")).otherwise(F.substring(a, F.lit(1), size))


def word_case(text: Column, first_upper: bool | None = None) -> Column:
    """Every hyphen part in lower case, optionally after a first letter of the
    given case; false for a trailing dash."""
    rest = lambda w: F.substring(w, F.lit(2), F.length(w)) if first_upper is not None else w
    lowered = lambda w: (rest(w) == F.lower(rest(w))) & rest(w).rlike(r"\p{Ll}")
    upper = lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}")
    first = lambda w: F.lit(True) if first_upper is None else (upper(w) if first_upper else ~upper(w))
    return ~text.endswith("-") & F.forall(F.split(text, "-"), lambda w: (w == "") | (first(w) & lowered(w)))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; a character outside the basic plane takes two."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def truncate(text: Column, limit: int) -> tuple[Column, Column]:
    """The text cut to ``limit`` characters and back to the last blank, and
    whether it was cut."""
    cut = F.substring(text, 1, limit)
    reached = F.length(text) > limit
    whole = F.when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(reached, whole).otherwise(text), reached


def parse_word_type(spec: Column, lower_case: bool = True) -> Column:
    """(word_type, lower_case, lemmatize) from a marked word type: `~` exact in
    any case, `=` exact in this case, `-` lemmatised in this case."""
    mark = F.substring(spec, 1, 1)
    marked = mark.isin("~", "=", "-")
    return F.struct(
        F.when(marked, F.substring(spec, F.lit(2), F.length(spec))).otherwise(spec).alias("word_type"),
        F.when(mark == "~", True).when(mark.isin("=", "-"), False).otherwise(F.lit(lower_case)).alias("lower_case"),
        (~mark.isin("~", "=")).alias("lemmatize"),
    )


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.regexp_count(text, F.lit(r"[^ \t\r\n\f\x{b}\x{a0}]+")))


def long_word(tok: Column) -> Column:
    """Longer than 18 characters, and one part or a part longer than 12."""
    parts = F.split(tok, r"[/@:._-]")
    return (F.length(tok) > 18) & ((F.size(parts) == 1) | F.exists(parts, lambda p: F.length(p) > 12))


def a_or_an(word: Column) -> Column:
    return F.concat(F.when(F.lower(F.substring(word, 1, 1)).isin(*"aeiou"), "an ").otherwise("a "), word)


#: Frequent words by language, for texts that name none.
STOPWORDS = {"en": "the of and is that with".split(), "de": "der die und das ist nicht".split(), "fr": "le la les et est que".split()}


def stopword_language(text: Column) -> Column:
    """The language with most of its frequent words in the text, the first of equal ones; NULL without any."""
    # A word is letters between others: the texts are searched for the few words, without a list of all they hold.
    said = lambda listed: f"(?=[{''.join(sorted({x[0] for x in listed}))}])(?<!\\p{{L}})(?:{'|'.join(listed)})(?!\\p{{L}})"
    count = lambda listed: F.regexp_count(F.lower(text), F.lit(said(listed)))
    hits = [F.struct(count(listed).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, listed) in enumerate(STOPWORDS.items())]
    # Without any, no language comes first.
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("k"), F.lit(None).cast("string").alias("lang"))
    return F.array_max(F.array(none, *hits))["lang"]


def stopword_sql(text: str) -> str:
    """The same in plain SQL."""
    count = lambda listed: f"len(list_filter(regexp_extract_all(lower({text}), '\\p{{L}}+'), lambda x: x IN {tuple(listed)}))"
    counts = {lang: count(listed) for lang, listed in STOPWORDS.items()}
    whens = " ".join(f"WHEN {n} THEN '{lang}'" for lang, n in counts.items())
    return f"CASE greatest({', '.join(counts.values())}) WHEN 0 THEN NULL {whens} END"
