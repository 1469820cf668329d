"""Texts to tokens and sentences, with exact code point offsets.

A text is cut into *pieces* (a token plus the blanks after it) by one regular
expression; an offset is where a piece was found.  The cut runs over Arrow
batches inside the scan's own tasks: no shuffle, linear in the text, output in
bounded batches.  (The same cut as higher-order functions was measured at four
times the time: a running sum over an array is evaluated without code
generation.)  Neighbouring pieces travel with a token as a bounded slice
(``prev`` / ``next``), so phrase, pattern and window checks need no shuffle either.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blanks and letters, as the inside of a character class.  Spelled out, because
# `\s` and `\w` mean different characters in different dialects.
BLANKS = r" \t\r\n\f\x{b}\x{a0}"
LETTERS = r"\p{L}\p{N}_"
# A word keeps inner hyphens and gender separators (`Lehrer*innen`,
# `Lehrer:innen`, `enseignant·e`), a trailing dash (`Kunden-`) and an elision
# apostrophe (`l'`).  Slashes and brackets are tokens of their own.
WORD = rf"[{LETTERS}]+(?:[-*:·][{LETTERS}]+)*-?['’]?"
PIECE = rf"(?:{WORD}|[^{BLANKS}])[{BLANKS}]*|[{BLANKS}]+"

_PY_BLANKS = " \t\r\n\f\x0b\xa0"
_PY_PIECE = PIECE.replace(r"\x{b}", "\x0b").replace(r"\x{a0}", "\xa0").replace(rf"[{LETTERS}]", r"\w")
_PY_WORDS = f"[^{_PY_BLANKS}]+[{_PY_BLANKS}]*|[{_PY_BLANKS}]+"
_FLUSH = 1 << 16


def _near(pieces: pa.Array, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """List column whose row k is pieces[first[k]:last[k]]."""
    sizes = last - first
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(first, sizes)
    return pa.ListArray.from_arrays(pa.array(offsets), pieces.take(pa.array(index)))


class Wanted:
    """Which tokens a caller has a use for, asked where the text is cut: the others, and their neighbourhoods, never leave that
    task.  It may say yes too often, as the caller's own conditions follow.

    ``word`` is asked once per distinct piece, with its token and the piece; ``before`` tells a piece whose predecessor
    is wanted, ``after`` a piece whose successor is; ``pair`` are questions to a piece and to the one behind it that
    together want the first; ``sentences`` adds the other tokens of a sentence with a wanted one."""

    def __init__(self, word, before=None, after=None, pair=None, sentences: bool = False):
        self.word, self.before, self.after, self.pair, self.sentences = word, before, after, pair, sentences

    def mask(self, pieces: list[str], sentence: np.ndarray, known: tuple[_Known, ...]) -> np.ndarray:
        """``sentence`` numbers the sentences of the block; ``known`` holds what was answered before."""
        wanted = _asked(lambda p: self.word(p.rstrip(_PY_BLANKS), p), pieces, known[0])
        if self.before is not None:
            wanted[:-1] |= _asked(self.before, pieces, known[1])[1:]
        if self.after is not None:
            wanted[1:] |= _asked(self.after, pieces, known[2])[:-1]
        if self.pair is not None:
            begins = np.flatnonzero(_asked(self.pair[0], pieces[:-1], known[3]))
            wanted[begins[_asked(self.pair[1], [pieces[k + 1] for k in begins], known[4])]] = True
        if self.sentences:
            wanted = np.isin(sentence, sentence[wanted])
        return wanted


#: Answers that a task keeps.
_KNOWN = 1 << 17


class _Known(dict):
    """What was answered before; a piece that is new is asked when it is looked up."""

    def __missing__(self, piece):
        said = self[piece] = self.question(piece)
        return said


def _asked(question, pieces: list[str], known: _Known) -> np.ndarray:
    if len(known) > _KNOWN:
        known.clear()
    known.question = question
    return np.fromiter(map(known.__getitem__, pieces), bool, len(pieces))


def _cut(keep, text, prev, next, words_only, only=None):
    pattern = re.compile(_PY_WORDS if words_only else _PY_PIECE)
    names = [*keep, "i", "piece", "start", "sent"] + (["prev", "next"] if prev or next else [])

    def emit(batch, rows, found, sizes, known):
        """Columns of the collected texts: everything but the cut is vectorised."""
        piece = pa.array(found, pa.string())
        sizes = np.array(sizes)
        first = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        at = np.arange(len(found))
        running = lambda n: np.cumsum(n) - n
        within = lambda n: (running(n) - running(n)[first]).astype(np.int32)
        length = pc.utf8_length(piece).to_numpy()
        ends = pc.count_substring_regex(piece, "^[.!?]|\n").to_numpy()
        row, start, sent, last = np.repeat(rows, sizes), within(length), within(ends), first + np.repeat(sizes, sizes)
        said = piece
        if only is not None:
            begins = (at == first) | (np.diff(sent, prepend=0) != 0)
            at = np.flatnonzero(only.mask(found, np.cumsum(begins), known))
            first, row, start, sent, last, said = first[at], row[at], start[at], sent[at], last[at], piece.take(pa.array(at))
        columns = [batch.column(c).take(pa.array(row)) for c in keep]
        columns += [pa.array((at - first).astype(np.int32)), said, pa.array(start), pa.array(sent)]
        if prev or next:
            columns += [_near(piece, np.maximum(at - prev, first), at)]
            columns += [_near(piece, at + 1, np.minimum(at + 1 + next, last))]
        out = pa.RecordBatch.from_arrays(columns, names=names)
        for k in range(0, out.num_rows, _FLUSH):
            yield out.slice(k, _FLUSH)

    def run(batches):
        known = tuple(_Known() for _ in range(5))
        for batch in batches:
            rows, found, sizes = [], [], []
            for row, value in enumerate(batch.column(text)):
                value = value.as_py()
                if not value:
                    continue
                cut = pattern.findall(value)
                found += cut
                rows.append(row)
                sizes.append(len(cut))
                if len(found) >= _FLUSH:
                    yield from emit(batch, rows, found, sizes, known)
                    rows, found, sizes = [], [], []
            if found:
                yield from emit(batch, rows, found, sizes, known)

    return run


def piece_token(piece: Column) -> Column:
    """The token of a piece: the piece without the blanks after it."""
    return F.rtrim(piece, F.lit(_PY_BLANKS))


def tokens(
    texts: DataFrame,
    keep: tuple[str, ...] = ("doc_id", "lang"),
    text: str = "text",
    prev: int = 0,
    next: int = 0,
    words_only: bool = False,
    only: Wanted | None = None,
) -> DataFrame:
    """One row per token: ``keep`` columns, ``i``, ``tok``, ``ws`` (the blanks
    after it), ``start``, ``end``, ``sent`` (a sentence number: boundary
    characters so far) and, if asked for, the pieces before it (``prev``,
    nearest last) and after it (``next``, nearest first).  A text that starts
    with blanks has no token 0.  ``words_only`` cuts at blanks alone; ``only`` leaves out tokens nobody asks for."""
    fields = [texts.schema[c] for c in keep]
    fields += [
        T.StructField("i", T.IntegerType()),
        T.StructField("piece", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("sent", T.IntegerType()),
    ]
    columns = [*keep, "i", "tok", F.substring("piece", F.length("tok") + 1, F.length("piece")).alias("ws"), "start"]
    columns += [(F.col("start") + F.length("tok")).alias("end"), "sent"]
    if prev or next:
        fields += [T.StructField(n, T.ArrayType(T.StringType())) for n in ("prev", "next")]
        columns += ["prev", "next"]
    cut = texts.select(*keep, F.col(text).alias("_text")).mapInArrow(_cut(keep, "_text", prev, next, words_only, only), T.StructType(fields))
    return cut.withColumn("tok", piece_token(F.col("piece"))).filter(F.col("tok") != "").select(*columns)


def _aligned(keep, text):
    pieces, words = re.compile(_PY_PIECE), re.compile(_PY_WORDS)
    names = [*keep, "i", "word"]

    def placed(found):
        """Where each piece starts in the block, and its token and that token's length."""
        piece = pa.array(found, pa.string())
        token, length = pc.utf8_rtrim(piece, _PY_BLANKS), pc.utf8_length(piece).to_numpy()
        return np.cumsum(length) - length, token, pc.utf8_length(token).to_numpy()

    def emit(batch, rows, sizes, found, gold):
        (start, _, length), (place, word, size) = placed(found), placed(gold)
        _, one, other = np.intersect1d(start, place, assume_unique=True, return_indices=True)
        same = (length[one] == size[other]) & (length[one] > 0)
        one, other = one[same], other[same]
        sizes = np.array(sizes)
        first, row = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(rows, sizes)
        columns = [batch.column(c).take(pa.array(row[one])) for c in keep]
        return pa.RecordBatch.from_arrays([*columns, pa.array((one - first[one]).astype(np.int32)), word.take(pa.array(other))], names=names)

    def run(batches):
        for batch in batches:
            rows, sizes, found, gold = [], [], [], []
            for row, value in enumerate(batch.column(text)):
                value = value.as_py()
                if not value:
                    continue
                cut = pieces.findall(value)
                found += cut
                gold += words.findall(value)
                rows.append(row)
                sizes.append(len(cut))
                if len(found) >= _FLUSH:
                    yield emit(batch, rows, sizes, found, gold)
                    rows, sizes, found, gold = [], [], [], []
            if found:
                yield emit(batch, rows, sizes, found, gold)

    return run


def aligned(texts: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``i`` and ``word``: the tokens of a text that begin and end where a word between blanks does.  Both cuts of a
    text are made in one pass, so neither is shuffled to the other."""
    fields = [texts.schema[c] for c in keep] + [T.StructField("i", T.IntegerType()), T.StructField("word", T.StringType())]
    return texts.select(*keep, F.col(text).alias("_text")).mapInArrow(_aligned(keep, "_text"), T.StructType(fields))


def vocabulary(token_table: DataFrame) -> DataFrame:
    """Distinct (lang, token) with its frequency.  Work that depends on the
    word alone runs here once per form, not once per occurrence."""
    return token_table.groupBy("lang", "tok").agg(F.count("*").alias("n"))


_PY_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]|[^.!?\n]+")


def sentences(texts: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), text: str = "text") -> DataFrame:
    """Sentence spans: up to and including a boundary character, blank ones
    dropped, leading spaces not counted.  One pass over a text, in bounded batches."""
    names = [*keep, "sent_no", "start", "end", "sentence"]

    def run(batches):
        for batch in batches:
            rows, found = [], []

            def emit():
                numbers, starts, ends, said = zip(*found)
                kept = [batch.column(c).take(pa.array(rows)) for c in keep]
                spans = [pa.array(c, pa.int32()) for c in (numbers, starts, ends)]
                return pa.RecordBatch.from_arrays([*kept, *spans, pa.array(said, pa.string())], names=names)

            for row, value in enumerate(batch.column("_text").to_pylist()):
                number = 0
                for m in _PY_SENTENCE.finditer(value or ""):
                    said = m[0].lstrip(" ")
                    if said.strip(_PY_BLANKS):
                        rows.append(row)
                        found.append((number, m.end() - len(said), m.end(), said))
                        number += 1
                    if len(found) >= _FLUSH:
                        yield emit()
                        rows, found = [], []
            if found:
                yield emit()

    fields = [T.StructField(n, T.IntegerType()) for n in ("sent_no", "start", "end")] + [T.StructField("sentence", T.StringType())]
    return texts.select(*keep, F.col(text).alias("_text")).mapInArrow(run, T.StructType([texts.schema[c] for c in keep] + fields))
