"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled sample knows every substring of the sample.  A text is parsed greedily
into the longest substrings that the automaton knows; the language that needs the fewest phrases wins.

Texts are cut into pieces of PIECE bytes, and all pieces of a batch step through the automata side by side, one byte
at a time, as array operations.  A cut costs each language one phrase at most.  Work is linear in the text, and memory
is bounded by the batch and by the samples, whose size is a parameter."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, table

#: Sample of a language: bytes at most, from so many different labelled texts, so many code points of each.
SAMPLE_BYTES, SAMPLE_TEXTS, SAMPLE_PIECE = 32_768, 128, 256
#: All samples together have this many bytes at most: above 32 languages each gets an equal share.
ALL_SAMPLES = 1 << 20
PIECE = 256
#: Texts are worked on in blocks of about so many bytes.
BLOCK_BYTES = 4 << 20
#: Bytes of letters and of everything beyond ASCII, lower-cased; all else is a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_models: dict[str, tuple] = {}


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that knows all substrings of ``data``; state 0 is the start."""
    moves, links, lengths, last = [{}], [-1], [0], 0
    for byte in data:
        state = len(moves)
        moves.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        p = last
        while p >= 0 and byte not in moves[p]:
            moves[p][byte] = state
            p = links[p]
        if p >= 0:
            q = moves[p][byte]
            if lengths[p] + 1 == lengths[q]:
                links[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                while p >= 0 and moves[p].get(byte) == q:
                    moves[p][byte] = copy
                    p = links[p]
                links[q] = links[state] = copy
        last = state
    return moves


def compile_models(samples: dict[str, bytes]) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """Languages in order, the symbol of each byte (0: in no sample), and a flat table of moves for each language.
    Entries are states times the number of symbols; 0 means that the phrase ends."""
    names = sorted(samples)
    used = sorted(set().union(*(samples[n] for n in names)))
    symbols = np.zeros(256, np.int64)
    symbols[used] = np.arange(1, len(used) + 1)
    width, tables = len(used) + 1, []
    for name in names:
        moves = suffix_automaton(samples[name])
        flat = np.zeros(len(moves) * width, np.int32)
        for state, out in enumerate(moves):
            for byte, to in out.items():
                flat[state * width + symbols[byte]] = to * width
        tables.append(flat)
    return names, symbols.astype(np.uint8 if width < 256 else np.int16), tables


def phrases(pieces: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Phrases that each piece parses into.  ``pieces`` holds symbols; pieces come longest first."""
    state, count = np.zeros(len(starts), np.int32), np.ones(len(starts), np.int64)
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    for step, n in enumerate(active):
        symbol = pieces[starts[:n] + step].astype(np.int32)
        there = moves[state[:n] + symbol]
        ended = there == 0
        if step:  # a phrase begins where the last one cannot go on, and behind a symbol that is in no phrase
            count[:n] += ended | (state[:n] == 0)
        there[ended] = moves[symbol[ended]]
        state[:n] = there
    return count


def parse(texts: list[bytes], model: tuple) -> np.ndarray:
    """Matrix of phrase counts: a row for each text, a column for each language."""
    names, symbols, tables = model
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    pieces = symbols[np.frombuffer(b"".join(texts), np.uint8)]
    per_text = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(texts)), per_text)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = offsets[owner] + within * PIECE
    lengths = np.minimum(PIECE, offsets[owner + 1] - starts)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, owner = starts[order], lengths[order], owner[order]
    out = np.zeros((len(texts), len(names)))
    for k, moves in enumerate(tables):
        out[:, k] = np.bincount(owner, phrases(pieces, starts, lengths, moves), len(texts))
    return out


def has_letter(text: bytes) -> bool:
    return bool(text.translate(NORMAL, bytes(range(0x80, 256))).strip()) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES):
    """The texts of a batch in blocks of about ``limit`` bytes, as (first position, list of bytes or None)."""
    block, size, first = [], 0, 0
    for k, text in enumerate(texts):
        data = text.as_buffer().to_pybytes() if text.is_valid else None
        block.append(data)
        size += len(data or b"")
        if size >= limit:
            yield first, block
            block, size, first = [], 0, k + 1
    if block:
        yield first, block


def predictor(shared):
    """A column function from text to struct(lang, score)."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        name, samples = shared.value
        if name not in _models:
            _models.clear()
            _models[name] = compile_models(samples) if samples else ([], None, [])
        model, langs, scores = _models[name], [], []
        for _, block in blocks(texts):
            letters = [t is not None and has_letter(t) for t in block]
            if not model[0]:
                langs += ["und"] * len(block)
                scores += [0.0] * len(block)
                continue
            counts = parse([(t or b"").translate(NORMAL) for t in block], model)
            best = counts.argmin(axis=1)
            least = counts[np.arange(len(block)), best]
            rest = np.sort(counts, axis=1)[:, 1] if len(model[0]) > 1 else least + 1
            sure = 1.0 - least / np.maximum(rest, 1)
            langs += [model[0][b] if ok else "und" for b, ok in zip(best, letters)]
            scores += [float(s) if ok else 0.0 for s, ok in zip(sure, letters)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict


def samples(docs: DataFrame) -> dict[str, bytes]:
    """A bounded sample of each language: a piece from anywhere in each of the SAMPLE_TEXTS labelled texts with the smallest
    hash, until the language's bytes are full.

    Equal texts count once.  The hash of a text says which of its pieces is taken, so openings that texts have in common
    teach no more than the rest.  Rows of the held-out fold, without label or without text are not looked at."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("lang", F.xxhash64("text").alias("h"), "text")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = known.select("lang", "h").distinct().withColumn("k", first).filter(F.col("k") <= SAMPLE_TEXTS)
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_PIECE + 1, F.lit(1))).cast("int")
    pieces = known.join(picked, ["lang", "h"]).select("lang", "k", F.substring("text", start + 1, F.lit(SAMPLE_PIECE)).alias("piece"))
    rows = pieces.groupBy("lang", "k").agg(F.min("piece").alias("piece")).orderBy("lang", "k").collect()
    out: dict[str, bytes] = {}
    each = min(SAMPLE_BYTES, ALL_SAMPLES // max(1, len({row["lang"] for row in rows})))
    for row in rows:
        out[row["lang"]] = (out.get(row["lang"], b"") + row["piece"].encode() + b" ")[:each]
    return {lang: text.translate(NORMAL) for lang, text in out.items()}


def op8(spark, folder):
    """Language of every document.

    Null texts and texts without a letter are ``und`` with score 0; so is everything if there are no labels.  The
    score is 1 less the ratio of the best language's phrases to the second's.  Ties go to the first code."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, samples(docs)))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(shared)(F.col("text")).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
