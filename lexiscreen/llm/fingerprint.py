"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words (A-Z lower-cased) with their counts.  For each of SAMPLES samples every word draws
two gamma values and a shift from its hash; the word whose draw, scaled to its weight, is smallest is the sample, with
its quantised weight.  Two texts agree in a sample with a probability that equals the generalised Jaccard similarity of
their weights, so the share of equal samples estimates it."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SAMPLES = 64
#: Rows of a part, and parts at most.  Parts are sorted and streamed, so a large one costs time and no memory.
ROWS_A_PART, MOST_PARTS = 4096, 20_000
_TERMS = 2048
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_STEPS = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 in the middle of _STEPS equal steps, by Newton's method."""
    q = (np.arange(_STEPS) + 0.5) / _STEPS
    x = np.sqrt(2 * q) + q
    for _ in range(60):
        x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - q) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
        x = np.minimum(x, 60.0)
    return x


_GAMMA = _gamma_quantiles()
_SHAPE = _GAMMA.astype(np.float32)
_LOG = np.log(_GAMMA).astype(np.float32)
_odd = np.random.default_rng(20240607).integers(0, 1 << 63, SAMPLES, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def terms(text: str) -> Counter:
    return Counter(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())


def signature(weights: Counter) -> np.ndarray:
    """SAMPLES numbers of 16 bits; zeros for a text without words."""
    if not weights:
        return np.zeros(SAMPLES, np.uint16)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in weights), np.uint64, len(weights))
    logs = np.log(np.fromiter(weights.values(), np.float32, len(weights)))
    best = np.full(SAMPLES, np.inf, np.float32)
    word, level = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.float32)
    every = np.arange(SAMPLES)
    for a in range(0, len(hashes), _TERMS):
        h = hashes[a : a + _TERMS]
        x = _odd[:, None] * (h ^ (h >> np.uint64(31)))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        shape = _SHAPE[(x & np.uint64(0xFFFF)).view(np.int64)]
        shift = ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / _STEPS)
        quantised = np.floor(logs[a : a + _TERMS] / shape + shift)
        draw = _LOG[((x >> np.uint64(16)) & np.uint64(0xFFFF)).view(np.int64)] - shape * (quantised - shift + 1)
        at = draw.argmin(axis=1)
        least = draw[every, at]
        better = least < best
        best[better], word[better], level[better] = least[better], h[at[better]], quantised[every, at][better]
    mixed = (word + level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(48)).astype(np.uint16)


def text_of(numbers: np.ndarray) -> str:
    return numbers.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples."""
    return float(np.mean(a == b))


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``after`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def _compare(row: tuple, after: tuple) -> tuple:
    doc_id, text, own = row
    new = edited(text, after[1])
    changed = own if new == text else signature(terms(new))
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, text_of(own), text_of(changed), likeness(own, changed), likeness(own, after[2])


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part in order, the last one followed by the first of the next part, which is borrowed.  Only one row
    is kept between batches."""
    before, part = None, None
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("part", "borrowed", "doc_id", "text")]
        for p, borrowed, doc_id, text in zip(*columns):
            if p == part and before is None:
                continue  # more rows with the id of the borrowed one
            row = (doc_id, text or "", signature(terms(text or "")))
            if p == part:
                out.append(_compare(before, row))
            part, before = p, None if borrowed else row
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*out), FIELDS)], [n for n, _ in FIELDS])


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``part`` and ``borrowed``: ranges of ids, the largest first, null ids in the last
    one.  The first row of a part also goes, borrowed, to the end of the part before; that of the first part to the
    last.  Only the parts' limits and first ids pass through the driver."""
    limits = docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)
    edges = np.unique(np.array(limits, np.int64))

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        least = np.iinfo(np.int64).min
        numbers = ids.fill_null(least).to_numpy(zero_copy_only=False)
        return pa.array((len(edges) - np.searchsorted(edges, numbers, "right")).astype(np.int32))

    numbered = docs.withColumn("part", part_of(F.col("doc_id")))
    firsts = numbered.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("first")).orderBy("part").collect()
    if not firsts:
        return numbered.withColumn("borrowed", F.lit(0))
    lender = {r["part"]: (firsts[k - 1]["part"], r["first"]) for k, r in enumerate(firsts)}

    @F.arrow_udf("array<struct<part:int,borrowed:int>>")
    def places(ids: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for doc_id, p in zip(ids.to_pylist(), numbers.to_pylist()):
            to, first = lender[p]
            out.append([{"part": p, "borrowed": 0}] + ([{"part": to, "borrowed": 1}] if doc_id == first else []))
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("borrowed", pa.int32())])))

    placed = numbered.withColumn("place", F.explode(places(F.col("doc_id"), F.col("part"))))
    return placed.select("place.part", "place.borrowed", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text) rows, of their edited texts, and the likeness to both the edited and the next
    text.  Texts are shuffled once, by ranges of ids, and stream through their part in order."""
    spark = docs.sparkSession
    rows = docs.select("doc_id").count()
    parts = min(MOST_PARTS, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_PART)))
    order = ["part", "borrowed", F.desc_nulls_last("doc_id"), "text"]
    dealt = _dealt(docs, parts).repartition(-(-parts // 4), "part").sortWithinPartitions(*order)
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(neighbours, schema)


def op5(spark, folder):
    """Fingerprints of every document and of its edited text.

    Null texts are empty; texts without words have a fingerprint of zeros and are alike.  Rows with equal ids follow
    each other by text; null ids come last.  A single row is its own next one; an empty table gives no rows."""
    return fingerprints(table(spark, folder, "documents").select("doc_id", "text"))
