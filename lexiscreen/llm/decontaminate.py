"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items, as word sequences, form one automaton.  Texts are normalised byte for byte (A-Z
lower-cased, every other non-word byte a space), so that a byte of the normalised text is a byte of the original;
the words, joined by single spaces, are scanned once.  Only texts with a match get their word positions mapped back
to code points of the original.

The automaton is sent to the executors, so its size is checked: items are split into slices of bounded size and each
slice is an automaton of its own, whose findings are added to those before.  A test set of usual size is one slice."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

#: Words are runs of 0-9, a-z and everything beyond ASCII; bytes of other characters become spaces.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
#: Bytes of item text that one automaton holds; it takes some fifty times as much memory.
SLICE_BYTES = 2_000_000

_automata: dict[str, object] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(text: bytes, width: int) -> list[list[bytes]]:
    """All windows of an item; one of fewer words is a window itself, one of none has none."""
    w = words(text)
    return [w[i : i + width] for i in range(max(1, len(w) - width + 1))] if w else []


def _build(items: list[tuple[str, bytes]], width: int):
    """Values are (words in the window, ids of the items with it)."""
    import ahocorasick

    owners: dict[str, tuple[int, set[str]]] = {}
    for item_id, text in items:
        for window in windows(text, width):
            key = (b" " + b" ".join(window) + b" ").decode("latin-1")
            owners.setdefault(key, (len(window), set()))[1].add(item_id)
    automaton = ahocorasick.Automaton()
    for key, (size, ids) in owners.items():
        automaton.add_word(key, (size, sorted(ids)))
    if owners:
        automaton.make_automaton()
    return automaton


def _automaton(shared, width: int):
    """Built once a worker; only the latest slice is kept."""
    name, items = shared.value
    if name not in _automata:
        _automata.clear()
        _automata[name] = _build(items, width)
    return _automata[name]


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def search(automaton, text: bytes) -> tuple[int, set[str], list[tuple[int, int]]]:
    """Number of words, items with occurring windows, and the hit word ranges [first, beyond)."""
    parts = words(text)
    if not parts or not len(automaton):
        return len(parts), set(), []
    joined = (b" " + b" ".join(parts) + b" ").decode("latin-1")
    matches = list(automaton.iter(joined))
    if not matches:
        return len(parts), set(), []
    ends = np.cumsum([len(w) + 1 for w in parts])  # position of the space behind each word
    marks, ids = np.zeros(len(parts) + 1, np.int64), set()
    for end, (size, owners) in matches:
        last = int(np.searchsorted(ends, end))
        marks[last - size + 1] += 1
        marks[last + 1] -= 1
        ids.update(owners)
    return len(parts), ids, list(zip(*(x.tolist() for x in _runs(np.cumsum(marks[:-1]) > 0))))


def _word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code point offsets of the words."""
    at = np.array([m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))], np.int64).reshape(-1, 2)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return points[at[:, 0]], points[at[:, 1]]


def scanner(shared, width: int):
    """A column function: texts, and what earlier slices found (or null), to what all have found."""

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        automaton = _automaton(shared, width)
        out = []
        for text, old in zip(texts, before):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            count, ids, ranges = search(automaton, data)
            old = old.as_py()
            if not ranges:
                out.append(old or {"n_words": count, "n_hit": 0, "items": [], "spans": []})
                continue
            start, end = _word_spans(data)
            hit = np.zeros(count, bool)
            for a, b in ranges:
                hit[a:b] = True
            if old:
                ids |= set(old["items"])
                for span in old["spans"]:
                    hit |= (start >= span["start"]) & (end <= span["end"])
            spans = [{"start": int(start[a]), "end": int(end[b - 1])} for a, b in zip(*_runs(hit))]
            out.append({"n_words": count, "n_hit": int(hit.sum()), "items": sorted(ids), "spans": spans})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    return scan


def slices(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> list[list[tuple[str, bytes]]]:
    """The items in slices of about ``slice_bytes``, fetched slice by slice; an item without text has no windows."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text")
    ).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // slice_bytes) or 1
    dealt = items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    return [[(r.id, bytes(r.text)) for r in dealt.filter(F.col("part") == p).select("id", "text").collect()] for p in range(parts)]


def contamination(docs: DataFrame, benchmark: DataFrame, column: str, width: int = 10, text: str = "text") -> DataFrame:
    """``docs`` with one more struct column: n_words, n_hit, items (sorted ids) and spans (hit runs of words as code
    points of the original text, end exclusive)."""
    spark = docs.sparkSession
    parts = slices(benchmark)
    found: Column = F.lit(None).cast(FOUND)
    for k, items in enumerate(parts):
        if k:
            docs, found = saved(docs, "decontaminated"), F.col(column)
        docs = docs.withColumn(column, scanner(spark.sparkContext.broadcast((uuid.uuid4().hex, items)), width)(F.col(text), found))
    return docs


def op4(spark, folder):
    """Hit words and items of every document.

    Null and empty texts have no words and are clean.  Repeated rows are judged one by one; items of equal text count
    each; an empty benchmark leaves every document clean."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, folder, "benchmark"), "found")
    return found.select("doc_id", "found").select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM i),
p AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT p.rid, p.p, p.n, i.item_id FROM p JOIN i ON p.n = i.n AND p.win = i.win),
h AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS x FROM m) GROUP BY rid),
o AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN o USING (rid)"""
