"""Ranked lexical search by dense blocked multiplication.

Items are the queries, all documents are searched.  Texts are cut once: each document keeps its length and how often it
has each term that some item has.  Corpus counts give the weight of a term; a document's impacts, the summands of its
scores, are integers.  A tile of documents by a tile of the items' own vocabulary is filled with impacts as float64 and
multiplied with the 0/1 tile of vocabulary by items.  Tiles are narrow enough that no sum inside one reaches 2^53, so
every product is exact; tiles are added up as 64-bit integers.

Each task keeps the best documents of every item: a tile's scores pass if they reach the item's last place, ties
included, and the order of score and key decides.  The tasks' lists meet in two rounds by item."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, saved, table

#: Letters and digits of ASCII and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents, terms and items of a tile.
TILE_DOCUMENTS, TILE_TERMS, TILE_ITEMS = 1024, 1024, 256
#: Items are dealt to as many blocks as make this the mean number of terms of one; blocks are searched in turn.
BLOCK_TERMS = 1_000_000
#: Bytes of text that are cut at a time.
PIECE = 1 << 20
#: An impact is a weight times at most this.
MOST_IMPACT = 10**6
#: Parts of an item's candidates that are ranked side by side.
SALTS = 32

_SEPARATORS = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a piece at a time."""
    raw = text.translate(_SEPARATORS)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def term_counts(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, n, terms, tfs) of every row: length, and the vocabulary terms it has with their occurrences."""

    def count(batches):
        for batch in batches:
            lengths, terms, tfs = [], [], []
            for value in batch.column(1):
                n, found = 0, Counter()
                for words in pieces(value.as_buffer().to_pybytes() if value.is_valid else b""):
                    n += len(words)
                    found.update(map(vocabulary.get, words))
                found.pop(None, None)
                lengths.append(n)
                terms.append(pa.array(found.keys(), pa.int32()))
                tfs.append(pa.array(found.values(), pa.int32()))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int32)
            join = lambda parts: pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays([*parts, pa.array([], pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), join(terms), join(tfs)], ["key", "n", "terms", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, f"key {kind}, n bigint, terms array<int>, tfs array<int>")


class Best:
    """The best k rows of every item so far, by falling score, then rising key; null keys come last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, missing key, key
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, first: int, scores: np.ndarray, missing: np.ndarray, keys: np.ndarray) -> None:
        """Scores of a tile: a row a document, a column an item from ``first`` on."""
        r, c = np.nonzero(scores >= self.floor[first : first + scores.shape[1]])
        self.waiting.append((c + first, scores[r, c], missing[r], keys[r]))
        self.size += len(r)
        if self.size > 4 * self.k * len(self.floor):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        rows = [np.concatenate(parts) for parts in zip(self.rows, *self.waiting)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        starts = np.searchsorted(rows[0], np.arange(len(self.floor)))
        place = np.arange(len(rows[0])) - starts[rows[0]]
        self.floor[rows[0][place == self.k - 1]] = rows[1][place == self.k - 1]
        self.rows, self.waiting, self.size = [x[place < self.k] for x in rows], [], 0
        return self.rows


def _tiles(items: list[np.ndarray], width: int) -> list[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Tiles of items, (first, number, parts): each part has some terms of its items' own vocabulary, and which item has which."""
    made = []
    for first in range(0, len(items), TILE_ITEMS):
        some = items[first : first + TILE_ITEMS]
        terms, column = np.unique(np.concatenate(some), return_inverse=True)
        owner = np.repeat(np.arange(len(some)), [len(t) for t in some])
        parts = []
        for low in range(0, len(terms), width):
            inside = (column >= low) & (column < low + width)
            parts.append((terms[low : low + width], np.stack([column[inside] - low, owner[inside]])))
        made.append((first, len(some), parts))
    return made


def best_of_tasks(rows: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, score, missing, key) of the best k rows that each task sees, from ``term_counts`` rows."""
    width = int(min(TILE_TERMS, (2**53 - 1) // max(int(weights.max(initial=1)) * MOST_IMPACT, 1)))

    def search(batches):
        best, tiles = Best(len(items), k), _tiles(items, width)
        place = np.full(len(weights), -1, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, TILE_DOCUMENTS):
                part = batch.slice(low, TILE_DOCUMENTS)
                terms = part.column("terms").flatten().to_numpy()
                tf = part.column("tfs").flatten().to_numpy().astype(np.int64)
                sizes = np.diff(part.column("terms").offsets.to_numpy())
                n = part.column("n").to_numpy().astype(np.int64)
                m = 50 + (50 * n * documents) // max(length, 1)
                row = np.repeat(np.arange(part.num_rows), sizes)
                impact = weights[terms] * ((10**9 * tf) // (1000 * tf + 20 * m[row]))
                missing = part.column("key").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                keys = part.column("key").fill_null(0).to_numpy().astype(np.int64)
                for first, count, parts in tiles:
                    scores = np.zeros((part.num_rows, count), np.int64)
                    for own, (term, owner) in parts:
                        place[own] = np.arange(len(own))
                        at = place[terms]
                        hit = at >= 0
                        if hit.any():
                            tile = np.zeros((part.num_rows, len(own)))
                            tile[row[hit], at[hit]] = impact[hit]
                            has = np.zeros((len(own), count))
                            has[term, owner] = 1
                            scores += (tile @ has).astype(np.int64)
                        place[own] = -1
                    best.add(first, scores, missing, keys)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.settle()], ["item", "score", "missing", "key"])

    return rows.select(F.col("key").cast("long").alias("key"), "n", "terms", "tfs").mapInArrow(search, "item bigint, score bigint, missing bigint, key bigint")


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(id, term), once each; rows of one id are one item."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0))
    return items.select(F.col(key).alias("id"), F.explode(found).alias("term")).distinct()




def weight(documents: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * documents + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, key, score, rank): the k best documents of every item, equal scores by rising key, null keys last.

    Keys are integers.  Items are bounded a block at a time, documents are not."""
    dealt = saved(item_terms(items, item, item_text), "search-items")
    blocks = -(-dealt.count() // BLOCK_TERMS)
    found = None
    for number in range(blocks):
        own = dealt.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number)
        lists: dict = {}
        vocabulary: dict[bytes, int] = {}
        for r in own.select("id", "term").collect():
            lists.setdefault(r["id"], []).append(vocabulary.setdefault(r["term"].encode(), len(vocabulary)))
        ids = list(lists)
        rows = saved(term_counts(docs, key, text, vocabulary), "search-terms")
        total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weights = np.zeros(len(vocabulary), np.int64)
        for r in df.select("term", weight(F.lit(total["documents"]), F.col("df")).alias("w")).collect():
            weights[r["term"]] = r["w"]
        best = best_of_tasks(rows, [np.array(lists[i], np.int64) for i in ids], weights, total["documents"], total["length"], k)
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"item bigint, id {items.schema[item].dataType.simpleString()}")
        named = best.join(names, "item").select("id", F.when(F.col("missing") == 0, F.col("key")).alias("key"), "score")
        found = named if found is None else found.unionAll(named)
    if found is None:
        kinds = f"id {items.schema[item].dataType.simpleString()}, key bigint, score bigint"
        found = docs.sparkSession.createDataFrame([], kinds)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    some = found.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("id", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select(F.col("id").alias("item"), "key", "score", "rank")


def op13(spark, folder, k: int = 50):
    """The 50 best documents of every benchmark item.

    Null and empty texts have no term: such a document counts in nothing, such an item has no rows.  Rows of one item_id
    are one item.  Documents tied at the last place are cut by doc_id, null last; repeated rows rank each.  Very long
    texts are cut a piece at a time.  Without documents or items there are no rows."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k).select(
        F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score"
    )


#: The same by one row a term.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, c GROUP BY term, docs),
s AS (SELECT q.item_id, d.r, d.doc_id, CAST(sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * len(d.w) * c.docs) // c.total)))) AS BIGINT) AS score
    FROM q JOIN f ON q.term = f.term JOIN t ON t.term = q.term JOIN d ON d.r = t.r, c GROUP BY q.item_id, d.r, d.doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""
