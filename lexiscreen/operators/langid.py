"""Language identification: character trigrams of words, naive Bayes.

A word with a blank on both sides has one trigram for each of its letters, with that letter in the middle.  Trigrams are
counted, and their likelihoods looked up, letter by letter over Arrow batches inside the scan's own tasks: a text leaves
the pass as one row for each language, not as its words.  The table of likelihoods that goes to every task is bounded;
trigrams it has no room for are joined."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

#: Likelihoods that go to every task, one for each language and trigram; those of further trigrams are joined.
MOST_KNOWN = 1 << 20
#: Bytes of text cut at once, or one text.
_BLOCK = 1 << 20
_POINT = (1 << 21) - 1


def _letters(text: Column) -> Column:
    """The words of a text in lower case with one blank between them and after the last."""
    return F.concat(F.regexp_replace(F.lower(text), r"\P{L}+", " "), F.lit(" "))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks of rows (key, letters): the keys, how many letters each row has, the block's different trigrams as
    numbers, and for each letter the place of its trigram among them."""
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))])
        first = 0
        while first < batch.num_rows:
            last = max(int(np.searchsorted(ends, ends[first] + _BLOCK, "right")) - 1, first + 1)
            keys, texts = batch.slice(first, last - first).columns
            first = last
            points = np.frombuffer((" " + "".join(texts.to_pylist())).encode("utf-32-le"), np.uint32).astype(np.int64)
            at = np.flatnonzero(points != ord(" "))
            bounds = np.concatenate([[1], 1 + np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))])
            codes = pa.array(points[at - 1] << 42 | points[at] << 21 | points[at + 1]).dictionary_encode()
            yield keys, np.diff(np.searchsorted(at, bounds)), codes.dictionary.to_numpy(), codes.indices.to_numpy()


def _as_text(codes: np.ndarray) -> pa.Array:
    points = np.stack([codes >> 42, codes >> 21 & _POINT, codes & _POINT], axis=1).astype(np.uint32)
    return pa.array(points.view("<U3").ravel(), pa.string())


def _as_codes(grams: pa.Array) -> np.ndarray:
    points = np.array(grams.to_pylist(), "<U3").view(np.uint32).reshape(-1, 3).astype(np.int64)
    return points[:, 0] << 42 | points[:, 1] << 21 | points[:, 2]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, n) of each block."""
    for keys, sizes, codes, places in _cut(batches):
        if not len(codes):
            continue
        named = keys.dictionary_encode(null_encoding="encode")
        both = np.repeat(named.indices.to_numpy().astype(np.int64), sizes) * len(codes) + places
        counts = pc.value_counts(pa.array(both))
        both = counts.field(0).to_numpy()
        columns = [named.dictionary.take(pa.array(both // len(codes))), _as_text(codes[both % len(codes)]), counts.field(1)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "gram", "n"])


def grams(texts: DataFrame, key: str) -> DataFrame:
    """(key, gram, n) from the words of a text."""
    cut = texts.filter("text IS NOT NULL").select(F.col(key).alias("key"), _letters(F.col("text")).alias("letters"))
    schema = T.StructType([T.StructField("key", texts.schema[key].dataType), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    return cut.mapInArrow(_counted, schema).groupBy(F.col("key").alias(key), "gram").agg(F.sum("n").alias("n"))


def profile(texts: DataFrame) -> DataFrame:
    """(lang, gram, n, logp): counts with add-one smoothing over the grams of
    the language."""
    counts = grams(texts.filter("lang IS NOT NULL"), "lang")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    joined = counts.join(totals, "lang")
    return joined.select("lang", "gram", "n", F.log((F.col("n") + 1) / (F.col("total") + F.col("kinds"))).alias("logp"))


class _Known:
    """Likelihoods above the floor by language and trigram; the last column stands for trigrams that are not known."""

    def __init__(self, rows: pa.Table, langs: pa.Array, floor: float):
        codes = _as_codes(rows["gram"])
        self.langs, self.codes = langs, np.append(np.unique(codes), -1)
        self.gain = np.zeros((len(langs), len(self.codes)))
        self.seen = np.zeros((len(langs), len(self.codes)), bool)
        number = {lang: k for k, lang in enumerate(langs.to_pylist())}
        cell = [number[lang] for lang in rows["lang"].to_pylist()], np.searchsorted(self.codes[:-1], codes)
        np.add.at(self.gain, cell, rows["logp"].to_numpy() - floor)
        self.seen[cell] = True

    def columns(self, codes: np.ndarray) -> np.ndarray:
        found = np.searchsorted(self.codes[:-1], codes)
        return np.where(self.codes[found] == codes, found, len(self.codes) - 1)


def _looked_up(batches: Iterator[pa.RecordBatch], known: _Known) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, gain, size) for each text with letters and each language; no gain where none of its grams is known."""
    for keys, sizes, codes, places in _cut(batches):
        texts = np.flatnonzero(sizes)
        if not len(texts):
            continue
        starts = np.concatenate([[0], np.cumsum(sizes[texts])[:-1]])
        column = known.columns(codes)
        gain, seen = np.zeros((len(known.langs), len(texts))), np.zeros((len(known.langs), len(texts)), bool)
        for k in range(len(known.langs)):
            gain[k] = np.add.reduceat(known.gain[k, column][places], starts)
            seen[k] = np.logical_or.reduceat(known.seen[k, column][places], starts)
        every, langs = np.tile(texts, len(known.langs)), np.repeat(np.arange(len(known.langs)), len(texts))
        found = [keys.take(pa.array(every)), known.langs.take(pa.array(langs)), pa.array(gain.ravel(), mask=~seen.ravel()), pa.array(sizes[every], pa.int64())]
        yield pa.RecordBatch.from_arrays(found, ["doc_id", "lang", "gain", "size"])


def _unknown(batches: Iterator[pa.RecordBatch], known: _Known) -> Iterator[pa.RecordBatch]:
    """(doc_id, gram, n): the grams of a text that are not known."""
    for keys, sizes, codes, places in _cut(batches):
        lost = (known.columns(codes) == len(known.codes) - 1)[places]
        pairs = pa.table({"text": np.repeat(np.arange(len(sizes)), sizes)[lost], "place": places[lost]})
        pairs = pairs.group_by(["text", "place"]).aggregate([([], "count_all")]).combine_chunks()
        if pairs.num_rows:
            kept = [keys.take(pairs["text"].chunk(0)), _as_text(codes[pairs["place"].to_numpy()]), pairs["count_all"].chunk(0)]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", "gram", "n"])


def scores(texts: DataFrame, model: DataFrame, floor: float = -14.0) -> DataFrame:
    """(doc_id, lang, score): share of each language after a softmax over the
    mean log likelihood per gram; an unseen gram costs ``floor``."""
    spark = texts.sparkSession
    # Written, so that it is counted once; the optimizer then knows its size.
    path = f"{checkpoint_dir(spark).rstrip('/')}/languages-{uuid.uuid4().hex}"
    model.select("lang", "gram", "logp").write.parquet(path)
    model = spark.read.schema("lang string, gram string, logp double").parquet(path)
    langs = model.select("lang").distinct().orderBy("lang").toArrow()["lang"].combine_chunks()
    room = max(MOST_KNOWN // max(len(langs), 1), 1)
    kinds = model.groupBy("gram").agg(F.max("logp").alias("top"))
    total = kinds.count()
    whole, likeliest = total <= room, model
    if not whole:
        least = kinds.agg(F.percentile_approx("top", 1 - room / total)).first()[0]
        likeliest = model.join(kinds.filter(F.col("top") > least), "gram", "left_semi")
    known = _Known(likeliest.select("lang", "gram", "logp").toArrow(), langs, floor)

    cut = texts.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", _letters(F.col("text")).alias("letters"))
    doc_id = T.StructField("doc_id", texts.schema["doc_id"].dataType)
    fields = [T.StructField("lang", T.StringType()), T.StructField("gain", T.DoubleType()), T.StructField("size", T.LongType())]
    parts = cut.mapInArrow(partial(_looked_up, known=known), T.StructType([doc_id, *fields]))
    if not whole:
        fields = [T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())]
        rest = cut.mapInArrow(partial(_unknown, known=known), T.StructType([doc_id, *fields])).join(model, "gram")
        parts = parts.unionAll(rest.select("doc_id", "lang", (F.col("n") * (F.col("logp") - floor)).alias("gain"), F.lit(0).cast("long").alias("size")))
    gained = parts.groupBy("doc_id", "lang").agg(F.sum("gain").alias("gain"), F.sum("size").alias("size")).filter("gain IS NOT NULL")
    listed = gained.groupBy("doc_id").agg(F.collect_list(F.struct("lang", F.exp(F.col("gain") / F.col("size")).alias("e"))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda z, x: z + x["e"])
    return listed.select("doc_id", total.alias("z"), F.inline("x")).select("doc_id", "lang", (F.col("e") / F.col("z")).alias("score"))


def best(scored: DataFrame, k: int = 5, least: float = 0.2, first: float = 0.3, close: float = 0.9) -> DataFrame:
    """(doc_id, place, lang, score): of the ``k`` best languages with ``least`` or more, the first if it has ``first``,
    and each other that has ``close`` times the first's score.  A list holds the languages of the model at most."""
    ranked = scored.filter(F.col("score") >= least).groupBy("doc_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("score", "lang")), asc=False), 1, k).alias("r")
    )
    rows = ranked.select("doc_id", F.col("r")[0]["score"].alias("top"), F.posexplode("r").alias("place", "x"))
    kept = F.when(F.col("place") == 0, F.col("x.score") >= first).otherwise(F.col("x.score") >= close * F.col("top"))
    return rows.filter(kept).select("doc_id", "place", "x.lang", F.round("x.score", 6).alias("score"))


def _grams_sql(key: str) -> str:
    return rf"""(SELECT {key}, substr(p, k, 3) AS gram, sum(m)::BIGINT AS n FROM (
      SELECT {key}, ' ' || w || ' ' AS p, count(*) AS m, unnest(range(1, length(w) + 1)) AS k FROM (
        SELECT {key}, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM documents) GROUP BY {key}, w) GROUP BY ALL)"""


def profile_sql() -> str:
    return f"SELECT lang, gram, n FROM {_grams_sql('lang')}"


def scores_sql() -> str:
    return f"""WITH counts AS ({profile_sql()}),
    totals AS (SELECT lang, sum(n) AS total, count(*) AS kinds FROM counts GROUP BY lang),
    model AS (SELECT lang, gram, ln((n + 1) / (total + kinds)) AS logp FROM counts JOIN totals USING (lang)),
    grams AS {_grams_sql('doc_id')}, sizes AS (SELECT doc_id, sum(n) AS size FROM grams GROUP BY doc_id),
    mean AS (SELECT doc_id, lang, exp(sum(n * (logp + 14.0)) / any_value(size)) AS e FROM grams JOIN model USING (gram) JOIN sizes USING (doc_id) GROUP BY doc_id, lang),
    scored AS (SELECT doc_id, lang, e / sum(e) OVER (PARTITION BY doc_id) AS score FROM mean)
    SELECT doc_id, (r - 1)::INT AS place, lang, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER best AS r, max(score) OVER (PARTITION BY doc_id) AS top FROM scored WHERE score >= 0.2 WINDOW best AS (PARTITION BY doc_id ORDER BY score DESC, lang DESC))
    WHERE r <= 5 AND CASE WHEN r = 1 THEN score >= 0.3 ELSE score >= 0.9 * top END"""
