"""Toxicity by class-conditional Kneser-Ney models.

Words are spelled byte by byte, each byte predicted from the bytes of its word before it.  Two models, one of toxic and
one of ordinary labelled texts, discount their own counts and give what they saved to one backoff that both share:
continuation counts over all labelled texts.  Where neither class knows an expression the backoff cancels out, so that
rare words say little.  A toxic text is mostly ordinary words: its likelihood takes each word from the toxic model with
a small probability, and else from the ordinary one.  A text's evidence is the difference of the log-likelihoods for
each word; a logistic curve fitted on labelled texts that the models have not seen turns it into a score.

Counts are Spark aggregates over every labelled text of the folds in use.  The finished model holds the log-ratio of
every expression and context that was counted, under its full code: 12 bytes each, so it grows with the distinct
expressions, and a code that it does not hold was never counted."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, saved, table
from .language import blocks

#: Bytes of an expression, with the predicted one, and of the shared backoff's orders.
ORDER, BACKOFF = 7, (4, 2)
#: Discounts of the classes' counts and of the shared continuation counts.
OWN_DISCOUNT, DISCOUNT = 1.5, 0.75
#: Probability with which a toxic text takes a word from the toxic model.
SHARE = 0.005
#: Evidence is fitted on a logarithmic scale that begins here.
SCALE = 0.001
#: Folds the counts and the curve are learned from; fold 2 is held out.
COUNT_FOLDS, CURVE_FOLDS = (0, 1), (3,)
#: Steps of the evidence for each unit, and its bound, when the curve is fitted.
STEPS, BOUND = 500, 8.0
THRESHOLD = 0.3
#: Bytes of text that are scored at a time; the arrays made of them take some sixty times as much.
BLOCK = 1 << 20

#: Letters, digits and everything beyond ASCII spell words, lower-cased; zero ends a word.
SPELL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256))
_END = 1
#: Codes in order and their ratios.
Ratios = tuple[np.ndarray, np.ndarray]
_models: dict[str, tuple[Ratios, Ratios]] = {}


def expressions(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text numbers, ends of words) of all predicted bytes.  A code holds the byte in its low bits, above it
    the bytes before it in the word, the nearest first; zeros stand before the word."""
    spelled = [t.translate(SPELL) for t in texts]
    data = np.frombuffer(b"\0" + b"\0".join(spelled) + b"\0", np.uint8)
    at = np.zeros(len(data), bool)
    at[1:] = (data[1:] != 0) | (data[:-1] != 0)
    places = np.flatnonzero(at)
    byte = data[places]
    ends = byte == 0
    codes = np.where(ends, _END, byte).astype(np.int64)
    alive = np.ones(len(places), bool)
    for back in range(1, ORDER):
        near = data[np.maximum(places - back, 0)] * alive
        alive &= near != 0
        codes |= near.astype(np.int64) << (8 * back)
    begins = np.cumsum([1] + [len(s) + 1 for s in spelled])
    return codes, np.searchsorted(begins, places, "right") - 1, ends


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic, n) of a task's labelled texts."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merged(keys, sums):
        unique, place = np.unique(keys, return_inverse=True)
        return unique, np.bincount(place, sums, len(unique)).astype(np.int64)

    def out(keys, sums):
        for a in range(0, len(keys), 100_000):
            part = keys[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part >> 1), pa.array(part & 1), pa.array(sums[a : a + 100_000])], ["gram", "toxic", "n"])

    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for first, block in blocks(batch.column("text")):
            codes, owner, _ = expressions([t or b"" for t in block])
            more, n = np.unique((codes << 1) | toxic[first + owner], return_counts=True)
            keys, sums = merged(np.concatenate((keys, more)), np.concatenate((sums, n)))
            if len(keys) > 1_000_000:
                yield from out(keys, sums)
                keys, sums = keys[:0], sums[:0]
    yield from out(keys, sums)


def _suffix(code: Column, order: int) -> Column:
    return code.bitwiseAND(F.lit((1 << (8 * order)) - 1))


def _context(code: Column) -> Column:
    return F.shiftright(code, 8)


def _shared(grams: DataFrame) -> DataFrame:
    """(code, shared): the backoff's probability of the byte, for every code of the longest backoff order."""
    kinds = {ORDER: grams.select(F.col("gram").alias("code"))}
    longer = kinds[ORDER]
    for order in (*BACKOFF, 1):
        kinds[order] = longer = longer.groupBy(_suffix(F.col("code"), order).alias("code")).agg(F.count("*").alias("kinds"))
    total = kinds[1].agg(F.sum("kinds").alias("total"))
    chance = kinds[1].join(total).select("code", ((F.col("kinds") + 0.5) / (F.col("total") + 128)).alias("shared"))
    for order in sorted(BACKOFF):
        below = chance.withColumnRenamed("code", "lower").withColumnRenamed("shared", "lower_shared")
        own = kinds[order].withColumn("context", _context(F.col("code")))
        sums = own.groupBy("context").agg(F.sum("kinds").alias("all"), F.count("*").alias("follow"))
        shorter = min([o for o in (*BACKOFF, 1) if o < order], key=lambda o: order - o)
        chance = (
            own.join(sums, "context")
            .join(below, _suffix(F.col("code"), shorter) == F.col("lower"))
            .select("code", ((F.col("kinds") - DISCOUNT + DISCOUNT * F.col("follow") * F.col("lower_shared")) / F.col("all")).alias("shared"))
        )
    return chance


def ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (gram, toxic, ordinary): log-ratios (gram, ratio) of seen expressions, and (context, ratio) of what an
    unseen byte after a context says."""
    known = grams.withColumn("context", _context(F.col("gram")))
    sums = saved(
        known.groupBy("context").agg(
            *[F.sum(c).alias(f"{c}_all") for c in ("toxic", "ordinary")],
            *[F.sum(F.least(F.col(c), F.lit(OWN_DISCOUNT))).alias(f"{c}_saved") for c in ("toxic", "ordinary")],
        ),
        "toxicity-contexts",
    )
    shared = _shared(grams)

    def chance(c: str) -> Column:
        own = F.greatest(F.col(c) - OWN_DISCOUNT, F.lit(0.0)) + F.col(f"{c}_saved") * F.col("shared")
        return F.when(F.col(f"{c}_all") > 0, own / F.col(f"{c}_all")).otherwise(F.col("shared"))

    def saving(c: str) -> Column:
        return F.when(F.col(f"{c}_all") > 0, F.col(f"{c}_saved") / F.col(f"{c}_all")).otherwise(F.lit(1.0))

    seen = (
        known.join(sums, "context")
        .join(shared, _suffix(F.col("gram"), BACKOFF[0]) == F.col("code"))
        .select("gram", (F.log(chance("toxic")) - F.log(chance("ordinary"))).alias("ratio"))
    )
    unseen = sums.select("context", (F.log(saving("toxic")) - F.log(saving("ordinary"))).alias("ratio"))
    return seen, unseen


def _by_code(rows: DataFrame, code: str) -> Ratios:
    """The table as arrays, ordered by code."""
    got = rows.select(code, F.col("ratio").cast("float")).toArrow()
    codes, values = got.column(code).to_numpy(), got.column("ratio").to_numpy()
    order = np.argsort(codes)
    return codes[order], values[order]


def _look_up(codes: np.ndarray, model: Ratios) -> np.ndarray:
    """The ratio of each code; NaN: the model does not hold it.  Codes in order are found fastest."""
    keys, values = model
    if not len(keys):
        return np.full(len(codes), np.nan)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, values[at], np.nan).astype(np.float64)


def fit(texts: DataFrame) -> tuple[Ratios, Ratios]:
    """The model, from (text, toxic)."""
    counts = texts.mapInArrow(count, "gram bigint, toxic bigint, n bigint")
    grams = saved(
        counts.groupBy("gram").agg(
            F.sum(F.col("n") * F.col("toxic")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("ordinary")
        ),
        "toxicity-grams",
    )
    seen, unseen = ratios(grams)
    return _by_code(seen, "gram"), _by_code(unseen, "context")


def evidence(texts: list[bytes], seen: Ratios, unseen: Ratios) -> np.ndarray:
    """Difference of the log-likelihoods for each word, as the logarithm of how far it is above nothing: 0 without
    words or without evidence."""
    codes, owner, ends = expressions(texts)
    distinct, place = np.unique(codes, return_inverse=True)
    ratio = _look_up(distinct, seen)
    new = np.flatnonzero(np.isnan(ratio))
    ratio[new] = np.nan_to_num(_look_up(distinct[new] >> 8, unseen))
    ratio = ratio[place]
    word = np.cumsum(ends) - ends
    n = int(ends.sum())
    of_word = np.log1p(SHARE * np.expm1(np.clip(np.bincount(word, ratio, n), -50, 50)))
    texts_of = owner[ends]
    words = np.bincount(texts_of, minlength=len(texts))
    mean = np.bincount(texts_of, of_word, len(texts)) / np.maximum(words, 1)
    return np.log1p(np.maximum(mean, 0) / SCALE)


def evidence_of(shared):
    @F.arrow_udf("double")
    def column(texts: pa.Array) -> pa.Array:
        name, model = shared.value
        if name not in _models:
            _models.clear()
            _models[name] = tuple((np.frombuffer(codes, np.int64), np.frombuffer(values, np.float32)) for codes, values in model)
        found = [evidence([t or b"" for t in block], *_models[name]) for _, block in blocks(texts, BLOCK)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return column


def curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of the logistic curve through (evidence, toxic, count), by Newton steps with a weak prior.
    Without toxic or without ordinary texts the curve is flat."""
    if len({p[1] for p in points}) < 2:
        return (20.0 if points and points[0][1] else -20.0), 0.0
    x, y, n = (np.array(c, float) for c in zip(*points))
    scale = max(1e-6, float(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n))))
    design, prior, w = np.stack([np.ones_like(x), x / scale], 1), np.diag([1e-3, 0.05]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + prior, design.T @ (n * (y - p)) - prior @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): 1 if any label of the document says so; rows without label or id teach nothing."""
    return labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame) -> Callable[[Column], Column]:
    """A function from a text column to its score, learned from those docs that have labels and are not held out."""
    spark = docs.sparkSession
    # Labels grow with the corpus: they are never broadcast, whatever their size, and the plan is the same for any table.
    marked = known_labels(labels).hint("merge")
    part = lambda folds: docs.filter(fold(F.col("doc_id")).isin(*folds)).select("doc_id", "text")
    model = fit(part(COUNT_FOLDS).join(marked, F.col("doc_id") == F.col("of")).select("text", "toxic"))
    measure = evidence_of(spark.sparkContext.broadcast((uuid.uuid4().hex, tuple((codes.tobytes(), values.tobytes()) for codes, values in model))))
    bound = lambda text: F.greatest(F.least(measure(text), F.lit(BOUND)), F.lit(-BOUND))
    judged = part(CURVE_FOLDS).select("doc_id", F.round(bound(F.col("text")) * STEPS).alias("step"))
    points = judged.join(marked, F.col("doc_id") == F.col("of")).groupBy("step", "toxic").count().collect()  # bounded by STEPS
    base, slope = curve([(r["step"] / STEPS, r["toxic"], r["count"]) for r in points])
    return lambda text: 1 / (1 + F.exp(-(F.lit(base) + F.lit(slope) * bound(text))))


def op2(spark, folder):
    """Toxicity of every document.

    Null and empty texts have evidence 0.  Repeated rows get equal scores.  Without labels all scores are near 0."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    score = learn(docs, table(spark, folder, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
