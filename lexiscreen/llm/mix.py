"""Mixing sources to target weights with hash-threshold histograms.

Every record gets a 60-bit hash of its key.  Sizes are summed by source and hash bucket; a running sum over the
buckets of a source finds the bucket in which its budget ends.  Only the rows of that boundary bucket are summed
again, by the next ten bits, until the boundary holds one hash.  What is taken is then a filter on the hash: no row
is sorted, and nothing but (source, bucket) sums is shuffled.  A target above a source's size takes every record
once and the nested rest a second time, below the same kind of threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, fresh, saved, table

LEVEL_BITS = 10
LEVELS = 6


def words_in(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def record_hash(key: Column) -> Column:
    """60 bits that depend on the key alone; a null key counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """Target of each source, from (source, source_size), one row a source.

    Weights go to the sources by code point, null last, and repeat.  A target stops at ``cap`` times its source's
    size; the excess is shared again by weight.  The fixed point is found directly: in the order of size by weight
    the stopped sources come first, and all others get the same amount per unit of weight."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    )
    rest = ranked.withColumn(
        "per_weight",
        (F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap))
        / F.sum("weight").over(after),
    ).withColumn("stopped", F.col("source_size") * F.lit(cap) <= F.col("weight") * F.col("per_weight"))
    level = F.min(F.when(~F.col("stopped"), F.struct(F.col("source_size") / F.col("weight"), "per_weight"))).over(everything)["per_weight"]
    return rest.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("stopped") | F.col("level").isNull(), F.col("source_size") * F.lit(cap))
        .otherwise(F.col("weight") * F.col("level"))
        .alias("target"),
    )


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """(key, source, h, size) of every row, without its text, in the shared folder."""
    size = words_in(F.col("text")) if size is None else size
    return saved(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), record_hash(F.col(key)).alias("h"), size.alias("size")),
        "mix-sizes",
    )


def thresholds(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From ``sized`` rows, one row a source: source, source_size, target, whole (copies of every record) and
    below (records with a hash under it get one more copy).

    Records of one hash go together; they are in if at least half of them still fits.  A source without words
    gets no copies.  Equal inputs give equal thresholds, however the rows are dealt out."""
    sizes = saved(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-sources")
    plan = targets(sizes, weights, budget, cap).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    )
    left = F.col("target") - F.col("whole") * F.col("source_size")
    state = saved(
        plan.select("*", left.alias("left"), F.lit(0).cast("long").alias("prefix"), F.when(left <= 0, F.lit(0).cast("long")).alias("below")),
        "mix-state",
    )
    for level in range(LEVELS):
        edges = state.filter("below IS NULL").select(F.col("source").alias("s"), "prefix", "left")
        if edges.isEmpty():
            break
        shift = 60 - LEVEL_BITS * (level + 1)
        inside = rows.join(
            edges, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        )
        sums = inside.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(
            F.first("left").alias("left"), F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))
        found = sums.withColumn("upto", upto).filter("upto > left").groupBy("s").agg(
            F.min(F.struct("bucket", "n", "upto", "lo", "hi")).alias("edge")
        )
        fits = F.col("left") - (F.col("edge.upto") - F.col("edge.n"))
        state = saved(
            state.join(found, F.col("source").eqNullSafe(F.col("s")) & F.col("below").isNull(), "left").select(
                "source",
                "source_size",
                "target",
                "whole",
                F.coalesce(fits, "left").alias("left"),
                F.coalesce("edge.bucket", "prefix").alias("prefix"),
                F.when(F.col("below").isNotNull(), F.col("below"))
                .when(F.col("edge").isNull(), F.lit(1 << 60))
                .when(F.col("edge.lo") == F.col("edge.hi"), F.col("edge.lo") + F.when(2 * fits >= F.col("edge.n"), 1).otherwise(0))
                .alias("below"),
            ),
            "mix-state",
        )
    return state.select("source", "source_size", "target", "whole", F.coalesce("below", F.lit(0).cast("long")).alias("below"))


def mix(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``sized`` rows with their source's size and target, and ``copies``: how often the mix takes each."""
    cuts = cuts.withColumnRenamed("source", "s")
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "copies", F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    ).drop("s")


def remix(docs: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    cuts = thresholds(sized(docs, key, source), **options)
    name = fresh(docs, "mix_cut")
    cut = cuts.select(F.struct(F.col("source").alias("s"), "whole", "below").alias(name))
    copies = F.col(f"{name}.whole") + F.when(record_hash(docs[key]) < F.col(f"{name}.below"), 1).otherwise(0)
    picked = docs.join(cut, docs[source].eqNullSafe(F.col(f"{name}.s")))
    return picked.withColumn(name, F.explode(F.array_repeat(F.lit(0), copies))).drop(name)


def op1(spark, folder):
    """Words of every document that the mix takes.

    Null texts and empty texts have size 0 and take 0.  A null source is a source of its own, the last one.  Rows of
    one doc_id stay together; an empty table gives no rows."""
    rows = sized(table(spark, folder, "documents"))
    return mix(rows, thresholds(rows)).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies"
    )


#: The same mix with windows that sort every source, for comparison.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
r AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
        - CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * 2.0::DOUBLE)
        / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per_weight FROM w),
c AS (SELECT *, source_size * 2.0::DOUBLE <= weight * per_weight AS stopped FROM r),
l AS (SELECT *, (SELECT per_weight FROM c WHERE NOT stopped ORDER BY source_size / weight, source NULLS LAST LIMIT 1) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN stopped OR level IS NULL THEN source_size * 2.0::DOUBLE ELSE weight * level END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS whole FROM t),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
e AS (SELECT *, whole + CASE WHEN rest <= 0 OR source_size = 0 THEN 0 WHEN upto <= rest THEN 1
    WHEN upto - own <= rest AND own > 0 AND 2 * (rest - (upto - own)) >= own THEN 1 ELSE 0 END AS copies FROM q)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM e"""
