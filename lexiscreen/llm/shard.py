"""Sharding by rendezvous hashing.

Each pair of record key and shard has a pseudo-random exponential value, divided by the shard's weight; the shard
with the smallest value gets the record.  A record's values for the old shards do not change when a shard is added,
so that records move into the new shard only, as many as its weight asks for.  No row depends on another one: there
is no shuffle until positions inside the shards are asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Parts of a shard that are numbered side by side; the shard's slots run through them in order.
SLICES = 1024


def _values(key: Column, weights: Sequence[float]) -> Column:
    """For every shard a struct of its value and its number; the smallest struct is the record's shard.
    53 bits of the hash make a number in (0, 1)."""
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def value(at: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, at["shard"]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(unit) / at["weight"]).alias("value"), at["shard"].alias("shard"))

    return F.transform(shards, value)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a record: a number from 0; all null keys share one shard."""
    return F.array_min(_values(key, weights))["shard"]


def with_slots(rows: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``slot``: gapless positions from 0 inside each shard.

    A shard is cut into slices by hash; slices are counted, the counts are summed in order, and each slice numbers
    its own rows.  No task sees a whole shard."""
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)).cast("int"))
    counts = sliced.groupBy(F.col(shard).alias("of_shard"), F.col("slice").alias("of_slice")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("of_shard").orderBy("of_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("of_shard", "of_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(shard, "slice").orderBy(*[F.col(c) for c in order]))
    numbered = sliced.withColumn("within", inside)
    return numbered.join(offsets, (F.col(shard) == F.col("of_shard")) & (F.col("slice") == F.col("of_slice"))).select(
        *rows.columns, (F.col("offset") + F.col("within") - 1).cast("long").alias("slot")
    )


def op9(spark, folder, shards: int = 40):
    """Shard and slot of every document, and its shard with one shard more.

    The law is ``key``: only doc_id and the number of shards decide, whatever text, size or copies a row has; equal
    texts with different ids are placed apart.  Null texts count 16 bytes and have the crc32 of empty text, 0.  Null
    ids share a shard; repeated rows get slots of their own."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(F.col("doc_id"), [1.0] * shards).alias("shard"),
        rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
