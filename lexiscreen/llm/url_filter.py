"""URL filters as cascades of Bloom filters, with DataFrame functions only.

Level 0 encodes the listed keys.  The keys of the corpus that pass it without being listed are level 1, the listed
keys that pass level 1 are level 2, and so on until nothing passes by mistake.  As every key of the corpus took part,
the answer for a key of the corpus is exact: the first level that a key fails tells whether it is listed.  Judging
urls needs no join and no shuffle; the filters are constants in the plan, and their size is checked when built."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved, table

#: Bits of one part of a level, as the bitmap aggregate makes them.
PART_BITS = 32768
#: A level may have so many bits (1 MB).  Longer lists are judged by a join instead.
MOST_BITS = 1 << 23


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    data: bytes

    def has(self, key: Column) -> Column:
        test = F.lit(True)
        for position in _positions(key, self.number, self.bits, self.hashes):
            byte = F.conv(F.hex(F.substring(F.lit(bytearray(self.data)), F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10)
            test = test & (F.floor(byte.cast("int") / F.pow(F.lit(2), position % 8)).cast("int") % 2 == 1)
        return test


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing; each level has hash functions of its own."""
    first, second = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(F.pmod(first, F.lit(bits)) + i * F.pmod(second, F.lit(bits)), F.lit(bits)) for i in range(hashes)]


def _level(keys: DataFrame, number: int, count: int, rate: float) -> Level | None:
    """The filter over ``keys``, or None if it would be larger than a level may be."""
    wanted = max(1024.0, -count * math.log(rate) / math.log(2) ** 2)
    bits = -(-int(wanted) // 64) * 64
    if bits > MOST_BITS:
        return None
    hashes = min(20, max(1, round(bits / count * math.log(2))))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("at"))
    parts = at.groupBy(F.floor(F.col("at") / PART_BITS).alias("part")).agg(
        F.bitmap_construct_agg((F.col("at") % PART_BITS).cast("long")).alias("map")
    )
    data = bytearray(-(-bits // 8))
    for row in parts.collect():  # at most MOST_BITS / PART_BITS rows
        start = row["part"] * PART_BITS // 8
        data[start : start + PART_BITS // 8] = bytes(row["map"])[: len(data) - start]
    return Level(number, bits, hashes, bytes(data))


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level] | None:
    """Levels that tell the ``key`` rows of ``listed`` from all others of ``universe``; None if one gets too large.

    The first level lets through about as many other keys as are listed, the next ones half of what they get."""
    listed = saved(listed.filter("key IS NOT NULL").select("key").distinct(), "cascade-listed")
    inside, n_inside = listed, listed.count()
    if not n_inside:
        return []
    ratio = min(0.5, n_inside / max(1, universe.agg(F.approx_count_distinct("key")).first()[0]))
    levels = [_level(inside, 0, n_inside, max(1e-6, ratio * math.sqrt(2)))]
    if levels[0] is None:
        return None
    passed = universe.select("key").filter(levels[0].has(F.col("key"))).distinct()
    outside = saved(passed.join(listed, "key", "left_anti"), "cascade-others")
    n_outside = outside.count()
    while n_outside:
        level = _level(outside, len(levels), n_outside, 0.5)
        if level is None:
            return None
        levels.append(level)
        inside, outside = outside, saved(inside.filter(level.has(F.col("key"))), "cascade-passed")
        n_outside = outside.count()
    return levels


def member(key: Column, levels: Sequence[Level]) -> Column:
    """Whether a key of the universe is listed; null keys are not."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        answer = F.when(level.has(key), answer).otherwise(F.lit(level.number % 2 == 1))
    return F.coalesce(answer, F.lit(False))


_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def candidates(host: Column, path: Column, depths: Sequence[int], lengths: Sequence[int]) -> Column:
    """All keys a rule could have that fits: the last labels of the host, for the numbers of labels rules have, with
    the first characters of the path, for the lengths rules have."""
    suffixes = F.array_distinct(F.transform(F.array(*map(F.lit, depths)), lambda d: F.call_function("substring_index", host, F.lit("."), -d)))
    prefixes = F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length(path) >= n)
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda n: F.concat(s, F.substr(path, F.lit(1), n)))))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for pages with page_id and url, from rules with host, path, verdict.

    The longest fitting rule decides, then block before allow.  A url on no list gets ``otherwise``."""
    rules = rules.select("verdict", "host", "path", F.concat("host", "path").alias("key"))
    shape = rules.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))), F.sort_array(F.collect_set(F.length("path")))
    ).first()
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shape[0]:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    keys = candidates(F.col("host"), F.col("path"), *shape)
    universe = urls.select(F.explode(keys).alias("key"))
    lists = {v: cascade(rules.filter(F.col("verdict") == v), universe) for v in ("block", "allow")}
    if None in lists.values():
        return _judge_by_join(urls.withColumn("keys", keys), rules, otherwise)
    listed = F.filter(keys, lambda k: member(k, lists["block"]) | member(k, lists["allow"]))
    longest = F.array_max(F.transform(listed, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    judged = urls.withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNull(), otherwise).when(member(F.col("rule"), lists["block"]), "block").otherwise("allow")
    return judged.withColumn("verdict", verdict)


def _judge_by_join(urls: DataFrame, rules: DataFrame, otherwise: str) -> DataFrame:
    """For lists too long for constants: every candidate key looks its rule up."""
    rows = urls.withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows, "urls-judged")
    hits = rows.select("row", F.explode("keys").alias("key")).join(rules.groupBy("key").agg(F.max("verdict").alias("verdict")), "key")
    best = hits.groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    return rows.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )


#: The rules of the contract.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6(spark, folder):
    """Rule and verdict of every page's url.

    A null url, or one without ``://``, has empty host and path and no rule.  A url on no list is allowed, as the
    cascade proves that no list holds any of its keys.  Repeated rows are judged alike."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(table(spark, folder, "pages"), rules)


OP6_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, row_number() OVER () AS rid, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT rid, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC) AS k
    FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.rid = m.rid AND m.k = 1"""
