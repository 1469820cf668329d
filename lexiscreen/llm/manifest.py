"""Merkle manifest of a dataset by butterfly exchange.

Records are leaves, in order inside each group; every ``FANOUT`` consecutive nodes become one until one remains, the
group's subroot; the subroots of the groups form the tree above them.  Leaves lie in aligned partitions of
FANOUT^LEVELS, so that the lower levels are one partition's own work.  Then partitions exchange: in round r those that
differ in digit r of their number (base FANOUT) alone swap the roots they hold, and each of them hashes the common
ancestor for itself.  After the last round each partition holds every sibling on its way to the top, and nothing has to
be sent down.  Where the last partitions lack partners, partitions without leaves stand in for them: they take
part in the swaps with an empty root, so that the roots reach all that need them.

Positions come from one range partitioned, written table, so a hot group is spread over many tasks, and no step sees
more than FANOUT^LEVELS leaves of a group at once."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

FANOUT = 3
#: A partition of the exchange has up to FANOUT^LEVELS leaves.
LEVELS = 7

#: Siblings of a node on one level: own place in its run, and the others' digests in order.
STEPS = "array<struct<place:int,others:array<string>>>"


def field(value: Column) -> Column:
    """A value as bytes counted and text, ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def positions(leaves: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``leaves`` with ``at`` (from 0, gapless inside each group, by ``order``, nulls first) and ``size`` of the group.

    Rows are dealt by ranges of (group, order, random) and written in order with their numbers; parts of a group are
    counted and summed up.  No task holds a whole group.  Rows equal in group and order get any order among themselves."""
    by = [F.col(c).asc_nulls_first() for c in [group, *order]]
    ranged = leaves.withColumn("dealt", F.rand(0)).repartitionByRange(*by, F.col("dealt").asc()).sortWithinPartitions(*by)
    written = saved(ranged.drop("dealt").withColumn("part", F.spark_partition_id()).withColumn("nr", F.monotonically_increasing_id()), "manifest-order")
    parts = written.groupBy(F.col(group).alias("of_g"), F.col("part").alias("of_part")).agg(F.count("*").alias("n"), F.min("nr").alias("first"))
    of_group = Window.partitionBy("of_g")
    before = F.sum("n").over(of_group.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("of_g", "of_part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(of_group).alias("size"))
    joined = written.join(offsets, F.col(group).eqNullSafe(F.col("of_g")) & (F.col("part") == F.col("of_part")))
    return joined.withColumn("at", F.col("nr") + F.col("shift")).drop("of_g", "of_part", "part", "nr", "shift")


def runs(level: list[str]) -> list[list[str]]:
    return [level[k : k + FANOUT] for k in range(0, len(level), FANOUT)]


def grown(leaves: list[str], levels: int | None) -> list[list[str]]:
    """The levels above some nodes, these first: ``levels`` of them, or until one node remains."""
    made = [leaves]
    while len(made) <= levels if levels is not None else len(made[-1]) > 1:
        made.append([digest(r) for r in runs(made[-1])])
    return made


def steps(made: list[list[str]], k: int) -> list[dict]:
    """Siblings of leaf ``k`` on the levels of ``grown``."""
    found = []
    for level in made[:-1]:
        run = level[k // FANOUT * FANOUT : k // FANOUT * FANOUT + FANOUT]
        found.append({"place": k % FANOUT, "others": run[: k % FANOUT] + run[k % FANOUT + 1 :]})
        k //= FANOUT
    return found


def climbed(node: str, way: Sequence[dict]) -> str:
    """The top that a node leads to by its siblings."""
    for step in way:
        others = list(step["others"])
        node = digest([*others[: step["place"]], node, *others[step["place"] :]])
    return node


def _levels(size: int, levels: int) -> int | None:
    """Levels of a partition: all of them if its group has more than one partition."""
    return levels if size > FANOUT**levels else None


def partition_roots(placed: DataFrame, levels: int) -> DataFrame:
    """(g, block, blocks, root) of each partition of placed (g, at, size, leaf) rows."""
    width = FANOUT**levels

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        leaves = list(rows.sort_values("at")["leaf"])
        size = int(rows["size"].iloc[0])
        top = grown(leaves, _levels(size, levels))[-1][0]
        return rows.head(1).assign(blocks=-(-size // width), root=top)[["g", "block", "blocks", "root"]]

    kind = placed.schema["g"].dataType.simpleString()
    return placed.select("g", "at", "size", "leaf", "block").groupBy("g", "block").applyInPandas(root, f"g {kind}, block bigint, blocks bigint, root string")


def exchange(roots: DataFrame) -> DataFrame:
    """(g, block, way, top) from ``partition_roots``: the siblings above each partition, and its group's top.

    One swap a round among at most FANOUT partitions; partitions with no leaves stand in up to the next power."""
    held = saved(roots, "manifest-roots")
    most = held.agg(F.max("blocks")).first()[0] or 1
    rounds = 0
    while FANOUT**rounds < most:
        rounds += 1
    power = F.array_min(F.filter(F.array(*[F.lit(FANOUT**r) for r in range(rounds + 1)]), lambda p: p >= F.col("blocks")))
    state = held.select("g", "block", "blocks", "root", F.lit(False).alias("stand_in"), F.expr(f"CAST(array() AS {STEPS})").alias("way"))
    missing = held.filter("block = 0").select("g", F.explode(F.sequence("blocks", power)).alias("block"), "blocks").filter(F.col("block") < power)
    state = state.unionByName(missing.select("*", F.lit(True).alias("stand_in")), allowMissingColumns=True)
    for r in range(rounds):
        step = FANOUT**r
        inside = F.col("blocks") > step  # a group with one root left is done
        digit = (F.floor(F.col("block") / step) % FANOUT).cast("int")
        partners = Window.partitionBy("g", F.floor(F.col("block") / (step * FANOUT)), F.when(inside, F.col("block") % step).otherwise(F.col("block")))
        swapped = state.withColumn("digit", digit).withColumn(
            "held", F.array_sort(F.collect_list(F.when(F.col("root").isNotNull(), F.struct("digit", "root"))).over(partners))
        )
        others = F.transform(F.filter("held", lambda x: x["digit"] != F.col("digit")), lambda x: x["root"])
        parent = F.when(F.size("held") > 0, F.sha2(F.concat_ws("", F.transform("held", lambda x: x["root"])).cast("binary"), 256))
        one = F.struct(F.col("digit").alias("place"), others.alias("others"))
        state = saved(
            swapped.select(
                "g",
                "block",
                "blocks",
                "stand_in",
                F.when(inside & ~F.col("stand_in"), F.concat("way", F.array(one))).otherwise(F.col("way")).alias("way"),
                F.when(inside, parent).otherwise(F.col("root")).alias("root"),
            ),
            "manifest-round",
        )
    return state.filter(~F.col("stand_in")).select("g", "block", "way", F.col("root").alias("top"))


def tops(placed: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """The siblings above each partition, and (g, top) of each group."""
    above = saved(exchange(partition_roots(placed, levels)), "manifest-above")
    return above, above.filter("block = 0").select("g", "top")


def manifest(leaves: DataFrame, group: str, order: str, leaf: str, levels: int = LEVELS) -> DataFrame:
    """``leaves`` (extra columns kept) with subroot, root, proof_sha256 and ``way``-folded digests.

    ``leaf`` names the digest column.  A column ``tampered`` holds the digest found later, null if unchanged;
    ``folded_root`` is recomputed from it, or else from the leaf, and the siblings."""
    width = FANOUT**levels
    placed = positions(leaves.withColumnsRenamed({group: "g", leaf: "leaf"}), "g", [order, "leaf"])
    placed = saved(placed.withColumn("block", F.floor(F.col("at") / width)), "manifest-placed")
    above, subroots = tops(placed, levels)
    higher = subroots.select(F.lit(0).alias("g"), F.col("g").alias("name"), F.col("top").alias("leaf"))
    higher = saved(positions(higher, "g", ["name"]).withColumn("block", F.floor(F.col("at") / width)), "manifest-higher")
    high, root = tops(higher, levels)

    def proved(rows: pd.DataFrame, ways: pd.DataFrame, checked: bool) -> pd.DataFrame:
        """Leaves of one partition with their whole way to the top."""
        rows = rows.sort_values("at")
        made = grown(list(rows["leaf"]), _levels(int(rows["size"].iloc[0]), levels))
        upper = [s for way in ways[[c for c in ("way", "high_way") if c in ways]].iloc[0] for s in way]
        whole = [steps(made, k) + upper for k in range(len(rows))]
        if not checked:
            return rows.assign(way=whole)[["name", "leaf", "way"]]
        given = rows["tampered"].where(rows["tampered"].notna(), rows["leaf"])
        rows = rows.assign(
            subroot=ways["top"].iloc[0],
            root=ways["root"].iloc[0],
            proof_sha256=[digest([o for s in way for o in s["others"]]) for way in whole],
            folded_root=[climbed(node, way) for node, way in zip(given, whole)],
        )
        return rows[[*kept, "subroot", "root", "proof_sha256", "folded_root"]]

    name = placed.schema["g"].dataType.simpleString()
    of_group = (
        higher.groupBy("g", "block")
        .cogroup(high.groupBy("g", "block"))
        .applyInPandas(lambda a, b: proved(a, b, False), f"name {name}, leaf string, way {STEPS}")
        .select(F.col("name").alias("h"), F.col("way").alias("high_way"))
    )
    of_group = saved(of_group.join(root.select(F.col("top").alias("root"))), "manifest-groups")
    whole = above.join(of_group, F.col("g").eqNullSafe(F.col("h"))).select("g", "block", "way", "top", "high_way", "root")
    kept = [c for c in placed.columns if c not in ("at", "size", "block", "tampered")]
    schema = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in kept)
    return (
        placed.groupBy("g", "block")
        .cogroup(whole.groupBy("g", "block"))
        .applyInPandas(lambda a, b: proved(a, b, True), f"{schema}, subroot string, root string, proof_sha256 string, folded_root string")
    )


def op12(spark, folder, levels: int = LEVELS):
    """Leaf, proof and verification of every document; its source is its group.

    A null id comes first in its source, a null source first of the sources; both are ``-`` in a leaf, and a null id
    counts as empty text for the choice of tampered rows.  Rows of one id are ordered by leaf, so equal rows are
    interchangeable.  Empty texts are ``0:``.  An empty table gives no rows."""
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    picked = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    changed = picked & F.contains(text, F.lit("\n"))
    leaves = docs.select(
        "doc_id",
        "source",
        leaf_digest(*fields, text).alias("leaf"),
        F.when(changed, leaf_digest(*fields, F.replace(text, F.lit("\n"), F.lit("")))).alias("tampered"),
    )
    return manifest(leaves, "source", "doc_id", "leaf", levels).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: The same level by level; crc32 a bit at a time.
OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''),
        lambda ch: ch <> ''), lambda ch: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: CAST((ascii(ch) >> i) & 1 AS BIGINT))))),
        lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1)))) % 2 = 0 AS picked FROM documents),
e AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(CASE WHEN picked THEN replace(text, chr(10), '') ELSE text END) || ':'
        || CASE WHEN picked THEN replace(text, chr(10), '') ELSE text END, '-')) AS given FROM d),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM e),
n AS (SELECT s, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY s) AS size FROM l
    UNION ALL SELECT s, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(size) + 2) // 3 FROM n WHERE size > 1 GROUP BY s, lvl, pos // 3),
r AS (SELECT s, lvl AS top, h AS subroot FROM n WHERE size = 1),
u AS (SELECT 0 AS lvl, s AS pos, subroot AS h, count(*) OVER () AS size FROM r
    UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(size) + 2) // 3 FROM u WHERE size > 1 GROUP BY lvl, pos // 3),
z AS (SELECT lvl AS top, h AS root FROM u WHERE size = 1),
m AS (SELECT s, lvl, pos, h, size, string_agg(h, '') OVER (PARTITION BY s, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
    string_agg(h, '') OVER (PARTITION BY s, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM n),
v AS (SELECT lvl, pos, size, string_agg(h, '') OVER (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
    string_agg(h, '') OVER (PARTITION BY lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM u),
w AS (SELECT l.s, l.pos AS leaf_at, m.lvl, coalesce(m.lo, '') AS lo, coalesce(m.hi, '') AS hi FROM l JOIN m ON m.s = l.s AND m.size > 1 AND m.pos = l.pos // CAST(pow(3, m.lvl) AS BIGINT)
    UNION ALL SELECT l.s, l.pos, r.top + v.lvl, coalesce(v.lo, ''), coalesce(v.hi, '') FROM l JOIN r ON r.s = l.s JOIN v ON v.size > 1 AND v.pos = l.s // CAST(pow(3, v.lvl) AS BIGINT)),
p AS (SELECT s, leaf_at, sha256(string_agg(lo || hi, '' ORDER BY lvl)) AS proof, count(*) AS steps FROM w GROUP BY s, leaf_at),
c AS (SELECT s, pos, 0 AS lvl, given AS h FROM l
    UNION ALL SELECT c.s, c.pos, c.lvl + 1, sha256(w.lo || c.h || w.hi) FROM c JOIN w ON w.s = c.s AND w.leaf_at = c.pos AND w.lvl = c.lvl)
SELECT l.doc_id, l.leaf, r.subroot, z.root, coalesce(p.proof, sha256('')) AS proof_sha256, c.h AS folded_root, c.h = z.root AS verified
FROM l JOIN r ON r.s = l.s CROSS JOIN z LEFT JOIN p ON p.s = l.s AND p.leaf_at = l.pos JOIN c ON c.s = l.s AND c.pos = l.pos AND c.lvl = coalesce(p.steps, 0)"""
