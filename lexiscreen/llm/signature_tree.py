"""N-gram Jaccard join with signature trees.

Texts are sets of word shingles; equal sets are one node of the link graph.  The join finds all pairs of nodes with
a Jaccard similarity of at least num / den, in this order:

1. *Roots.*  Linked sets of similar size differ in at most d shingles.  Every set is dealt into k > d segments by
   shingle hash, so that linked sets agree in whole segments.  Sets that share a segment hang below one root, named by
   the smallest of them.  Shared passages alone do not bring sets together, as a segment holds shingles from anywhere.
2. *Trees.*  Below a root, sets are leaves, in the order of their size and of their smallest shingle hash, so that
   sets that may be linked lie together.  Inner nodes hold the OR of the bitmaps below them and the range of sizes.  The
   lowest ones also hold a bitmap of 2^32 bits, kept as the places of its ones, of the sets' smallest hashes only: so
   many of each that linked sets have one in common.  Many sets do not fill it up.
3. *Traversal.*  First every leaf meets a pivot of its tree, in rounds, as long as rounds find links: groups of near
   copies become components with few comparisons.  Then the trees are traversed against themselves, level by level,
   for pairs of nodes from different components only.  A pair of nodes goes on if the overlap that bitmaps and sizes
   allow reaches the bound.  Pairs of lowest inner nodes whose wide bitmaps have a one in common are compared as bit
   matrices of their leaves.
4. Pairs of leaves that remain are compared by signatures as wide as their sets, then exactly.

Pairs already in one component cannot change the result and are not visited; no other pair is left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Words of the bitmaps, of 64 bits each.
BITMAP = 32
#: Leaves of a lowest inner node, and the ones of its wide bitmap, about.
BLOCK, ONES = 256, 20_000
#: Bands of sizes and parts of them that the nodes above have as children, and the nodes a tree's top may have.
BANDS, PARTS, FAN = 8, 16, 128
#: Rounds of pivots at most, and the part of a round's comparisons that must be links for another round.
PIVOTS, WORTH = 8, 0.1
#: Segments to spare, as a part of the shingles in which linked sets may differ.
SPARE = 0.25
#: Sizes up to the next number share their segments.
GROWTH = 1.5

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_random = np.random.default_rng(73_856_093)
_LETTER = _random.integers(0, 1 << 63, 256, np.int64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of them."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each lower-cased word, from running sums over the bytes."""
    data = np.frombuffer(text.translate(_LOWER), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edges = np.diff(inside)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(begin):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[: len(data)], dtype=np.uint64)))
    return _mix((sums[end] - sums[begin]) * down[begin])


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word shingles; of the whole sequence if it is shorter."""
    words = word_hashes(text)
    if not len(words):
        return words
    width_here = min(width, len(words))
    count = len(words) - width_here + 1
    out = np.full(count, width_here, np.uint64)
    for k in range(width_here):
        out = _mix(out + words[k : k + count]) * np.uint64(_BASE)
    return np.unique(out)


def node_of(hashes: np.ndarray) -> int:
    """The node of a set: a hash of its shingle hashes; sets of equal node are taken as equal."""
    place = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    total = _mix(hashes + place * np.uint64(_BASE)).sum(dtype=np.uint64)
    return int(_mix(np.array([total + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP, np.uint64)
    at = _mix(hashes + np.uint64(7)) % np.uint64(64 * BITMAP)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits.view(np.int64)


def wide(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Places of a set's smallest hashes in a bitmap of 2^32 bits, ascending.

    Linked sets share num / den of the larger one at least, so that either lacks fewer than the hashes taken here, and the
    smallest that both have is among those of both."""
    n = len(hashes)
    return np.unique((hashes[: n - -(-n * num // den) + 1] >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def signature(hashes: np.ndarray) -> bytes:
    """A bitmap of eight bits or more a shingle; its size is a power of two, so that a larger one folds to a smaller."""
    bits = 1 << max(9, (8 * len(hashes) - 1).bit_length())
    at = _mix(hashes + np.uint64(13)) & np.uint64(bits - 1)
    marks = np.zeros(bits, np.uint8)
    marks[at.astype(np.int64)] = 1
    return np.packbits(marks).tobytes()


def most_overlap(n_a: int, a: bytes, n_b: int, b: bytes) -> int:
    """The most shingles that two sets can share: a bit that the other lacks is a shingle that it lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    lacks = lambda p, q: int(np.bitwise_count(p & ~q).sum())
    return min(n_a - lacks(x, y), n_b - lacks(y, x))


def _may_link(num: int, den: int):
    @F.arrow_udf("boolean")
    def may_link(n_a: pa.Array, a: pa.Array, n_b: pa.Array, b: pa.Array) -> pa.Array:
        rows = zip(n_a.to_pylist(), a.to_pylist(), n_b.to_pylist(), b.to_pylist())
        return pa.array([most_overlap(p, x, q, y) * (num + den) >= num * (p + q) for p, x, q, y in rows], pa.bool_())

    return may_link


class Bands:
    """Classes of set sizes, with the number of segments that linked sets of a class need."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.ends = num, den, [4]

    def of(self, n: int) -> list[int]:
        """The classes in which a set of n shingles can meet a linked one of its size or more, or of less."""
        while self.ends[-1] < n * self.den:
            self.ends.append(int(self.ends[-1] * GROWTH) + 1)
        band = int(np.searchsorted(self.ends, n))
        return [band, band + 1] if n * self.den // self.num > self.ends[band] else [band]

    def differ(self, band: int) -> int:
        """Shingles that linked sets of the class can have in one of them only."""
        return 2 * self.ends[band] * (self.den - self.num) // (self.den + self.num)

    def keys(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Keys of the segments by which a set finds those linked with it.

        Linked sets agree in more than ``spare`` segments.  Every set leaves out its ``spare`` weakest ones, those
        with the fewest shingles, as many sets have them.  The strongest segment in which two linked sets agree has
        ``spare`` weaker ones in both, so both keep it."""
        out = []
        for band in self.of(len(hashes)):
            d = self.differ(band)
            if d == 0:
                continue  # linked sets are equal
            spare = 3 + int(d * SPARE)
            k = d + 1 + spare
            segment = ((_mix(hashes + np.uint64(band * 1_000_003 + 11)) >> np.uint64(20)) % np.uint64(k)).astype(np.int64)
            counts = np.bincount(segment, minlength=k)
            order = np.argsort(segment, kind="stable")
            sums = np.zeros(k, np.uint64)
            there = np.flatnonzero(counts)
            sums[there] = np.add.reduceat(_mix(hashes[order]), (np.cumsum(counts) - counts)[there])
            labels = _mix(sums + _mix(np.arange(k, dtype=np.uint64) + np.uint64((band + 1) << 32)))
            out.append(labels[np.lexsort((labels, counts))[spare:]])
        return out


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text"):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _measure(width: int):
    @F.arrow_udf("struct<n:bigint,node:bigint>")
    def measure(texts: pa.Array) -> pa.Array:
        sizes, nodes = [], []
        for t in texts:
            found = shingles(t.as_buffer().to_pybytes(), width) if t.is_valid else np.zeros(0, np.uint64)
            sizes.append(len(found))
            nodes.append(node_of(found) if len(found) else None)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], ["n", "node"])

    return measure


def sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, n_shingles, node) of every row; ``row`` is a hash of the text, node is null for empty sets."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), _measure(width)(F.col("text")).alias("m"))
    return rows.select("doc_id", "row", F.col("m.n").alias("n_shingles"), "m.node")


def segments(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(key, node) of all segments; a task lists copies of a set once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bands = set(), Bands(num, den)
        for batch in batches:
            keys, nodes, waiting = [], [], 0
            for text in _texts(batch):
                hashes = shingles(text, width)
                node = node_of(hashes) if len(hashes) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                for k in bands.keys(hashes):
                    keys.append(k.view(np.int64))
                    nodes.append(np.full(len(k), node, np.int64))
                    waiting += len(k)
                if waiting > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes)], ["key", "node"])
                    keys, nodes, waiting = [], [], 0
            if waiting:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes)], ["key", "node"])

    return docs.select("text").mapInArrow(emit, "key bigint, node bigint")


def leaves(docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, n, lead, bits, ones, signature, hashes) of the given (node, of_doc) nodes, from the text of one of their rows.

    An id with several texts, null among them, has several nodes: there the text's own node is part of the key, so that no
    text meets another one's node."""
    schema = "node bigint, n bigint, lead bigint, bits array<bigint>, ones array<int>, signature binary, hashes array<bigint>"
    names = ["node", "n", "lead", "bits", "ones", "signature", "hashes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            wanted, rows, waiting = batch.column("node").to_pylist(), [], 0
            for node, text in zip(wanted, _texts(batch)):
                if node in seen:
                    continue
                hashes = shingles(text, width)
                if node_of(hashes) != node:
                    continue  # another text with the same id
                seen.add(node)
                rows.append((node, len(hashes), int(hashes[:1].view(np.int64)[0]), bitmap(hashes), wide(hashes, num, den), signature(hashes), hashes.view(np.int64)))
                waiting += len(hashes)
                if waiting > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, waiting = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    texts = docs.select(F.col("doc_id").alias("d"), "text")
    crowded = saved(nodes.groupBy("of_doc").agg(F.count("*").alias("many")).filter("many > 1 OR of_doc IS NULL").select(F.col("of_doc").alias("c")), "join-crowded")
    single = nodes.join(crowded, F.col("of_doc").eqNullSafe(F.col("c")), "left_anti")
    several = nodes.join(crowded, F.col("of_doc").eqNullSafe(F.col("c")), "left_semi")
    # Nodes grow with the corpus and are never broadcast: the plan is the same at every size.
    found = texts.join(single.hint("merge"), F.col("d") == F.col("of_doc")).select("node", "text")
    if not crowded.isEmpty():
        own = texts.join(crowded, F.col("d").eqNullSafe(F.col("c")), "left_semi").withColumn("own", _measure(width)(F.col("text"))["node"])
        found = found.union(own.join(several.hint("merge"), (F.col("own") == F.col("node")) & F.col("d").eqNullSafe(F.col("of_doc"))).select("node", "text"))
    return found.mapInArrow(build, schema)


def _common(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


class Join:
    """The steps of the join for one table; ``num / den`` is the least similarity of a link."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.docs, self.width, self.num, self.den = docs.select("doc_id", "text"), width, num, den

    def enough(self, overlap: Column, size_a: Column, size_b: Column) -> Column:
        return overlap * (self.num + self.den) >= self.num * (size_a + size_b)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) pairs of nodes that are links: sizes and signatures first, then, for the nodes that are left, the
        shingles themselves."""
        signed = lambda name, as_: self.leaf.select(F.col("node").alias(name), F.struct("n", "signature").alias(as_))
        both = pairs.join(signed("a", "x"), "a").join(signed("b", "y"), "b")
        fits = _may_link(self.num, self.den)("x.n", "x.signature", "y.n", "y.signature")
        near = both.select("a", "b", fits.alias("fits")).filter("fits").select("a", "b")
        near = saved(near, "join-near")
        needed = saved(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "join-needed")
        exact = self.leaf.select("node", "hashes").join(needed, "node", "left_semi")
        whole = lambda name, as_: exact.select(F.col("node").alias(name), F.col("hashes").alias(as_))
        both = near.join(whole("a", "p"), "a").join(whole("b", "q"), "b")
        return both.filter(self.enough(F.size(F.array_intersect("p", "q")), F.size("p"), F.size("q"))).select("a", "b")

    def run(self) -> DataFrame:
        """(doc_id, row, n_shingles, component_id, component): ``component`` is a number of each component, null for empty
        sets."""
        rows = saved(sets(self.docs, self.width), "join-sets")
        first = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("of_doc"))
        nodes = saved(first, "join-nodes")
        labels = self.labels(nodes)
        tagged = nodes.join(labels, "node", "left").select("node", "of_doc", F.coalesce("label", "node").alias("label"))
        least = saved(tagged.groupBy("label").agg(F.min("of_doc").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n"), "join-components")
        named = saved(
            tagged.join(least, "label", "left").select(
                F.col("node").alias("of_node"), F.coalesce("component_id", "of_doc").alias("component_id"), F.col("label").alias("component")
            ),
            "join-named",
        )
        full = rows.filter("node IS NOT NULL").join(named, F.col("node") == F.col("of_node"))
        alone = rows.filter("node IS NULL").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
        columns = ["doc_id", "row", "n_shingles", "component_id", "component"]
        return full.select(*columns).union(alone.select(*columns))

    def labels(self, nodes: DataFrame) -> DataFrame:
        """(node, label) of all nodes with links: equal labels for equal components."""
        of_key = Window.partitionBy("key").orderBy("node")
        root = F.first("node").over(of_key.rowsBetween(Window.unboundedPreceding, 0))
        second = F.dense_rank().over(of_key) == 2
        below = segments(self.docs, self.width, self.num, self.den).select("node", root.alias("root"), second.cast("int").alias("second"))
        below = below.filter("node <> root").groupBy("node", "root").agg(F.count("*").alias("shared"), F.sum("second").alias("keys"))
        below = saved(below, "join-roots")
        asked = below.select("node").union(below.select(F.col("root").alias("node"))).distinct()
        self.leaf = saved(leaves(self.docs, saved(asked.join(nodes, "node"), "join-asked"), self.width, self.num, self.den), "join-leaves")
        roots = below.groupBy("root").agg(F.sum("keys").alias("shared")).select(F.col("root").alias("node"), "root", "shared")
        members = saved(below.select("node", "root", "shared").union(roots), "join-members")
        links, marked = None, members.withColumn("label", F.col("node"))
        for turn in range(PIVOTS):
            first = -F.col("shared") if turn == 0 else F.xxhash64("node", F.lit(turn))
            pivot = marked.groupBy("root").agg(
                F.min_by(F.struct(F.col("node").alias("pivot"), F.col("label").alias("pivot_label")), F.struct(first, "node")).alias("p"),
                F.min("label").alias("lo"), F.max("label").alias("hi"),
            ).filter("lo <> hi").select(F.col("root").alias("r"), "p.pivot", "p.pivot_label")
            met = marked.join(saved(pivot, "join-pivots"), F.col("root") == F.col("r")).filter("label <> pivot_label")
            # The pivot of the tree in which a leaf shares the most.
            best = F.max_by(F.struct(F.col("pivot").alias("b"), F.col("pivot_label").alias("to")), F.struct("shared", "pivot")).alias("p")
            pairs = saved(met.groupBy(F.col("node").alias("a")).agg(best).select("a", "p.b", "p.to"), "join-pairs")
            found = saved(self.linked(pairs.select("a", "b")), "join-links")
            n = found.count()
            if n:
                # Leaves take the label of the pivot they are linked with: equal labels are one component.
                moved = found.join(pairs, ["a", "b"]).select(F.col("a").alias("node"), "to").distinct()
                marked = saved(marked.join(moved, "node", "left").withColumn("label", F.coalesce("to", "label")).drop("to"), "join-marked")
                links = found if links is None else links.union(found)
            if n <= WORTH * pairs.count():
                break
        found = saved(self.linked(self.traverse(marked)), "join-links")
        return components(found if links is None else links.union(found))

    def placed(self, marked: DataFrame) -> DataFrame:
        """(root, node, label, n, small, band, part) of the leaves of all trees with leaves of different labels."""
        mixed = marked.groupBy("root").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(F.col("root").alias("r"))
        sizes = self.leaf.select(F.col("node").alias("leaf"), "n", "lead")
        open_ = marked.join(saved(mixed, "tree-roots"), F.col("root") == F.col("r")).join(sizes, F.col("node") == F.col("leaf"))
        return saved(_placed(open_.select("root", "node", "label", "n", "lead"), self.num, self.den), "tree-placed")

    def blocks(self, placed: DataFrame) -> DataFrame:
        """The lowest inner nodes, with their leaves: bitmaps are fetched once a leaf and tree."""
        bits = self.leaf.select(F.col("node").alias("leaf"), "bits")
        return saved(_blocks(placed.join(bits, F.col("node") == F.col("leaf"))), "tree-blocks")

    def wides(self, placed: DataFrame) -> DataFrame:
        """(root, band, part, wide) of the lowest inner nodes of trees that have several."""
        ones = self.leaf.select(F.col("node").alias("leaf"), "ones")
        rows = placed.filter("NOT small").join(ones, F.col("node") == F.col("leaf"))
        union = F.sort_array(F.array_distinct(F.flatten(F.collect_list("ones"))))
        return saved(rows.groupBy("root", "band", "part").agg(union.alias("wide")), "tree-wide")

    def block_pairs(self, blocks: DataFrame, wides: DataFrame) -> DataFrame:
        """(same, x_leaves, y_leaves) of the pairs of lowest inner nodes that bitmaps and sizes do not rule out."""
        levels = [blocks.drop("leaves")]
        while (levels[-1].groupBy("root").count().agg(F.max("count")).first()[0] or 0) > FAN:
            levels[-1] = _with_parent(levels[-1])
            levels.append(saved(_inner(levels[-1]), "tree-level"))
        fields = ["band", "part", "lo", "hi", "least", "most", "excess", "bits"]
        side = lambda level, s: level.select("root", *[F.col(c).alias(f"{s}_{c}") for c in level.columns if c.startswith("parent")], F.struct(*fields).alias(s))
        first = F.struct("x.band", "x.part") <= F.struct("y.band", "y.part")
        pairs = side(levels[-1], "x").join(side(levels[-1], "y"), "root").filter(first)
        for level in reversed(levels[:-1]):
            parents = [F.col(f"{s}.{c}").alias(f"{s}_parent_{c}") for s in ("x", "y") for c in ("band", "part")]
            ids = saved(pairs.filter(self.reachable()).select("root", *parents), "tree-pairs")
            pairs = ids.join(side(level, "x"), ["root", "x_parent_band", "x_parent_part"]).join(side(level, "y"), ["root", "y_parent_band", "y_parent_part"])
            pairs = pairs.filter((F.col("x_parent_band") != F.col("y_parent_band")) | (F.col("x_parent_part") != F.col("y_parent_part")) | first)
        keys = ["root", "x_band", "x_part", "y_band", "y_part"]
        names = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("x", "y") for c in ("band", "part")]
        near = saved(pairs.filter(self.reachable()).select("root", *names), "tree-pairs")
        same = (F.col("x_band") == F.col("y_band")) & (F.col("x_part") == F.col("y_part"))
        held = lambda s, c: (wides if c == "wide" else blocks).select("root", F.col("band").alias(f"{s}_band"), F.col("part").alias(f"{s}_part"), F.col(c).alias(f"{s}_{c}"))
        with_ = lambda rows, s, c: rows.join(held(s, c), ["root", f"{s}_band", f"{s}_part"])
        apart = with_(with_(near.filter(~same), "x", "wide"), "y", "wide").filter(_meet(F.col("x_wide"), F.col("y_wide")))
        apart = saved(apart.select(*keys), "tree-apart")
        alone = with_(near.filter(same), "x", "leaves").select(F.lit(True).alias("same"), "x_leaves", F.col("x_leaves").alias("y_leaves"))
        return alone.unionAll(with_(with_(apart, "x", "leaves"), "y", "leaves").select(F.lit(False).alias("same"), "x_leaves", "y_leaves"))

    def traverse(self, marked: DataFrame) -> DataFrame:
        """(a, b): leaves below one root, of different labels, that may be linked."""
        placed = self.placed(marked)
        found = self.block_pairs(self.blocks(placed), self.wides(placed)).mapInArrow(_matrices(self.num, self.den), "a bigint, b bigint")
        return saved(found.distinct(), "tree-leaves")

    def reachable(self) -> Column:
        """Whether leaves of different components below two nodes may be linked: the most overlap that the OR of the
        bitmaps, the shingles that share a bit, and the sizes allow."""
        apart = (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi")) | (F.col("x.lo") != F.col("y.lo"))
        common = _common(F.col("x.bits"), F.col("y.bits")) + F.least("x.excess", "y.excess")
        most = F.least(common, F.col("x.most"), F.col("y.most"))
        sizes = (F.col("x.most") * self.den >= F.col("y.least") * self.num) & (F.col("y.most") * self.den >= F.col("x.least") * self.num)
        return apart & sizes & self.enough(most, F.col("x.least"), F.col("y.least"))


def _matrices(num: int, den: int):
    """Pairs of leaves of different components that may be linked, from pairs of blocks."""

    def block(leaves: pa.StructArray):
        node, label, n, bits = leaves.flatten()
        bits = bits.flatten().to_numpy(zero_copy_only=False).reshape(len(leaves), BITMAP)
        ones = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1).astype(np.float32)
        return [c.to_numpy(zero_copy_only=False) for c in (node, label, n)] + [ones, ones.sum(axis=1)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, left, right in zip(batch.column("same"), batch.column("x_leaves"), batch.column("y_leaves")):
                node_a, label_a, n_a, ones_a, set_a = block(left.values)
                node_b, label_b, n_b, ones_b, set_b = block(right.values)
                for k in range(0, len(node_a), BLOCK):
                    part = slice(k, k + BLOCK)
                    common = ones_a[part] @ ones_b.T
                    # Bits that the other lacks are shingles that it lacks.
                    most = np.minimum(n_a[part, None] - (set_a[part, None] - common), n_b[None] - (set_b[None] - common))
                    fits = (most * (num + den) >= num * (n_a[part, None] + n_b[None])) & (label_a[part, None] != label_b[None])
                    if same.as_py():
                        fits &= node_a[part, None] < node_b[None]
                    i, j = np.nonzero(fits)
                    for at in range(0, len(i), 100_000):
                        a, b = node_a[part][i[at : at + 100_000]], node_b[j[at : at + 100_000]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return compare


def _meet(x: Column, y: Column) -> Column:
    """Whether two wide bitmaps have a one in common."""

    @F.arrow_udf("boolean")
    def meet(a: pa.Array, b: pa.Array) -> pa.Array:
        ones = lambda side: side.values.to_numpy(zero_copy_only=False)
        return pa.array([bool(len(np.intersect1d(ones(p), ones(q), assume_unique=True))) for p, q in zip(a, b)], pa.bool_())

    return meet(x, y)


def _placed(leaves: DataFrame, num: int, den: int) -> DataFrame:
    """Leaves with the lowest inner node they belong to.

    A tree of up to BLOCK leaves has one.  In a larger one a node is a band of sizes and a part of it: sets of bands that are
    not neighbours are never linked.  A band has so many parts that one holds about BLOCK leaves, or fewer if they are
    large.  Sets go to the part of their smallest shingle hash: near copies mostly have the same."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)))).cast("int")
    rows = leaves.withColumn("size_band", band)
    ones = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    sizes = rows.groupBy("root", "size_band").agg(F.count("*").alias("c"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(ones) / ONES)).alias("parts"))
    whole = Window.partitionBy("root")
    sizes = sizes.withColumn("small", (F.sum("c").over(whole) <= BLOCK) & (F.sum("parts").over(whole) <= F.count("*").over(whole)))
    rows = rows.join(sizes.drop("c"), ["root", "size_band"])
    band = F.when(F.col("small"), 0).otherwise(F.col("size_band")).alias("band")
    part = F.when(F.col("small"), 0).otherwise(F.pmod(F.xxhash64("lead"), "parts")).cast("long").alias("part")
    return rows.select("root", "node", "label", "n", "small", band, part)


def _blocks(leaves: DataFrame) -> DataFrame:
    excess = F.col("n") - F.aggregate("bits", F.lit(0), lambda s, x: s + F.bit_count(x))
    grouped = leaves.groupBy("root", "band", "part").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(excess).alias("excess"),
        F.collect_list(F.struct("node", "label", "n", "bits")).alias("leaves"), *_ors(),
    )
    return grouped.select("root", "band", "part", "lo", "hi", "least", "most", "excess", "leaves", _bitmap())


def _ors() -> list[Column]:
    return [F.bit_or(F.get("bits", F.lit(i))).alias(f"b{i}") for i in range(BITMAP)]


def _bitmap() -> Column:
    return F.array(*[f"b{i}" for i in range(BITMAP)]).alias("bits")


def _with_parent(level: DataFrame) -> DataFrame:
    """Nodes with the band and part of their inner node: BANDS bands that follow one another, PARTS parts of each."""
    return level.withColumn("parent_band", F.floor(F.col("band") / BANDS).cast("int")).withColumn("parent_part", F.floor(F.col("part") / PARTS).cast("long"))


def _inner(level: DataFrame) -> DataFrame:
    grouped = level.groupBy("root", F.col("parent_band").alias("band"), F.col("parent_part").alias("part")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.max("excess").alias("excess"), *_ors(),
    )
    return grouped.select("root", "band", "part", "lo", "hi", "least", "most", "excess", _bitmap())


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in (a, b) links: the smallest node that can be reached.

    Large-star and small-star steps in turn: every node's larger neighbours are linked to its smallest neighbour,
    then its smaller ones, until nothing changes."""

    def mins(pairs: DataFrame) -> DataFrame:
        return saved(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-mins")

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = saved(edges, "star")
    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(mins(both).withColumnRenamed("u", "of"), F.col("u") == F.col("of")).filter("v > u")
        large = saved(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "star")
        small = large.join(mins(large).withColumnRenamed("u", "of"), F.col("u") == F.col("of"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = saved(small.select("e.u", "e.v").filter("u <> v").distinct(), "star")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v"), F.col("v")).distinct())


def near_groups(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach.  Null texts and texts without words have no shingles and
    are linked with nothing.  Rows of one id are judged by their own texts; null ids take part but name no group.  A text
    is read whole, as arrays of its bytes, which take some sixty times its size while it is cut."""
    return Join(docs, width, num, den).run().select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest doc_id, null last, and of equal ids that with the
    smallest hash of its text, then any one of the equal rows.  Rows without shingles all stay.

    Most ids go whole and are taken out by id alone.  Only where an id has rows that go and rows that stay, or none, or a
    kept row is there several times, the hash of the text is asked."""
    found = Join(docs, width, num, den).run()
    keys = saved(found.groupBy("component", "doc_id", "row").agg(F.count("*").alias("rows")), "thin-keys")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    first = saved(keys.filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("o")).select(F.col("component").alias("of"), "o"), "thin-first")
    kept = F.col("component").isNull() | order.eqNullSafe(F.col("o"))
    ranked = saved(keys.join(first, F.col("component") == F.col("of"), "left").select("doc_id", "row", "rows", "component", kept.alias("kept")), "thin-ranked")
    by_id = saved(ranked.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every")), "thin-ids")
    whole = saved(by_id.filter("NOT some AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id")), "thin-gone")
    partly = by_id.filter("NOT every AND (some OR doc_id IS NULL)").select(F.col("doc_id").alias("id"))
    gone = saved(ranked.filter("NOT kept").join(partly, F.col("doc_id").eqNullSafe(F.col("id"))).select(F.col("doc_id").alias("part_id"), F.col("row").alias("part_row")).distinct(), "thin-parts")
    again = saved(ranked.filter("kept AND rows > 1 AND component IS NOT NULL").select(F.col("doc_id").alias("many_id"), F.col("row").alias("many_row")), "thin-repeated")
    left = docs.join(whole, docs["doc_id"] == whole["gone_id"], "left_anti")
    here = lambda rows, keys, a, b: rows["doc_id"].eqNullSafe(keys[a]) & (F.xxhash64(rows["text"]) == keys[b])
    if not gone.isEmpty():
        left = left.join(gone, here(left, gone, "part_id", "part_row"), "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, here(left, again, "many_id", "many_row"), "left_anti")
    return once.unionAll(left.join(again, here(left, again, "many_id", "many_row"), "left_semi").dropDuplicates(["doc_id", "text"]))


def op3(spark, folder):
    """Shingle sets and link components of all documents: three words, similarity 0.9 or more."""
    return near_groups(table(spark, folder, "documents"), 3, 90, 100)
