"""Secret scans with a battery of randomness tests, with DataFrame functions only.

Base patterns give assignments, access keys and long hex runs.  The battery looks at every long run of key
characters.  It infers the run's encoding, then tests
- chi-squared uniformity over that alphabet, against the excess that ordinary writing has over it,
- changes of character class: names and paths change between letters and digits rarely, and between cases and separators where
  a word begins; keys change more often (a z-value each, judged only where the encoding has these classes),
- runs above and below the alphabet's middle, and serial correlation, which keys must not fail.
These but the last give a p-value for "this is ordinary writing", bounded from above.  Letters of one case have no change of
class, and their counts alone tell little: there the p-value comes from which letters they are, as the likelihood ratio
of natural to uniform letters, and uniformity is one more test that keys must not fail.  The Benjamini-Hochberg rule, for each
class of lengths on its own as short runs carry less evidence, holds the share of false finds.  P-values are rounded
up to a grid, so that their counts are a small table and no row is sorted."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

#: The base patterns; the last group of an assignment is its value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Whole runs are taken, so a least length in the pattern drops the same matches as a filter would.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: Encodings in the order in which they are tried: pattern, symbols, and the excess of n * chi-squared that ordinary
#: writing has over them, from the index of coincidence 0.0667 of natural letters.
ENCODINGS = (
    (r"^[0-9]+$", "0123456789", None),
    (r"^[0-9a-f]+$", "0123456789abcdef", 1.67),
    (r"^[0-9A-F]+$", "0123456789ABCDEF", 1.67),
    (r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.73),  # letters of one case, judged by LETTERS
    (r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.73),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.13),
    (r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.4),
    (r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.4),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.14),
    (r"^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 3.4),
)
#: How often a to z are written, in thousandths, as the mean of English, French, German and Spanish.
LETTERS = (86, 17, 33, 46, 143, 14, 20, 31, 70, 5, 6, 46, 28, 77, 63, 19, 6, 68, 75, 69, 41, 12, 11, 2, 8, 5)
#: Most that one of these languages has of the ratio of uniform letters to LETTERS, on average over its own letters.
LANGUAGE = 1.033
#: Shares of steps at which names and paths change between letters and digits, and between the other classes: words of a
#: name follow one another every six characters or so, and both ends of a hump or separator are a change.
DIGIT_CHANGES, OTHER_CHANGES = 0.06, 0.33
#: Steps of the p-value grid per power of ten, and its end.
GRID, GRID_END = 100, 4000
#: Class lengths begin here.
LENGTHS = (20, 32, 64)
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def spans(text: Column, pattern: str, value_group: int = 0) -> Column:
    """All matches, leftmost first and without overlap: array of (start, end, token, value), in code points.

    The gaps between the matches come from a split by the same pattern.  Ends are running sums, blockwise, so that
    a text with very many matches does not take quadratic time."""
    regex = F.lit(pattern)
    parts = F.struct(
        F.regexp_extract_all(text, regex, F.lit(0)).alias("tokens"),
        F.regexp_extract_all(text, regex, F.lit(value_group)).alias("values"),
        F.split(text, pattern, -1).alias("gaps"),
    )

    def with_steps(p: Column) -> Column:
        steps = F.transform(p["tokens"], lambda t, i: (F.length(t) + F.length(F.get(p["gaps"], i))).cast("long"))
        return let(F.struct(p["tokens"].alias("tokens"), p["values"].alias("values"), steps.alias("steps")), with_blocks)

    def with_blocks(p: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(p["steps"]) - 1) / _BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: _sum(F.slice(p["steps"], b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(blocks, lambda sums: let(F.transform(numbers, lambda b: _sum(F.slice(sums, F.lit(1), b))), lambda before: found(p, before)))

    def found(p: Column, before: Column) -> Column:
        def one(token: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            end = F.get(before, block) + _sum(F.slice(p["steps"], block * _BLOCK + 1, i - block * _BLOCK + 1))
            return F.struct((end - F.length(token)).alias("start"), end.alias("end"), token.alias("token"), F.get(p["values"], i).alias("value"))

        return F.transform(p["tokens"], one)

    kind = "array<struct<start:bigint,end:bigint,token:string,value:string>>"
    return F.when(text.rlike(pattern), let(parts, with_steps)).otherwise(F.array().cast(kind))


def _class_changes(chars: Column) -> Column:
    """(digit, other): steps between a letter and a digit, and steps between lower case, upper case and symbols or between
    a symbol and a digit."""

    def kind(c: Column) -> Column:
        return F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)

    def counted(k: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(k) - 1), lambda i: F.struct(F.get(k, i - 1).alias("a"), F.get(k, i).alias("b")))
        changed = F.filter(pairs, lambda p: p["a"] != p["b"])
        digit = F.size(F.filter(changed, lambda p: (F.least(p["a"], p["b"]) == 0) & (F.greatest(p["a"], p["b"]) < 3)))
        return F.struct(digit.alias("digit"), (F.size(changed) - digit).alias("other"))

    return let(F.transform(chars, kind), counted)


def _passes_as_random(values: Column, n: Column, symbols: Column) -> Column:
    """Neither runs above and below the middle nor serial correlation are unlikely (below one in a thousand)."""

    def judged(x: Column) -> Column:
        high = F.size(F.filter(x, lambda v: v * 2 > symbols)).cast("double")
        steps = F.sequence(F.lit(1), F.size(x) - 1)
        changes = F.size(F.filter(steps, lambda i: (F.get(x, i) * 2 > symbols) != (F.get(x, i - 1) * 2 > symbols)))
        pairs = 2 * high * (n - high)
        deviation = F.sqrt(pairs * (pairs - n) / (n * n * (n - 1)))
        runs = F.when(deviation > 0, F.abs(changes - pairs / n) / deviation).otherwise(F.lit(99.0))
        mean = _sum(x) / n
        square = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        product = F.aggregate(steps, F.lit(0.0), lambda a, i: a + (F.get(x, i) - mean) * (F.get(x, i - 1) - mean))
        serial = F.when(square > 0, F.abs(product / square + 1 / (n - 1)) * F.sqrt(n)).otherwise(F.lit(99.0))
        return (runs < 3.3) & (serial < 3.3)

    return let(values, judged)


def _unlike_letters(token: Column, n: Column) -> Column:
    """-log10 of the likelihood ratio of natural to uniform letters, an upper bound of the p-value by Markov's rule."""
    costs = F.array(*[F.lit(-math.log10(x / sum(LETTERS))) for x in LETTERS])
    cost = F.aggregate(F.split(F.lower(token), ""), F.lit(0.0), lambda a, c: a + F.get(costs, F.ascii(c) - ord("a")))
    return cost - n * math.log10(len(LETTERS) * LANGUAGE)


def evidence(token: Column) -> Column:
    """Grid number of the run's p-value as ordinary writing: -log10(p) * GRID, rounded down; -1 if it is digits
    only or fails a test that random keys pass."""
    n = F.length(token).cast("double")
    symbols = F.lit(None).cast("string")
    excess = F.lit(None).cast("double")
    for pattern, letters, more in reversed(ENCODINGS):
        symbols = F.when(token.rlike(pattern), F.lit(letters)).otherwise(symbols)
        excess = F.when(token.rlike(pattern), F.lit(more).cast("double")).otherwise(excess)

    def tested(e: Column) -> Column:
        size = F.length(e["symbols"]).cast("double")
        chars = F.split(token, "")
        squares = F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)),
        )
        chi = squares * size / n - n
        less = (size - 1 + n * e["excess"] - chi) / F.sqrt(2 * (size - 1) + 4 * n * e["excess"])
        more = lambda seen, share: (seen - (n - 1) * share) / F.sqrt((n - 1) * (share * (1 - share)))
        z = let(
            _class_changes(chars),
            lambda c: F.when(
                e["symbols"].rlike("[a-z]") & e["symbols"].rlike("[A-Z]"),
                (less + more(c["digit"], DIGIT_CHANGES) + more(c["other"], OTHER_CHANGES)) / F.sqrt(F.lit(3.0)),
            ).otherwise((less + more(c["digit"], DIGIT_CHANGES)) / F.sqrt(F.lit(2.0))),
        )
        values = F.transform(chars, lambda c: F.instr(e["symbols"], c).cast("long"))
        one_case = size == len(LETTERS)
        uniform = chi < size - 1 + 3.3 * F.sqrt(2 * (size - 1))
        power = F.when(one_case, _unlike_letters(token, n)).when(z > 0, (z * z / 2 + F.log(F.lit(2.0))) / F.log(F.lit(10.0))).otherwise(0.0)
        grid = F.greatest(F.least(F.floor(power * GRID), F.lit(GRID_END)), F.lit(0)).cast("int")
        fits = e["excess"].isNotNull() & (~one_case | uniform) & _passes_as_random(values, n, size)
        return F.when(fits, grid).otherwise(-1)

    return let(F.struct(symbols.alias("symbols"), excess.alias("excess")), tested)


def _length_class(n: Column) -> Column:
    number = F.lit(0)
    for k, least in enumerate(LENGTHS):
        number = F.when(n >= least, k).otherwise(number)
    return number


def cutoffs(graded: DataFrame, rate: float) -> dict[int, int]:
    """For each class of lengths the least grid number that the Benjamini-Hochberg rule takes at ``rate``.
    ``graded`` has a row (length_class, grid) for each run; the table of counts is bounded by the grid."""
    counts = graded.groupBy("length_class", F.greatest("grid", F.lit(0)).alias("grid")).count()
    own = Window.partitionBy("length_class")
    above = own.orderBy(F.desc("grid"))
    taken = counts.withColumn("rank", F.sum("count").over(above)).withColumn("all", F.sum("count").over(own)).filter(
        F.pow(F.lit(10.0), -F.col("grid") / GRID) <= rate * F.col("rank") / F.col("all")
    )
    return {r["length_class"]: r["grid"] for r in taken.groupBy("length_class").agg(F.min("grid").alias("grid")).collect()}


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: float = 0.001) -> DataFrame:
    """(key, found): all spans of a text as structs (start, kind, end), ordered; kind is a place in KINDS."""
    body = F.coalesce(F.col(text), F.lit(""))

    def numbered(found: Column, kind: int) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = F.concat(
        numbered(F.filter(spans(body, ASSIGN, 2), lambda s: F.length(s["value"]) >= 6), 0),
        numbered(spans(body, ACCESS), 1),
        numbered(spans(body, HEX), 2),
    )
    runs = F.transform(
        spans(body, RUN),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            _length_class(s["end"] - s["start"]).alias("length_class"),
            evidence(s["token"]).alias("grid"),
        ),
    )
    found = saved(docs.select(F.col(key).alias("key"), base.alias("base"), runs.alias("runs")), "secret-runs")
    least = cutoffs(found.select(F.explode("runs").alias("run")).select("run.length_class", "run.grid"), rate)
    enough = F.lit(False)
    taken = lambda r: F.coalesce(
        F.lit(False) if not least else F.greatest(*[(r["length_class"] == k) & (r["grid"] >= max(g, 1)) for k, g in least.items()], enough), enough
    )
    return found.select(
        "key", F.array_sort(F.concat("base", numbered(F.filter("runs", taken), 3))).alias("found")
    )


def joined(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(found, lambda s: F.concat(F.get(kinds, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ","
    )


def op10(spark, folder):
    """Secrets of every document: base spans and the battery's.

    Null and empty texts have none; a very long text is read whole, its spans are counted blockwise.  A run that is also
    a base match is listed as both.  Repeated rows give equal
    results; with an empty table no run is graded."""
    rows = scan(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        F.col("key").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
