"""Quality rules by host, with DataFrame functions only.

Every text gets counts and from them the rules it fails.  Failures are summed by host.  A host with few documents says
little about itself, so its rate of a rule is shrunk: all hosts together give a beta prior (its mean is the rate of the
whole table, its weight follows from how much more the hosts differ than documents dealt out at random would), and a
host's rate is the posterior's mean.  A host is rejected if, for one rule, more than the limit of its documents fail
even two standard deviations below that mean.  Verdicts are joined back; texts are read once and never shuffled."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED_WORD, saved, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Share of failing documents above which a host is rejected, and the standard deviations of doubt it is granted.
LIMIT, DOUBT = 0.5, 2.0
#: The prior weighs as much as this many documents, at least and at most.
PRIOR_DOCUMENTS = (1.0, 999.0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the array, the first find included.

    Windows are hashed and sorted with their places, so that equal ones are neighbours: no pair is formed, and a text
    of n words takes n log n steps."""

    def spans(hashes: Column) -> Column:
        return F.transform(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))),
            lambda h, i: F.struct(F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]).alias("h"), i.alias("i")),
        )

    def twice(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        return F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))

    starts = _let(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: F.sort_array(spans(hashes))), twice)
    return F.aggregate(
        F.sort_array(F.transform(starts, lambda x: x["i"])),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )


def counts(text: Column) -> dict[str, Column]:
    """What the rules ask of a text; a null text counts as empty.  All in code points."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(SPACED_WORD))
    both = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeated")))
    twice = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return {
        "words": both,
        "lines": twice,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def measured(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Counts of every document beside its key and host, in the shared folder."""
    rows = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), *[c.alias(n) for n, c in counts(F.col(text)).items()])
    return saved(
        rows.select(
            "key",
            "host",
            F.col("words.n").alias("n_words"),
            "word_chars",
            "n_symbols",
            F.col("lines.n").alias("n_lines"),
            F.col("lines.dup").alias("n_dup_lines"),
            F.col("words.repeated").alias("n_repeat_words"),
        ),
        "host-rules-counts",
    )


def rules() -> dict[str, Column]:
    """Rules over the counts; a document fails where the condition holds."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 100 * n),  # scripts without spaces have long words
    }


#: Rules that reject a document whatever its host.
BASE = ("short", "repetitive")


def host_rates(rows: DataFrame, failed: Mapping[str, Column]) -> DataFrame:
    """One row a host: host, n and the documents that fail each rule.  Rows without a host are left out."""
    return rows.filter("host IS NOT NULL").groupBy("host").agg(
        F.count("*").alias("n"), *[F.count(F.when(c, 1)).alias(r) for r, c in failed.items()]
    )


def priors(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(alpha, beta) of each rule by moments, from sums over all hosts: one row reaches the driver."""
    n = F.col("n").cast("double")
    sums = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum(n).alias("n"),
        F.sum(n * n).alias("squares"),
        *[F.sum(F.col(r).cast("double")).alias(r) for r in names],
        *[F.sum(F.col(r) * (F.col(r) / n)).alias(f"{r}_spread") for r in names],
    ).first()
    least, most = PRIOR_DOCUMENTS
    found = {}
    for r in names:
        rate = (sums[r] or 0.0) / (sums["n"] or 1.0)
        weight = most
        if 0 < rate < 1:
            free = sums["hosts"] - 1
            spread = (sums[f"{r}_spread"] - sums["n"] * rate * rate) / (rate * (1 - rate))
            room = sums["n"] - sums["squares"] / sums["n"] - free
            alike = (spread - free) / room if room > 0 else 0.0
            weight = min(max(1 / alike - 1, least), most) if alike > 0 else most
        found[r] = (rate * weight, (1 - rate) * weight)
    return found


def rejected(hosts: DataFrame, names: list[str], limit: float = LIMIT, doubt: float = DOUBT) -> DataFrame:
    """(host, host_failed): the rejected hosts with the rules they are rejected for, comma-joined in order."""
    hits = []
    for r, (alpha, beta) in priors(hosts, names).items():
        a, b = F.col(r) + F.lit(alpha), F.col("n") - F.col(r) + F.lit(beta)
        mean, total = a / (a + b), a + b
        hits.append(F.when(mean - doubt * F.sqrt(a * b / (total * total * (total + 1))) > limit, F.lit(r)))
    return hosts.select("host", F.concat_ws(",", *hits).alias("host_failed")).filter("host_failed <> ''")


def judge(rows: DataFrame, limit: float = LIMIT, doubt: float = DOUBT) -> DataFrame:
    """``measured`` rows with base_failed, host_failed (rules their host is rejected for, else empty) and kept.

    Rows without a host have no host verdict; their own counts decide."""
    failed = rules()
    hosts = saved(host_rates(rows, failed), "host-rules-hosts")
    bad = saved(rejected(hosts, list(failed), limit, doubt), "host-rules-rejected").withColumnRenamed("host", "h")
    base = failed[BASE[0]] | failed[BASE[1]]
    joined = rows.withColumn("base_failed", base).join(bad, F.col("host") == F.col("h"), "left").drop("h")
    return joined.withColumn("host_failed", F.coalesce("host_failed", F.lit(""))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("host_failed") == "")
    )


def op11(spark, folder):
    """Counts, base rules and verdict of every document, with its source as host.

    Null and empty texts have no word and fail as short.  Documents without a source are judged by their own counts.
    Repeated rows count each; an empty table gives no rows.  Memory follows the longest text, its time n log n."""
    return judge(measured(table(spark, folder, "documents"))).select(
        F.col("key").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "host_failed",
    )


#: The same with one row a word and window.
OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
e AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM f) GROUP BY r),
d AS (SELECT t.doc_id, t.source, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(translate(t.t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t.t) - length(translate(t.t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(w.lines) AS n_lines,
    CAST(len(w.lines) - len(list_distinct(w.lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(e.n, 0) AS BIGINT) AS n_repeat_words
    FROM t JOIN w ON t.r = w.r LEFT JOIN e ON t.r = e.r),
x AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive, 10 * n_symbols > n_words AS symbols,
    10 * n_dup_lines > 3 * n_lines AS lines, word_chars < 2 * n_words OR word_chars > 100 * n_words AS word_length FROM d),
l AS (SELECT source, unnest(['short', 'repetitive', 'symbols', 'lines', 'word_length']) AS rule, unnest([1, 2, 3, 4, 5]) AS nr,
    unnest([short, repetitive, symbols, lines, word_length]) AS failed FROM x WHERE source IS NOT NULL),
h AS (SELECT source, rule, nr, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS k FROM l GROUP BY source, rule, nr),
m AS (SELECT rule, sum(k) / sum(n) AS p, count(*) - 1 AS free, sum(k * k / n) AS sk, sum(n) AS n, sum(n * n) AS sq FROM h GROUP BY rule),
o AS (SELECT rule, p, CASE WHEN p > 0 AND p < 1 AND n - sq / n - free > 0 AND (sk - n * p * p) / (p * (1 - p)) > free
    THEN least(greatest((n - sq / n - free) / ((sk - n * p * p) / (p * (1 - p)) - free) - 1, 1.0), 999.0) ELSE 999.0 END AS weight FROM m),
a AS (SELECT h.source, h.rule, h.nr, k + p * weight AS a, n - k + (1 - p) * weight AS b FROM h JOIN o ON h.rule = o.rule),
v AS (SELECT source, string_agg(rule, ',' ORDER BY nr) AS host_failed FROM a
    WHERE a / (a + b) - 2.0::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5::DOUBLE GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
    NOT (short OR repetitive) AND host_failed IS NULL AS kept, coalesce(host_failed, '') AS host_failed
FROM x LEFT JOIN v ON x.source = v.source"""
