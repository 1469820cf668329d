"""Whole jobs: table in, table out."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import words as w
from ..operators import guardrail
from ..packs import fixed, literal, rules as packs
from ..plans import check, review
from ..sources import texts as src
from . import sql as q
from .aggregations import COUNTS, GRADED, LIMITS, LIMITS_SQL, VERDICTS, WORDS
from .joins import NEAR
from .ordered import PARTS, screening
from .registry import query

_NAMES = lambda: F.array_join(F.transform(F.filter("alternatives", lambda a: ~a["is_remove"]), lambda a: a["alt"]), " / ")


REVIEWED = (
    screening(off=str(list(fixed.INCLUSIVE_CATEGORIES)))
    .replace("FROM documents", "FROM (SELECT doc_id * 1000000 + part_no AS doc_id, lang, part AS text FROM cut_docs)")
)
CUT = (
    "source AS (SELECT doc_id, text FROM documents),\n" + PARTS.format(size=1000)
    + ",\ncut_docs AS (SELECT c.doc_id, c.part_no, c.part, d.lang FROM cuts c JOIN documents d ON d.doc_id = c.doc_id WHERE part_no >= 0)"
)
REVIEW = REVIEWED.replace("WITH RECURSIVE ", "WITH RECURSIVE " + CUT + ",\n") + ",\n" + ",\n".join(
    (
        GRADED,
        COUNTS.replace("SELECT doc_id, ", "SELECT doc_id // 1000000 AS doc_id, ", 3).replace(
            "counts AS (SELECT doc_id // 1000000 AS doc_id, level", "counts AS (SELECT doc_id, level"
        ),
        r"""worded AS (SELECT doc_id, sum(len(regexp_extract_all(part, '[^ \t\r\n\f\x{b}\x{a0}]+')))::BIGINT AS words FROM cut_docs GROUP BY doc_id)""",
        LIMITS_SQL,
        VERDICTS,
    )
)


_DETECTED = w.stopword_sql("c.part")
_REASK = [p.replace("'", "''") for p in re.split(r"\{text\}|\{issues\}", fixed.REASK)]


@query(
    "c02_guardrail_review",
    REVIEW.replace("d.lang FROM cuts c JOIN documents d ON d.doc_id = c.doc_id WHERE", f"{_DETECTED} AS lang FROM cuts c WHERE").replace(
        "FROM cut_docs GROUP BY doc_id)", "FROM cut_docs WHERE lang IS NOT NULL GROUP BY doc_id)"
    )
    + f""",
    spoken AS (SELECT doc_id, arg_min(lang, part_no) AS language FROM cut_docs WHERE lang IS NOT NULL GROUP BY doc_id),
    shifted AS (SELECT g.*, g.doc_id // 1000000 AS whole, g.start + c.shift AS place FROM graded g JOIN (SELECT doc_id, part_no, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY part_no)::BIGINT - length(part) AS shift FROM cut_docs) c
      ON c.doc_id = g.doc_id // 1000000 AND c.part_no = g.doc_id % 1000000),
    spots AS (SELECT whole AS doc_id, string_agg(place || '-' || (place + length(text)) || ':' || subcategory, ',' ORDER BY place) AS found FROM shifted GROUP BY whole),
    items AS (SELECT whole AS doc_id, place, n_alts > 0 AS has, CASE WHEN n_alts > 0 THEN '{{"issue":"' || text || '","alternatives":[' ||
        CASE WHEN removals THEN '{{"remove":true}}' ELSE '{{"alt":"' || replace(names, ' / ', '"}},{{"alt":"') || '"}}' END || ']}}'
       ELSE '{{"issue":"' || text || '","alternatives":[],"explanation":"' || explanation || '"}}' END AS item FROM shifted),
    issues AS (SELECT doc_id, '[' || string_agg(item, ',' ORDER BY NOT has, place) || ']' AS issues FROM items WHERE item IS NOT NULL GROUP BY doc_id)
    SELECT d.doc_id, s.language, coalesce(w.words, 0) AS words, CASE WHEN f.failed_on IS NULL THEN 'pass' ELSE 'fail' END AS verdict, f.failed_on, p.found,
      CASE WHEN f.failed_on IS NOT NULL THEN md5('{_REASK[0]}' || to_json(d.text) || '{_REASK[1]}' || i.issues || '{_REASK[2]}') END AS reask
    FROM documents d LEFT JOIN spoken s USING (doc_id) LEFT JOIN worded w USING (doc_id) LEFT JOIN failing f USING (doc_id) LEFT JOIN spots p USING (doc_id) LEFT JOIN issues i USING (doc_id)""",
)
def c02(spark, folder):
    """Verdicts on texts that name no language: each part is checked in its own, findings keep their place in the whole text."""
    docs = src.documents(spark, folder).withColumn("lang", F.lit(None).cast("string"))
    rows = review.review(docs, spark, limit_rows=LIMITS)
    spots = F.array_join(F.transform("found", lambda x: F.concat(x["start16"].cast("string"), F.lit("-"), x["end16"].cast("string"), F.lit(":"), x["subcategory"])), ",")
    return rows.select("doc_id", "language", "words", "verdict", "failed_on", spots.alias("found"), F.md5("reask").alias("reask"))


@query(
    "c03_annotate_or_block",
    screening() + ",\n" + ",\n".join((GRADED, COUNTS, WORDS, LIMITS_SQL, VERDICTS))
    + """,\nnotes AS (SELECT doc_id, string_agg('"' || text || '" → ' || coalesce(names, ''), '; ' ORDER BY start) AS note FROM graded WHERE n_alts > 0 GROUP BY doc_id)
     SELECT d.doc_id, CASE WHEN f.failed_on IS NULL THEN md5(d.text) WHEN d.doc_id % 2 = 0 THEN 'blocked' WHEN n.note IS NULL THEN md5(d.text) ELSE md5(d.text || chr(10) || chr(10) || n.note) END AS outcome
     FROM documents d LEFT JOIN failing f USING (doc_id) LEFT JOIN notes n USING (doc_id)""",
)
def c03(spark, folder):
    """Failing texts get the note appended or, under the other policy (even ids),
    are blocked.  The result is the hash of what the reader would get."""
    docs = src.documents(spark, folder)
    limits = review.limits(spark, LIMITS)
    rows = guardrail.outcomes(docs, check.findings(docs, spark), limits, block=F.col("doc_id") % 2 == 0)
    noted = F.md5(F.concat_ws("\n\n", "text", "note"))
    outcome = F.when(F.col("verdict") == "pass", F.md5("text")).when(F.col("blocked"), "blocked").otherwise(noted)
    return rows.select("doc_id", outcome.alias("outcome"))


@query(
    "c05_apply_alternatives",
    screening() + ",\n" + GRADED
    + """,\nedits AS (SELECT doc_id, start, start + length(text) AS stop, split_part(names, ' / ', 1) AS new,
        coalesce(lag(start + length(text)) OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM graded WHERE n_alts > 0 AND names IS NOT NULL),
     joined AS (SELECT e.doc_id, string_agg(substr(d.text, prev::BIGINT + 1, (start - prev)::BIGINT) || new, '' ORDER BY start) AS head, max(stop) AS stop FROM edits e JOIN documents d USING (doc_id) GROUP BY e.doc_id)
     SELECT d.doc_id, md5(head || substr(d.text, stop::BIGINT + 1)) AS rewritten FROM joined JOIN documents d USING (doc_id)""",
)
def c05(spark, folder):
    """Texts with the first suggestion of every finding applied.  Findings never
    overlap, so the pieces between them and the suggestions are joined in order,
    once per text."""
    docs = src.documents(spark, folder).select("doc_id", "text")
    found = check.findings(src.documents(spark, folder), spark)
    usable = F.filter("alternatives", lambda a: ~a["is_remove"])
    edits = found.select("doc_id", "start", "end", F.get(usable, F.lit(0))["alt"].alias("new")).filter("new IS NOT NULL")
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("e"))
    rows = docs.join(listed, "doc_id")
    pieces = F.transform(
        "e",
        lambda x, k: F.concat(
            F.substring("text", F.when(k == 0, 0).otherwise(F.get("e", k - 1)["end"]) + 1,
                        x["start"] - F.when(k == 0, 0).otherwise(F.get("e", k - 1)["end"])),
            x["new"],
        ),
    )
    tail = F.substring("text", F.element_at("e", -1)["end"] + 1, F.length("text"))
    return rows.select("doc_id", F.md5(F.concat(F.array_join(pieces, ""), tail)).alias("rewritten"))


ADHOC = [(900, "en", "that the", "default", True, False, "", "slur", "default", None, False, None, None, "asked")]


@query(
    "c07_adhoc_rule",
    "WITH rules AS " + literal.values(packs.RULE_COLUMNS, ADHOC) + ", " + q.with_(q.LEMMAS, NEAR).removeprefix("WITH ")
    + "SELECT doc_id, start, text FROM matched",
)
def c07(spark, folder):
    """One user-supplied rule over the corpus."""
    rules = literal.frame(spark, packs.RULE_COLUMNS, ADHOC)
    return check.matched(src.documents(spark, folder), rules, packs.lemmas(spark)).select("doc_id", "start", "text")


@query(
    "c13_token_table",
    q.with_(q.LEMMAS, q.TOKENS)
    + """SELECT t.doc_id, t.i, t.tok, t.ws, t.start, coalesce(l.lemma, t.tok) AS lemma, coalesce(l.word_type, '') AS word_type,
      CASE WHEN l.lemma IS NOT NULL AND l.lemma <> t.tok THEN '~' ELSE '' END || coalesce(l.word_type, '') AS spec
     FROM tokens t LEFT JOIN lemmas l ON l.lang = t.lang AND l.form = lower(t.tok)""",
)
def c13(spark, folder):
    from ..operators import matching
    from ..operators.tokens import tokens

    rows = matching.annotate(tokens(src.documents(spark, folder)), packs.lemmas(spark))
    kind = F.coalesce("word_type", F.lit(""))
    spec = F.concat(F.when(F.col("lemma") != F.col("tok"), "~").otherwise(""), kind)
    return rows.select("doc_id", "i", "tok", "ws", "start", "lemma", kind.alias("word_type"), spec.alias("spec"))
