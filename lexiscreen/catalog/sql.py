"""Common table expressions shared by the plain-SQL counterparts."""

from __future__ import annotations

from ..operators.tokens import BLANKS, PIECE
from ..packs import literal, rules

_PIECE = PIECE.replace("'", "''")
TOKENS = rf"""
pieces AS (
  SELECT doc_id, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS i
  FROM (SELECT doc_id, lang, regexp_extract_all(text, '{_PIECE}') AS ps FROM documents)),
tokens AS (
  SELECT doc_id, lang, i, tok, substr(piece, length(tok) + 1) AS ws, start, start + length(tok) AS "end", sent
  FROM (SELECT *, regexp_extract(piece, '^[^{BLANKS}]*') AS tok,
      coalesce(sum(length(piece)) OVER before, 0)::BIGINT AS start,
      coalesce(sum((left(piece, 1) IN ('.', '!', '?'))::INT
        + length(piece) - length(replace(piece, chr(10), ''))) OVER before, 0)::BIGINT AS sent
    FROM pieces
    WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE tok <> '')"""
VOCABULARY = TOKENS + ", vocabulary AS (SELECT lang, tok, count(*) AS n FROM tokens GROUP BY lang, tok)"

RULES = "rules AS " + literal.values(rules.RULE_COLUMNS, rules.RULES)
LEMMAS = "lemmas AS " + literal.values(rules.LEMMA_COLUMNS, rules.LEMMAS)
TAXONOMY = "taxonomy AS " + literal.values(rules.TAXONOMY_COLUMNS, rules.TAXONOMY)
LEVELS = "levels AS " + literal.values(rules.LEVEL_COLUMNS, rules.LEVELS)
ALTERNATIVES = "alternatives AS " + literal.values(rules.ALTERNATIVE_COLUMNS, rules.ALTERNATIVES)
FALSE_POSITIVES = "false_positives AS " + literal.values(rules.FALSE_POSITIVE_COLUMNS, rules.FALSE_POSITIVES)
SOURCES = "sources AS " + literal.values(rules.SOURCE_COLUMNS, rules.SOURCES)


def with_(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n"
