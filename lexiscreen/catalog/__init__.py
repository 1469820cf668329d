"""All registered queries."""

from . import aggregations, composite, grammar, joins, lexicons, ordered, predicates, romance, scalars, scans, screening, setops, spans, streams, topk  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
