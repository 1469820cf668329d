"""Personal data to placeholders: mail addresses, then network addresses, then digits.

The patterns follow the grammar of addresses: a host is a name, an IPv4 or IPv6 address or the local machine; an
address is a host with, around it, what may stand there.  They read alike in Java's and in RE2's dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SOLID = r"[^ \t\r\n]"
_DOMAIN = r"(?:[\p{L}\p{N}_-]+\.)+(?:xn--[a-z0-9-]+|\p{L}{2,})"
_IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
# In full, or with one gap: inside, at the front (with a digit behind it) or at the end (with two groups before it), as
# `::` is also punctuation.  An address begins and ends where words do.
_GROUP = "[0-9a-f]{1,4}"
_IPV6 = "|".join(
    (
        rf"\b(?:{_GROUP}:){{7}}{_GROUP}\b",
        rf"\b[0-9a-f]{{2,4}}:(?:{_GROUP}:){{0,5}}(?::{_GROUP}){{1,6}}\b",
        rf"\b[0-9a-f]{{2,4}}(?::{_GROUP}){{1,6}}::\B",
        rf"\B::(?:{_GROUP}:){{0,6}}[0-9a-f]{{0,3}}[0-9][0-9a-f]{{0,3}}\b",
    )
)
_HOST = rf"(?:\[(?:{_IPV6})\]|{_IPV6}|{_IPV4}|{_DOMAIN}|localhost)"
_SCHEME, _USER, _PORT, _REST = r"(?:[a-z][a-z0-9.+-]*://)?", r"(?:[^ \t\r\n@/]+@)?", r"(?::[0-9]{1,5})?", rf"(?:[/?#]{_SOLID}*)?"

EMAIL = rf"(?i)[\p{{L}}\p{{N}}._%+-]+@{_DOMAIN}"
URL = rf"(?i){_SCHEME}{_USER}{_HOST}{_PORT}{_REST}"
DIGITS = r"\p{Nd}+"
#: In this order, as a mail address holds a host and both may hold digits.
PLACEHOLDERS = ((EMAIL, "<EMAIL>"), (URL, "<URL>"), (DIGITS, "<NUMBER>"))


def mask(text: Column) -> Column:
    for pattern, placeholder in PLACEHOLDERS:
        text = F.regexp_replace(text, pattern, placeholder)
    return F.trim(text)


def masked_sql(text: str) -> str:
    """The same replacements as plain SQL."""
    for pattern, placeholder in PLACEHOLDERS:
        text = f"regexp_replace({text}, '{pattern}', '{placeholder}', 'g')"
    return f"trim({text})"
