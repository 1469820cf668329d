"""Layered configuration: request, defaults, user and organisation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str) -> DataFrame:
    """The current record per key of a change log: the newest entry, unless it
    is a deletion.  An aggregate, not a window: partial results merge before
    the shuffle, so a key with a long history stays cheap."""
    rest = [c for c in changes.columns if c != key]
    newest = changes.groupBy(key).agg(F.max(F.struct("ts", *[c for c in rest if c != "ts"])).alias("_n"))
    return newest.select(key, "_n.*").filter("NOT deleted").drop("deleted")


def settle_flag(request: Column, default: Column, user: Column, org: Column, built_in: Column, client_may_set: bool) -> Column:
    """One of the two flags: force of the organisation, then of the user, then
    the request (where clients may set it), defaults, suggestions, built-in.
    ``user`` and ``org`` are structs (value, status)."""
    forced = lambda c: F.when(c["status"] == "force", c["value"])
    offered = lambda c: F.when(c["status"] == "suggestion", c["value"])
    asked = request if client_may_set else F.lit(None).cast("boolean")
    return F.coalesce(forced(org), forced(user), asked, default, offered(user), offered(org), built_in)


def settle_value(request: Column, default: Column, user: Column, org: Column, built_in: Column) -> Column:
    """Any other field: only a force overrules what the request or a default set."""
    forced = lambda c: F.when(c["status"] == "force", c["value"])
    return F.coalesce(forced(org), forced(user), request, default, built_in)


def client_allowed(client: Column, version: Column, minimum: Column) -> Column:
    """No client is allowed; a version below the minimum of its client, or one
    that cannot be read, is not; a pre-release is below its release."""
    shape = r"^[0-9]+(\.[0-9]+){0,2}(-.+)?$"
    numbers = lambda v: F.transform(F.split(F.regexp_replace(v, "-.*$", ""), r"\."), lambda p: p.cast("int"))
    pre = F.when(version.contains("-"), 0).otherwise(1)
    at_least = (numbers(version) > numbers(minimum)) | ((numbers(version) == numbers(minimum)) & (pre == 1))
    return client.isNull() | minimum.isNull() | (version.rlike(shape) & at_least)
