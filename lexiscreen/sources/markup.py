"""Markup to plain text of the same length, so offsets need no mapping."""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One markup run, comments, scripts and styles included, or the text up to the next.
RUN = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>|[^<]+|<"


def flatten(pages: DataFrame, markup: str = "html") -> DataFrame:
    """Add ``text``: each markup run replaced by blanks of its length (a `<br>`
    or paragraph end by a line break padded with blanks), and ``markup_spans``."""
    runs = F.regexp_extract_all(F.col(markup), F.lit(RUN), F.lit(0))
    is_markup = lambda r: r.startswith("<") & (r != "<")
    as_text = lambda r: F.when(r.rlike("(?i)^<(br|/p)"), "\n").otherwise("")
    plain = lambda r: F.when(is_markup(r), F.rpad(as_text(r), F.length(r), " ")).otherwise(r)
    rows = pages.withColumn("_runs", runs)
    return rows.withColumn("text", F.array_join(F.transform("_runs", plain), "")).drop("_runs")


_PY_RUN = re.compile(RUN)
_FLUSH = 1 << 16


def spans(pages: DataFrame, markup: str = "html", key: str = "page_id") -> DataFrame:
    """(key, start, end) of every markup run: one pass over a page, in bounded batches."""

    def run(batches):
        for batch in batches:
            found = (
                (row, m.start(), m.end())
                for row, page in enumerate(batch.column("_page").to_pylist())
                for m in _PY_RUN.finditer(page or "")
                if m[0][0] == "<" and m[0] != "<"
            )
            while rows := list(islice(found, _FLUSH)):
                row, start, end = zip(*rows)
                kept = batch.column(key).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([kept, pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[key, "start", "end"])

    schema = T.StructType([pages.schema[key], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return pages.select(key, F.col(markup).alias("_page")).mapInArrow(run, schema)
