"""Word edits between two versions of a text."""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_WORDS = re.compile(r"\s+|[^\s]+")


def word_edits(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, op, text) of the edit script from ``before`` to ``after``, with
    neighbouring operations of a kind merged.  Keeping `keep` and `delete` gives
    the text before, `keep` and `insert` the text after.  The longest common
    subsequence has no native form, so each pair is compared in an Arrow batch."""

    def script(before, after):
        if before == after:  # the comparison takes quadratic time in long texts, also in equal ones
            if before:
                yield "keep", before
            return
        a, b = _WORDS.findall(before or ""), _WORDS.findall(after or "")
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag == "equal":
                yield "keep", "".join(a[i1:i2])
            else:
                if i2 > i1:
                    yield "delete", "".join(a[i1:i2])
                if j2 > j1:
                    yield "insert", "".join(b[j1:j2])

    def run(batches):
        for batch in batches:
            rows = [
                (k, n, op, text)
                for k, (before, after) in enumerate(
                    zip(batch.column("before").to_pylist(), batch.column("after").to_pylist())
                )
                for n, (op, text) in enumerate(script(before, after))
            ]
            if rows:
                k, n, op, text = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(k)), pa.array(n, pa.int32()), pa.array(op, pa.string()), pa.array(text, pa.string())],
                    names=[key, "ord", "op", "text"],
                )

    schema = T.StructType([
        pairs.schema[key], T.StructField("ord", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField("text", T.StringType()),
    ])
    return pairs.select(key, "before", "after").mapInArrow(run, schema)
