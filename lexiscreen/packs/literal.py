"""Small tables written down as rows: one rendering for Spark, one for plain
SQL.  They become local relations, whose exact size the optimizer knows, so it
decides by size whether to broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _spark_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v) + ("D" if isinstance(v, float) else "")
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v) + ("::DOUBLE" if isinstance(v, float) else "")
    return "'" + str(v).replace("'", "''") + "'"


def frame(spark: SparkSession, columns: str, rows) -> DataFrame:
    body = ", ".join("(" + ", ".join(map(_spark_value, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def values(columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"
