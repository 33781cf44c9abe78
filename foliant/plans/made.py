"""Values made up from the driver's tables, the same way for Spark and for SQL: the tables hold no file names, profiles,
spans or review phrases, so rows choose theirs from lists by their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chosen(values, index: str) -> Column:
    """The value at an index expression (from 0, a remainder of whole numbers)."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"int({index})"))


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def chosen_sql(values, index: str) -> str:
    return f"[{', '.join(map(literal, values))}][CAST({index} AS BIGINT) + 1]"
