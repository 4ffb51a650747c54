"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.functions import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql_fold(x: str) -> str:
    """fold() as DuckDB SQL."""
    for a, b in text.DIGRAPHS:
        x = f"replace({x}, '{a}', '{b}')"
    accents, plain = text.ACCENTED.replace("'", "''"), text.FOLDED.replace("'", "''")
    x = f"translate(translate({x}, '{accents}{text.UPPER}', '{plain}{text.LOWER}'), '{text.UPPER}', '{text.LOWER}')"
    x = rf"regexp_replace({x}, '{text.INVISIBLE}', '', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '{text.BLANKS}', ' ', 'g'), ' ?\n[\n ]*', chr(10), 'g')"
    return f"trim({x}, ' ' || chr(10))"


def sql_list(values) -> str:
    """A list of SQL literals; None is NULL."""
    quoted = ("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values)
    return "[" + ", ".join(quoted) + "]"
