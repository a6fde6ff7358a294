"""Joins to a table of one row a key where a few keys may have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast, at most.
BROADCAST_ROWS = 100_000
#: A key with more rows than this isn't sent to one task.
HOT_ROWS = 20_000


def lookup(rows: DataFrame, table: DataFrame, on: list[str], n: str, how: str = "inner", *, hot: int = HOT_ROWS, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined (inner or left) to table, which has one row a key; its column n says how many rows the key has.

    A table of at most ``limit`` rows is broadcast. Of a larger one the keys with over ``hot``
    rows are: since their counts add up to no more than all rows, raising hot to rows / limit
    bounds them by limit. The others are joined by a shuffle, in which no key has more than
    hot rows. Write table down first; it is read several times, rows twice.
    """
    size = table.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(n), F.lit(0)).alias("rows"), F.coalesce(F.max(n), F.lit(0)).alias("most")).first()
    if size["keys"] <= limit:
        return rows.join(F.broadcast(table), on, how)
    hot = max(hot, -(-size["rows"] // limit))
    if size["most"] <= hot:
        return rows.join(table, on, how)
    heavy, light = table.where(F.col(n) > hot), table.where(F.col(n) <= hot)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(heavy), on).unionByName(rest.join(light, on, how))
