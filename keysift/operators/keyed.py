"""Joins with a table of one row per key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.session import scratch_path

# A key with over a thousandth of all rows is one of under a thousand.
HOT_SHARE = 1000


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder all executors share, and read back: computed once, no lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _parted(rows: DataFrame, table: DataFrame, key: str, weight: str) -> tuple[DataFrame, Column, DataFrame]:
    """The hot keys of ``table``, ready to broadcast, the condition for them, and ``rows`` without them."""
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("total")).first().total
    hot = F.col(weight) * HOT_SHARE > total
    few = F.broadcast(table.where(hot))
    return few, hot, rows.join(few.select(key), key, "left_anti")


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, wanted: Column) -> DataFrame:
    """``rows`` with the columns of ``table``, for keys whose row there is ``wanted``.

    ``table`` has all keys of ``rows``; ``weight`` counts their rows. Keys with over a thousandth of the sum
    are fewer than a thousand: those are broadcast, so that their rows stay where they are. Only rows of
    the others are exchanged. ``table`` should be stored; it is read several times.
    """
    few, hot, others = _parted(rows, table, key, weight)
    return rows.join(few, key).where(wanted).unionByName(others.join(table.where(~hot & wanted), key))


def without(rows: DataFrame, table: DataFrame, key: str, weight: str, unwanted: Column) -> DataFrame:
    """``rows`` but for those whose key's row in ``table`` is ``unwanted``; otherwise as ``lookup``."""
    few, hot, others = _parted(rows, table, key, weight)
    often = rows.join(few.where(~unwanted).select(key), key, "left_semi")
    return often.unionByName(others.join(table.where(~hot & unwanted).select(key), key, "left_anti"))
