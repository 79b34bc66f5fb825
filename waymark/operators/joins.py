"""Joins whose small side is counted before it is broadcast, and whose hot keys are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.scratch import materialize

#: Stored tables of up to this many rows are broadcast.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that a task may join by itself.
HOT_ROWS = 500_000


def small_or_shuffled(stored: DataFrame) -> DataFrame:
    """A stored table, with a broadcast hint only if its rows, counted here, are few enough."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (stored; a row or few per key), no key being one task's however many rows ``left``
    has of it. ``counts``: keys and n, the rows of ``left``. A small ``right`` is broadcast; else keys of more than
    ``HOT_ROWS`` rows, at most rows / HOT_ROWS of them, are spread over salts, each with its copy of the right rows."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    hot = materialize(counts.where(F.col("n") > HOT_ROWS).select(*keys, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("__salts")), "hot")
    if hot.isEmpty():
        return left.join(right, keys, how)
    salts = small_or_shuffled(hot)
    spread = left.join(salts, keys, "left").withColumn("__salt", F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.col("__salts"))).otherwise(0).cast("int")).drop("__salts")
    copies = right.join(salts, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return spread.join(copies, [*keys, "__salt"], how).drop("__salt")
