"""Equi-joins with keys that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this, and than the ``HOT_KEYS``-th part of all, is dealt over salts.
HOT_ROWS = 10_000
HOT_KEYS = 4_096


def hot_limit(counts: DataFrame, n: str, hot_rows: int = HOT_ROWS) -> tuple[int, bool]:
    """(most rows of a key that isn't hot, whether any key is), from (*keys, ``n`` rows): one small job."""
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    limit = max(hot_rows, int(total or 0) // HOT_KEYS)
    return limit, int(most or 0) > limit


def hot_keys(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """(*keys, salts) of the keys with more than ``limit`` rows.

    With ``hot_limit``'s limit each has more than the ``HOT_KEYS``-th part of all rows, so there
    are fewer than ``HOT_KEYS`` of them whatever the table: this list may be broadcast.
    """
    keys = [c for c in counts.columns if c != n]
    return counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("salts"))


def few(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, broadcast to what they are joined with if they are ``most`` at most: one small job."""
    return F.broadcast(rows) if rows.count() <= most else rows


def salted_join(many: DataFrame, other: DataFrame, keys: list[str], counts: DataFrame, n: str, by: list[str],
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join on ``keys``; ``counts`` has the rows that ``many`` has of each
    value of some of the keys.

    Rows of a hot key in ``many`` are dealt over salts by a hash of ``by`` and of
    their partition; the rows of ``other`` are repeated for each salt.  Null keys match nothing.
    Without a hot key this is the plain join.
    """
    limit, any_hot = hot_limit(counts, n, hot_rows)
    if not any_hot:
        return many.join(other, keys)
    on = [c for c in counts.columns if c != n]
    hot = F.broadcast(hot_keys(counts, n, limit).withColumnRenamed("salts", "_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = many.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*by, F.spark_partition_id()), salts).cast("int")).drop("_salts")
    copies = other.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")
