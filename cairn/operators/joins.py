"""Joins that no key is too hot for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is hot; there are fewer hot keys than this.
HOT_SHARE = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str | list[str], count: str, total: int, parts: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a key), null where there is none. Hot keys don't meet in one task.

    ``count`` of ``facts`` says how many of the ``total`` rows have the key, so hot keys, by number fewer than HOT_SHARE,
    are broadcast; rows of hot keys, and of null ones, are spread over the shuffle that joins the others. With ``parts`` that
    shuffle has so many partitions at least, which aren't put together for being small on the wire.
    """
    hot = F.col(count) * HOT_SHARE > total
    keys = [key] if isinstance(key, str) else key
    own = [c for c in facts.columns if c not in (*keys, count)]
    few = facts.where(hot).select(*keys, F.struct(*own).alias("_hot"))
    # always 0, but no literal: the optimiser would put that in place of the column, and both sides would be dealt a second time
    zero = F.pmod(F.col(count), F.lit(1)).cast("long")
    many = facts.where(~hot).select(*keys, zero.alias("_salt"), F.struct(*own).alias("_cold"))
    out = rows.join(F.broadcast(few), keys, "left")
    absent = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    spread = F.when(F.col("_hot").isNotNull() | absent, F.xxhash64(*(F.col(c) for c in rows.columns if c not in keys)).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("_salt", spread)
    if parts:
        out, many = (df.repartition(parts, *keys, "_salt") for df in (out, many))
    out = out.join(many, [*keys, "_salt"], "left")
    return out.select(*rows.columns, *(F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in own))
