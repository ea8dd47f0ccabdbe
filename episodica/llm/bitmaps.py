"""A membership filter of fixed size for keys held by Spark, used to spare shuffles.

A set of 64-bit hashes is reduced to a bitmap of 2**bits bits. Its size does not depend on the number of keys, so it may
go to all tasks. It only ever says "surely not in the set"; every key that passes is settled by a join afterwards, so a
full bitmap costs shuffle, never results.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(keys: DataFrame, column: str, bits: int) -> Broadcast:
    """Broadcast of the bitmap of a long column of well mixed hashes (nulls are left out).

    Bits of one 64-bit word are joined by Spark; what reaches the driver is at most 2**bits / 8 bytes.
    """
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = (
        keys.filter(F.col(column).isNotNull())
        .groupBy(F.shiftrightunsigned(slot, 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("held"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    if words.num_rows:
        table[words["word"].to_numpy()] = words["held"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def possible(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the set."""
    slot = keys >> np.uint64(64 - (len(table).bit_length() - 1 + 6))
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def held(key: Column, table: Broadcast) -> Column:
    """Whether the key, a long, may be in the set. Only the key goes through Python."""

    @F.pandas_udf("boolean")
    def inside(keys: pd.Series) -> pd.Series:
        return pd.Series(possible(table.value, keys.to_numpy().view(np.uint64)))

    return inside(key)


def with_possible(df: DataFrame, key: Column, table: Broadcast) -> DataFrame:
    """Add a column `possible`: whether the key may be in the set."""
    return df.withColumn("possible", held(key, table))


def without(df: DataFrame, drop: DataFrame, key: Column, drop_key: Column, same: Callable[[Column], Column], bits: int = 24) -> DataFrame:
    """The rows of df that match no row of drop.

    key and drop_key are hashes (longs) that are equal for rows that match by `same`, a condition on the columns of df and
    the struct of a row of drop that it is given. Rows whose key cannot be in drop go straight through; only the others are
    shuffled to the join that decides. The columns of df may have any names: the two that are added get names of their own.
    """
    mark, other = f"_mark_{uuid4().hex}", f"_drop_{uuid4().hex}"
    table = bitmap(drop.select(drop_key.alias("key")).distinct(), "key", bits)
    marked = df.withColumn(mark, held(key, table))
    dropped = drop.select(F.struct(*drop.columns).alias(other))
    rest = marked.filter(F.col(mark)).join(dropped, same(F.col(other)), "left_anti").drop(mark)
    return marked.filter(~F.col(mark)).drop(mark).unionByName(rest)
