"""Joins whose key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.names import free

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str | Column], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right``, a table of few rows: every key's left rows are dealt over ``salts`` keys by the columns ``by``, the right ones copied."""
    (salt,) = free([*left.columns, *right.columns], "salt")
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    return dealt.join(right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, salt], how).drop(salt)


def spread_join(left: DataFrame, right: DataFrame, on: str, by: list[str], weight: str, total: int, how: str = "inner", least: int = 10_000, most: int = 1000, salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right``, one row a key, whose column ``weight`` counts the left rows of its key.

    Only keys of over ``total / most`` (and ``least``) rows, of which there are under ``most``, are dealt over salts.
    """
    if total <= least:
        return left.join(right.drop(weight), on, how)
    key, heavy, salt = free([*left.columns, *right.columns], "key", "hot", "salt")
    is_hot = F.col(weight) > max(least, total // most)
    hot = right.where(is_hot).select(F.col(on).alias(key), F.lit(True).alias(heavy))
    marked = left.join(F.broadcast(hot), F.col(on) == F.col(key), "left").drop(key)
    dealt = marked.withColumn(salt, F.when(F.col(heavy), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)).drop(heavy)
    copied = right.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(weight)
    return dealt.join(copied, [on, salt], how).drop(salt)
