"""Pairs within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a group that meet another item in one task.
MEETING = 1024


def pairs_within(df: DataFrame, key: str, item: str, size: str) -> DataFrame:
    """``(key, item_a, item_b)``, ``item_a < item_b``, of the items of equal ``key``; ``size`` is the number of items of the key.

    The items of a large group are spread by a salt and each meets all others there, so that no task forms more than
    ``MEETING`` pairs for each item it is sent; a group of up to ``MEETING`` items has one salt.  Items are distinct within a key.
    """
    salts = F.ceil(F.col(size) / MEETING).cast("int")
    a = df.select(key, F.col(item).alias(f"{item}_a"), F.pmod(F.xxhash64(item), salts).cast("int").alias("salt"))
    b = df.select(key, F.col(item).alias(f"{item}_b"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return a.join(b, [key, "salt"]).where(F.col(f"{item}_a") < F.col(f"{item}_b")).select(key, f"{item}_a", f"{item}_b")
