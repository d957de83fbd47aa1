"""Joins that stay even when one key holds a large part of all rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this part of the left side's rows is hot; there can't be more hot keys than its inverse.
HOT_SHARE = 1 / 500
#: Rows up to which a counted side is broadcast whole.
SMALL_ROWS = 100_000
#: Left rows of a key that one task joins with the key's right rows, where both sides hold the key many times.
ROWS_PER_REPLICA = 1000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int, rows: int | None = None) -> DataFrame:
    """Inner join of `left` to `right`, unique in `keys`, whose column `size` has each key's number of rows on the left.

    With `rows`, the number of rows of `right`, counted by the caller, and SMALL_ROWS at most, right is broadcast. Else
    keys with HOT_SHARE of the `total` left rows, 500 rows at most whatever the data, are joined by broadcast, so their rows
    stay where they are; all others are shuffled, and none of their groups is larger than that share."""
    if rows is not None and rows <= SMALL_ROWS:
        return left.join(F.broadcast(right), keys)
    hot = right.where(F.col(size) >= max(2.0, total * HOT_SHARE))
    cold = right.where(F.col(size) < max(2.0, total * HOT_SHARE))
    return left.join(F.broadcast(hot), keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def join_many(left: DataFrame, right: DataFrame, key: str, spread_by: str | Column, replica_rows: int = ROWS_PER_REPLICA, largest: float | None = None) -> DataFrame:
    """Inner join on `key` where both sides hold it many times. `left` should be read cheaply (cut before), it is counted first.

    Keys with HOT_SHARE of the left rows and more than replica_rows (500 keys at most) are split: their left rows are dealt
    out over replicas of about replica_rows by a hash of spread_by, their right rows are copied to each, so that no task
    forms all pairs of one key. Without such keys it is a plain join; `largest`, if the caller knows no key has more left rows, saves the count."""
    if largest is not None and largest < replica_rows:
        return left.join(right, key)
    counted = left.groupBy(key).agg(F.count(F.lit(1)).alias("rows_"))
    total = left.count()
    hot = counted.where(F.col("rows_") >= max(float(replica_rows), total * HOT_SHARE)).collect() if total else []
    if not hot:
        return left.join(right, key)
    spark = left.sparkSession
    parts = F.broadcast(spark.createDataFrame([(r[key], -(-r["rows_"] // replica_rows)) for r in hot], f"`{key}` {dict(left.dtypes)[key]}, parts_ int"))
    salted = left.join(parts, key).withColumn("part_", F.pmod(F.xxhash64(spread_by), F.col("parts_")).cast("int")).drop("parts_")
    copied = right.join(parts, key).withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")
    cold = left.join(parts.select(key), key, "left_anti").join(right.join(parts.select(key), key, "left_anti"), key)
    return cold.unionByName(salted.join(copied, [key, "part_"]).drop("part_"))
