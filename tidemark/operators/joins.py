"""Joins that hold up when one key carries a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SALT = "__salt"
_SALTS = "__salts"

# A side is broadcast only when a count already at hand proves it this small.
BROADCAST_ROWS = 500_000

# Hot keys are sought among this many slices at most; it bounds sketch and broadcast.
MAX_SLICES = 10_000


# Bytes a hinted side may come to, by what a value of each type is taken to need at most in the mean.
BROADCAST_BYTES = 64 << 20
_STRING, _MANY = 128, 4096


def _width(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType) for f in kind)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return _MANY
    return _STRING if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def guarded_broadcast(df: DataFrame, rows: int | None) -> DataFrame:
    """Hint a side whose row count is known to be small; otherwise leave it to shuffle.

    How many rows are few depends on their columns: half a million ids, some thousands with arrays.
    """
    if rows is not None and rows <= BROADCAST_ROWS and rows * _width(df.schema) <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df


def hot_keys(df: DataFrame, key: str, slices: int) -> DataFrame:
    """Keys heavier than an even slice of the rows, and how many salts each needs.

    At most `slices` keys can be that heavy, so the result is bounded however large
    `df` is. It comes from one pass over one column with a mergeable sketch. Salting
    only needs both sides to agree, so an approximate count costs balance, never rows.
    """
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k({key}, {slices}, {slices * 10})").alias("tops"),
        F.count(F.lit(1)).alias("n"),
    )
    top = sketch.select("n", F.explode("tops").alias("top"))
    heavy = F.col("top.count") * slices > F.col("n")
    # one row per slice of 1,000 rows at least, so that small inputs stay unsalted
    big_enough = F.col("top.count") > 1000
    return top.where(heavy & big_enough).select(
        F.col("top.item").alias(key),
        F.ceil(F.col("top.count") * slices / F.col("n")).cast("int").alias(_SALTS),
    )


def _slices(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return min(MAX_SLICES, max(8, int(conf) if conf.isdigit() else 200))


def skew_safe_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread_by: list[str],
    slices: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Equi-join of a possibly skewed `left` to a `right` holding each key once.

    `rows` is the size of `left` where a count is at hand. A small left sends its keys to
    the right, which is then filtered in place and never shuffled. Otherwise the hot keys
    of `left` are looked up first: their rows are spread over several salts, chosen from
    `spread_by` so that a retried task makes the same choice, and only their rows of
    `right` are repeated. Without hot keys this is a plain join.
    `how` is inner, left, left_semi or left_anti.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        wanted = F.broadcast(left.select(key).distinct())
        return left.join(right.join(wanted, key, "left_semi"), key, how)
    # collected, at most `slices` rows: both sides must see one and the same answer, and
    # an approximate count evaluated twice could give two
    found = hot_keys(left, key, slices or _slices(left))
    hot_rows = found.collect()
    if not hot_rows:
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(hot_rows, found.schema))
    salted_left = left.join(hot, key, "left").withColumn(
        _SALT,
        F.when(
            F.col(_SALTS).isNotNull(),
            F.pmod(F.xxhash64(*spread_by), F.col(_SALTS)).cast("int"),
        ).otherwise(0),
    ).drop(_SALTS)
    salted_right = right.join(hot, key, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1))
    ).drop(_SALTS)
    return salted_left.join(salted_right, [key, _SALT], how).drop(_SALT)


def edges(df: DataFrame, owner: str, targets: Column | str, name: str) -> DataFrame:
    """One row per array element: (owner, target)."""
    return df.select(F.col(owner), F.explode(targets).alias(name))
