"""Joins, order statistics and ranks that stay whole when one key holds much of the data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.session import cut, cut_counted, spread

# A key is hot when it holds more than both ``HOT_FLOOR`` rows and one ``HOT_SHARE``-th of its
# table. At most ``HOT_SHARE`` keys can do so, which bounds the list that is broadcast.
HOT_SHARE = 1000
HOT_FLOOR = 2_000_000
# Buckets of the first count; far more than hot keys can exist, and few enough that every task sums its rows up well.
HASH_BUCKETS = 1 << 16
# Rows of one key that a single task may hold.
SLICE_ROWS = 1_000_000


@dataclass
class HotKeys:
    """Hot keys of one table with the number of slices each is cut into."""

    key_type: T.DataType
    slices: list[tuple] = field(default_factory=list)

    def frame(self, spark: SparkSession, key: str, slices: str) -> DataFrame:
        schema = T.StructType(
            [T.StructField(key, self.key_type), T.StructField(slices, T.IntegerType())]
        )
        return F.broadcast(spark.createDataFrame(self.slices, schema))


def hot_keys(df: DataFrame, key: str, rows: int, floor: int = HOT_FLOOR) -> HotKeys:
    """Keys of ``df`` that need slicing; no job is run when ``rows`` rules them out.

    Rows are first counted by hash bucket, which every task does in bounded memory and almost
    without a shuffle. A hot key makes its bucket hot, so only the rows of hot buckets, usually
    none, are counted by key.
    """
    key_type = df.schema[key].dataType
    if rows <= floor:
        return HotKeys(key_type)
    limit = max(floor, rows // HOT_SHARE)
    bucket = F.pmod(F.xxhash64(key), F.lit(HASH_BUCKETS))
    full = df.groupBy(bucket.alias("b")).count().where(F.col("count") > limit).collect()
    if not full:
        return HotKeys(key_type)
    suspects = df.where(bucket.isin([r["b"] for r in full]))
    found = suspects.groupBy(key).count().where(F.col("count") > limit).collect()
    per_slice = min(SLICE_ROWS, limit)
    return HotKeys(key_type, [(r[key], -(-r["count"] // per_slice)) for r in found])


def _sliced(df: DataFrame, key: str, by: list[Column], own: HotKeys, other: HotKeys, names):
    """Give rows of own hot keys one slice, and copy rows to every slice of the other side."""
    spark = df.sparkSession
    own_name, other_name = names
    mine = F.lit(0)
    if own.slices:
        df = df.join(own.frame(spark, "_hk", "_n"), F.col(key).eqNullSafe(F.col("_hk")), "left")
        mine = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_n")), F.lit(0))
    df = df.withColumn(own_name, mine.cast("int")).drop("_hk", "_n")
    if other.slices:
        df = df.join(other.frame(spark, "_hk", "_n"), F.col(key).eqNullSafe(F.col("_hk")), "left")
        copies = F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)
        df = df.withColumn(other_name, F.explode(copies)).drop("_hk", "_n")
    else:
        df = df.withColumn(other_name, F.lit(0))
    return df


def hot_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_hot: HotKeys,
    right_hot: HotKeys,
    how: str = "inner",
) -> DataFrame:
    """Equi-join on ``key`` in which every hot key is spread over several tasks.

    The side on which a key is hot is cut into slices by the hash of its other columns and the
    opposite side is copied to each slice. Without hot keys this is a plain join.
    """
    if not left_hot.slices and not right_hot.slices:
        return left.join(right, key, how)
    if how != "inner" and right_hot.slices:
        raise ValueError("only the left side may be hot unless the join is inner")
    left_by = [F.col(c) for c in left.columns]
    right_by = [F.col(c) for c in right.columns]
    a = _sliced(left, key, left_by, left_hot, right_hot, ("_sl", "_sr"))
    b = _sliced(right, key, right_by, right_hot, left_hot, ("_sr", "_sl"))
    return a.join(b, [key, "_sl", "_sr"], how).drop("_sl", "_sr")


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    rows: int | None = None,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Join a large table to one with unique keys; keys that are hot on the left are spread.

    ``rows`` is the size of the left side, counted here when it is not given.
    """
    rows = left.count() if rows is None else rows
    return hot_join(left, spread(right), key, hot_keys(left, key, rows, floor), HotKeys(left.schema[key].dataType), how)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> tuple[DataFrame, int]:
    """Zero-based position of each row in a total order, without a one-partition window.

    Rows are range-partitioned and sorted; the position is the row's number in its partition
    plus the sizes of the partitions before it. Only one count per partition reaches the driver.
    """
    local = F.monotonically_increasing_id()
    ranged, rows = cut_counted(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", local)
    )
    pid = F.shiftright(F.col("_m"), 33)
    sizes = sorted(tuple(r) for r in ranged.groupBy(pid.alias("p")).count().collect())
    offsets, seen = [], 0
    for part, size in sizes:
        offsets.append((part, seen))
        seen += size
    schema = "_p long, _o long"
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))
    position = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_o")
    out = ranged.withColumn("_p", pid).join(table, "_p").withColumn(name, position)
    return out.drop("_m", "_p", "_o"), rows


def kth_smallest(df: DataFrame, column: str, k: int, buckets: int = 4096) -> int | None:
    """Exact ``k``-th smallest (from zero) whole number, by narrowing equal-width ranges.

    Each pass is one filtered aggregate whose result has at most ``buckets`` rows.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return None
    skip = k
    while low < high:
        width = max(1, -(-(high - low + 1) // buckets))
        bucket = F.floor((F.col(column) - F.lit(low)) / F.lit(width)).alias("b")
        inside = df.where(F.col(column).between(low, high))
        counts = inside.groupBy(bucket).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")
        )
        for row in sorted(counts.collect(), key=lambda r: r["b"]):
            if skip < row["n"]:
                low, high = row["lo"], row["hi"]
                break
            skip -= row["n"]
        else:
            return None
    return low


def lead_by_group(
    df: DataFrame, group: str, order: list[str], value: str, name: str, rows: int, floor: int = HOT_FLOOR
) -> DataFrame:
    """``lead(value)`` over ``group`` ordered by ``order``, also where one group is very large.

    Ordinary groups use a window. Hot groups are range-partitioned by the whole sort key, so a
    group spans many tasks; the window then runs inside each range, and the last row of a range
    takes the first row of the next range of its group.
    """
    from pyspark.sql import Window

    over = Window.partitionBy(group).orderBy(*order)
    hot = hot_keys(df, group, rows, floor)
    if not hot.slices:
        return df.withColumn(name, F.lead(value).over(over))
    keys = hot.frame(df.sparkSession, group, "_n")
    usual = df.join(keys.drop("_n"), group, "left_anti")
    usual = usual.withColumn(name, F.lead(value).over(over))

    ranged = df.join(keys.drop("_n"), group).repartitionByRange(
        sum(n for _, n in hot.slices), group, *order
    )
    ranged = cut(ranged.withColumn("_r", F.spark_partition_id()))
    inner = Window.partitionBy(group, "_r").orderBy(*order)
    piece = ranged.withColumn("_next", F.lead(value).over(inner)).withColumn(
        "_last", F.lead(F.lit(1)).over(inner).isNull()
    )
    firsts = ranged.groupBy(group, "_r").agg(
        F.min_by(F.struct(value), F.struct(*order)).alias("_first")
    )
    between = Window.partitionBy(group).orderBy("_r")
    follow = firsts.select(group, "_r", F.lead("_first").over(between)[value].alias("_after"))
    joined = piece.join(follow, [group, "_r"], "left")
    joined = joined.withColumn(
        name, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next"))
    )
    return usual.unionByName(joined.drop("_r", "_next", "_last", "_after"))
