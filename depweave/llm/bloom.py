"""Blocked Bloom filter of a column, built and asked with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.session import keep

# A block is four words of 64 bits; a value sets two bits in each.
LANES = 4
BITS_PER_VALUE = 16
# Blocks at most: 32 bytes each, so the filter that is broadcast never exceeds 8 MB. Beyond some
# four million values it lets more false hits pass, which costs time and never a row.
MAX_BLOCKS = 1 << 18


def _masks(value: Column) -> list[Column]:
    bits = F.xxhash64(value, F.lit("bits"))

    def bit(i: int) -> Column:
        at = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(LANES)]


def _block(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit("block")), F.lit(blocks)).cast("int")


def build(values: DataFrame, column: str, rows: int) -> tuple[DataFrame, int]:
    """The filter of ``column`` as a table of blocks, and the number of blocks.

    Each task folds its values into at most one row per block before the shuffle.
    """
    blocks = min(MAX_BLOCKS, max(1, -(-rows * BITS_PER_VALUE // (64 * LANES))))
    value = F.col(column)
    folded = values.where(value.isNotNull()).select(
        _block(value, blocks).alias("_block"), *[m.alias(f"_m{i}") for i, m in enumerate(_masks(value))]
    )
    table = folded.groupBy("_block").agg(*[F.bit_or(f"_m{i}").alias(f"_f{i}") for i in range(LANES)])
    return keep(table), blocks


def possible(df: DataFrame, column: Column, table: DataFrame, blocks: int, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: false only if the value is surely not in the filter."""
    masks = _masks(column)
    hit = F.col("_f0").isNotNull() & column.isNotNull()
    for i, mask in enumerate(masks):
        hit = hit & (F.col(f"_f{i}").bitwiseAND(mask) == mask)
    at = df.withColumn("_at", _block(column, blocks))
    joined = at.join(F.broadcast(table), F.col("_at") == F.col("_block"), "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop(
        "_at", "_block", *[f"_f{i}" for i in range(LANES)]
    )
