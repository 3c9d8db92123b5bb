"""A blocked Bloom filter as a table of blocks: built by an aggregate, asked by a broadcast join, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a value's block, held as one long, and how many of them a value sets.
BITS, SET = 64, 5
#: Bits for each value, and the most blocks: the filter that is broadcast has 12 bytes a block, 6 MB at most.
PER_VALUE, MOST_BLOCKS = 14, 1 << 19


def _mask(value: Column) -> Column:
    """The bits that a value sets in its block."""
    h, out = F.xxhash64(value, F.lit(1)), None
    for i in range(SET):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(BITS - 1)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def _block(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(blocks)).cast("int")


def block_count(values: DataFrame) -> int:
    return max(1, min(MOST_BLOCKS, -(-values.count() * PER_VALUE // BITS)))


def bloom_blocks(values: DataFrame, column: str, blocks: int) -> DataFrame:
    """(__block, __bits): the blocks that have bits, at most as many rows as blocks."""
    rows = values.select(_block(F.col(column), blocks).alias("__block"), _mask(F.col(column)).alias("__bits"))
    return rows.groupBy("__block").agg(F.bit_or("__bits").alias("__bits"))


def marked(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """df with __hit: false only where the column's value isn't in values' column of that name, or is null.

    The filter's size follows values up to a bound, so it can always be broadcast;
    beyond the bound it only lets more through.
    """
    blocks = block_count(values)
    bits = F.broadcast(bloom_blocks(values, column, blocks))
    out = df.join(bits, _block(F.col(column), blocks) == F.col("__block"), "left")
    hit = F.col("__bits").bitwiseAND(_mask(F.col(column))) == _mask(F.col(column))
    return out.withColumn("__hit", F.coalesce(hit & F.col(column).isNotNull(), F.lit(False))).drop("__block", "__bits")
