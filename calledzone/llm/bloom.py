"""Bloom filters as tables of bitmap blocks, in built-in functions only.

A filter is a table (block, bits): 32,768 bits a block, made by `bitmap_construct_agg` and so
combined before the shuffle. It is broadcast to be probed; its size is bounded by `max_bits`
(2^28 bits, 32 MB), whatever the size of the input. A filter too small for its input
only passes more rows on to the exact step behind it: results do not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

BLOCK_BITS = 32768
MAX_BITS = 1 << 28


def size_for(rows: int, per_row: int = 16, max_bits: int = MAX_BITS) -> int:
    """Power of two of bits for `rows` hashes, within bounds."""
    bits = BLOCK_BITS
    while bits < min(rows * per_row, max_bits):
        bits *= 2
    return min(bits, max_bits)


def slot_columns(hash64: Column, bits: int, hashes: int) -> list[Column]:
    """Slots of a hash: each hash function has `bits` / `hashes` slots of its own."""
    own = bits // hashes
    parts = [hash64, F.shiftrightunsigned(hash64, 31)]
    return [parts[i].bitwiseAND(F.lit(own - 1)) + F.lit(i * own) for i in range(hashes)]


def _blocks(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.shiftright("slot", 15).alias("block")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(BLOCK_BITS - 1))).alias("bits"))


def _slots(hashes: DataFrame, bits: int, number: int) -> DataFrame:
    columns = slot_columns(F.col("h"), bits, number)
    if number == 1:
        return hashes.select(columns[0].alias("slot"))
    return hashes.select(F.explode(F.array(*columns)).alias("slot"))


def members(hashes: DataFrame, bits: int, number: int = 2) -> DataFrame:
    """Filter of all values of column `h`."""
    return keep(_blocks(_slots(hashes, bits, number)), "bloom")


def repeated(hashes: DataFrame, bits: int, number: int = 2) -> DataFrame:
    """Filter of the slots that two rows or more of column `h` fall into."""
    counted = _slots(hashes, bits, number).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    return keep(_blocks(counted.filter("n > 1")), "bloom")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that begin with `names` and that `df` does not have, letter case aside."""
    taken = {column.lower() for column in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def probe(df: DataFrame, hash64: Column, blocks: DataFrame, bits: int, number: int = 2,
          flag: str = "__maybe") -> DataFrame:
    """`df` with `flag`: false only if the hash is surely not in the filter. `df` is not shuffled.

    Work columns take names that `df` does not have; `flag` is the caller's to choose.
    """
    hashed, *work = unused(df, "__hash", *[f"__{name}{i}" for i in range(number) for name in ("slot", "block", "bits")])
    out = df.withColumn(hashed, hash64)
    found = []
    for i, slot in enumerate(slot_columns(F.col(hashed), bits, number)):
        own, block, words = work[3 * i:3 * i + 3]
        side = F.broadcast(blocks.select(F.col("block").alias(block), F.col("bits").alias(words)))
        out = out.withColumn(own, slot)
        out = out.join(side, F.shiftright(own, 15) == F.col(block), "left")
        byte = f"cast(conv(hex(substring({words}, cast(({own} & {BLOCK_BITS - 1}) div 8 + 1 as int), 1)), 16, 10) as int)"
        found.append(F.coalesce(F.expr(f"shiftright({byte}, cast({own} % 8 as int)) & 1 = 1"), F.lit(False)))
    every = found[0]
    for other in found[1:]:
        every = every & other
    out = out.withColumn(flag, every)
    return out.drop(hashed, *work)


def without(df: DataFrame, id_col: str, ids: DataFrame, rows: int) -> DataFrame:
    """`df` less the rows whose id is in the one-column table `ids`; most rows are not shuffled.

    Rows the filter does not know pass straight through; only possible members meet `ids` in a join.
    Rows with a null id stay.
    """
    return _split(df, id_col, ids, rows, "left_anti")


def within(df: DataFrame, id_col: str, ids: DataFrame, rows: int) -> DataFrame:
    """Rows of `df` whose id is in the one-column table `ids`; only possible members are shuffled."""
    return _split(df, id_col, ids, rows, "left_semi")


def _split(df: DataFrame, id_col: str, ids: DataFrame, rows: int, how: str) -> DataFrame:
    bits = size_for(rows)
    wanted_id, flag = unused(df, "__id", "__maybe")
    wanted = ids.toDF(wanted_id)
    blocks = members(wanted.select(F.xxhash64(wanted_id).alias("h")), bits)
    own = F.col(f"`{id_col}`").cast("long")
    flagged = probe(df, F.xxhash64(own), blocks, bits, flag=flag)
    met = flagged.filter(F.col(flag)).drop(flag).join(wanted, own == F.col(wanted_id), how)
    if how == "left_semi":
        return met
    return flagged.filter(~F.col(flag)).drop(flag).unionByName(met)
