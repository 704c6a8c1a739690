"""A membership filter of a fixed size, so that few keys prune a large table before it is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: its size doesn't depend on the number of keys.
BITS = 1 << 20


class Members:
    """A filter over columns of keys, as one row that goes to all tasks. It passes all keys and few others, so a join has to follow."""

    def __init__(self, keys: DataFrame, *cols: str, bits: int = BITS):
        self.bits = bits
        slot = keys.select(self.slot(*map(F.col, cols)).alias("slot")).filter("slot is not null")
        rows = slot.groupBy(F.floor(F.col("slot") / 64).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
        words = [0] * (bits // 64)
        for r in rows.collect():  # bits / 64 rows at most
            words[r["at"]] = r["bits"]
        self.row = F.broadcast(keys.sparkSession.createDataFrame([(words,)], "_bits array<bigint>"))

    def slot(self, *cols: Column) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(self.bits))

    def hit(self, *cols: Column) -> Column:
        """Whether columns may be a key, in rows that have been joined with row."""
        return self.marked(self.slot(*cols))

    def marked(self, slot: Column) -> Column:
        """hit, for the slot of some columns."""
        return F.getbit(F.get("_bits", F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1

    def passing(self, rows: DataFrame, *cols: str) -> DataFrame:
        """The rows that may be a key's."""
        return rows.join(self.row).filter(self.hit(*map(F.col, cols))).drop("_bits")
