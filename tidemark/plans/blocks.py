"""Row frames over long streams without one task per stream.

A stream is cut into blocks of ``SIZE`` steps. A row also enters the following
block if it lies within ``before`` steps of it, and the preceding one if within
``after``; frames are then evaluated per (stream, block), and each block keeps
its own rows alone. Results equal those of whole streams as long as no frame
reaches beyond the halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SIZE = 65_536


class Blocked:
    """A frame builder over blocks with a halo."""

    def __init__(self, series: DataFrame, before: int, after: int = 0, size: int = SIZE, keys: tuple[str, ...] = ("stream_id",)):
        if max(before, after) > size:
            raise ValueError("the halo exceeds the block")
        self.keys = keys
        place = F.pmod(F.col("t"), F.lit(size))
        own = F.floor(F.col("t") / size).cast("long")
        into = F.array_compact(F.array(
            own,
            F.when(place >= size - before, own + 1) if before else F.lit(None).cast("long"),
            F.when(place < after, own - 1) if after else F.lit(None).cast("long"),
        ))
        self.rows = series.withColumn("_own", own).withColumn("_block", F.explode(into))

    def frame(self, low: int, high: int = 0) -> WindowSpec:
        """Rows low..high around the current one."""
        return Window.partitionBy(*self.keys, "_block").orderBy("t").rowsBetween(low, high)

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_block").orderBy("t")

    def lag(self, column: Column | str, k: int = 1) -> Column:
        return F.lag(column, k).over(self.ordered())

    def own(self, rows: DataFrame) -> DataFrame:
        """The rows that belong to their block."""
        return rows.where(F.col("_block") == F.col("_own")).drop("_block", "_own")
