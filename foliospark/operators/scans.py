"""Prefix folds over groups that no task need hold whole.

Positions are cut into blocks of 2^shift, blocks into blocks of blocks, and so on. A fold over what precedes a row is a window within its
block and the same fold over the blocks' totals one level up. So the largest group that is sorted together has 2^shift positions,
however long the group is. Nothing is broadcast on purpose, and nothing passes through the driver but the table's bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block has 2^SHIFT positions, and each further level's block as many blocks.
SHIFT = 10

_FOLDS = {"sum": (F.sum, lambda up, own: F.coalesce(up, F.lit(0)) + F.coalesce(own, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def levels_of(df: DataFrame, *positions: str, shift: int = SHIFT) -> int:
    """How many levels of blocks cover all of the columns' values and the number of rows: from one row of bounds."""
    bounds = df.agg(F.count("*"), *[f(c) for c in positions for f in (F.min, F.max)]).first()
    return max(1, -(-max(abs(b or 0) for b in bounds).bit_length() // shift))


def block_of(pos: str, shift: int, top: bool) -> Column:
    """The block of a position; the top level is one block, also of negative positions."""
    return F.lit(0).cast("bigint") if top else F.shiftright(F.col(pos).cast("bigint"), shift)


def preceded(df: DataFrame, group: list[str], pos: str, measures: dict[str, tuple[str, Column]], levels: int, shift: int = SHIFT, ties: tuple[str, ...] = (), backwards: bool = False) -> DataFrame:
    """df with, for each measure name -> (sum, min or max, column), that fold over the group's earlier rows (backwards: later ones).

    Where there are none a sum is 0 and a min or max null. Group columns and pos are without nulls; min and max also take structs.
    """
    order = [F.col(c).desc() if backwards else F.col(c) for c in (pos, *ties)]
    w = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = df.withColumn("_b", block_of(pos, shift, levels == 1))
    some = lambda kind, c: F.coalesce(c, F.lit(0)) if kind == "sum" else c
    own = at.select("*", *[some(kind, _FOLDS[kind][0](c).over(w)).alias(name) for name, (kind, c) in measures.items()])
    if levels > 1:
        totals = at.groupBy(*group, "_b").agg(*[_FOLDS[kind][0](c).alias(f"_t{name}") for name, (kind, c) in measures.items()])
        above = preceded(totals.withColumnRenamed("_b", "_p"), group, "_p", {f"_u{name}": (kind, F.col(f"_t{name}")) for name, (kind, _) in measures.items()}, levels - 1, shift, backwards=backwards)
        above = above.select(*group, F.col("_p").alias("_b"), *[f"_u{name}" for name in measures]).hint("merge")
        own = own.join(above, [*group, "_b"])
        own = own.withColumns({name: _FOLDS[kind][1](F.col(f"_u{name}"), F.col(name)) for name, (kind, _) in measures.items()}).drop(*[f"_u{name}" for name in measures])
    return own.drop("_b")
