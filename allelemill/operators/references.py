"""References cut into overlapping tiles, so that alleles meet the part of a reference that they need and no more.

A tile of level k begins at a multiple of 2**k and is twice as long, so any window of 2**k symbols or fewer lies in the tile
in which it begins. No task holds a whole reference's alleles: (reference, level, tile) is the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns

#: The level of the smallest tiles (of 2**14 symbols, twice).
LEVEL = 14


def level_of(low: Column, high: Column, least: int = LEVEL) -> Column:
    """The level of the tiles that a window [low, high) needs."""
    return F.greatest(F.lit(least), F.ceil(F.log2(F.greatest(high - low, F.lit(1)))).cast("int"))


def tiles(references: DataFrame, levels: DataFrame) -> DataFrame:
    """ref_id, level, tile, begin, piece: the tiles of each level of `levels` (level; a few rows)."""
    n = F.length("sequence").cast("long")
    each = references.select("ref_id", "sequence").join(F.broadcast(levels))
    size = F.pow(F.lit(2), F.col("level")).cast("long")
    cut = each.withColumn("size", size).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(n - 1, F.lit(0)) / F.col("size")))))
    begin = F.col("tile") * F.col("size")
    return cut.select("ref_id", "level", "tile", begin.alias("begin"), columns.part(F.col("sequence"), begin, begin + 2 * F.col("size")).alias("piece"))


def with_text(rows: DataFrame, references: DataFrame, least: int = LEVEL, longest: int | None = None) -> DataFrame:
    """rows (ref_id, low, high and more) with window (the reference from low to high, cut at its end) and whole_length.

    Rows whose window begins beyond the reference's end get an empty window; rows of unknown references are left out. The levels in
    use are at most 31 numbers, and the only thing that is broadcast. Nothing runs until the result is asked for.

    Rows may bring their reference's whole_length, which saves a join. longest: what no window is longer than, where that is known;
    the levels follow from it then, and rows are made once, not twice. A longer window is an error.
    """
    level = level_of(F.col("low"), F.col("high"), least)
    placed, named = rows.withColumn("level", level), [c for c in rows.columns if c != "whole_length"]
    if "whole_length" not in rows.columns:
        placed = placed.join(references.select("ref_id", F.length("sequence").cast("long").alias("whole_length")), "ref_id")
    size = F.pow(F.lit(2), F.col("level"))
    # Beyond the end the last tile answers, with nothing.
    placed = placed.withColumn("tile", F.least(F.floor(F.col("low") / size), F.floor(F.greatest(F.col("whole_length") - 1, F.lit(0)) / size)))
    if longest is None:
        levels = rows.select(level.alias("level")).distinct()
    else:
        top = max(least, max(longest - 1, 0).bit_length())
        levels = rows.sparkSession.range(least, top + 1).select(F.col("id").cast("int").alias("level"))
        placed = placed.withColumn("level", F.when(F.col("level") <= top, F.col("level")).otherwise(F.raise_error(F.lit("a window is longer than it was said to be"))))
    joined = placed.join(tiles(references, levels), ["ref_id", "level", "tile"])
    window = columns.part(F.col("piece"), F.col("low") - F.col("begin"), F.col("high") - F.col("begin"))
    return joined.select(*(F.col(c) for c in named), window.alias("window"), "whole_length")
