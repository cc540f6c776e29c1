"""Joins of intervals that meet: rows of (id, ref_id, start, end, more) with one ref_id whose closed intervals touch, as structs l and r.

`paired` is what relations use. Rows bring what their pairs are told by (texts, unit edits), so that no pair is shuffled to fetch it. A
short row enters the few narrow bins that it covers, whole. Long rows are few, and their texts are as long as they: whole they enter
two bins of a level at most, to meet one another; shorts meet their names alone, and their texts are fetched for these pairs, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols of a bin, not many more than most edits span: all of a bin's edits are tried with one another, so that wide bins cost as
#: many tries as their edits squared.
BIN = 16
#: The least level: bins of 2**9 symbols.
LEVEL = 9
#: Symbols that an edit deletes or inserts at most to enter bins whole.
SHORT = 32


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _meet(ordered: bool, containing: bool) -> Column:
    met = (F.col("l.start") <= F.col("r.end")) & (F.col("r.start") <= F.col("l.end"))
    if containing:
        met &= (F.col("l.start") <= F.col("r.start")) & (F.col("r.end") <= F.col("l.end"))
    return met & (F.col("l.id") < F.col("r.id")) if ordered else met


def _unpruned(*sides: str) -> Column:
    """True of all pairs, and read off these sides' whole rows: else the optimiser leaves fields out of each use of a table in a way
    of its own, and it is shuffled for each."""
    one, other = (F.struct(F.col(f"{side}.id").alias("id"), *sides) for side in "lr")
    return ~one.eqNullSafe(other) | F.col("l.id").eqNullSafe(F.col("r.id"))


def touching(lhs: DataFrame, rhs: DataFrame, bin_width: int = BIN, ordered: bool = True, containing: bool = False, whole: str = "") -> DataFrame:
    """Pairs of rows that enter all bins that they cover; whole: the sides ("l", "r", "lr") that other joins read too, as they are.

    ordered keeps pairs with l.id < r.id (a self join's unordered pairs); containing keeps those in which l spans r. Hot bins are left
    to AQE's skew handling: both sides are split by rows there, no side is aggregated. A table joined with itself is shuffled once.
    """

    def entered(df: DataFrame, name: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width))
        return df.select(F.struct(*df.columns).alias(name), F.col("ref_id").alias(f"{name}_ref"), F.explode(bins).alias(f"{name}_bin"))

    a, b = entered(lhs, "l"), entered(rhs, "r")
    once = F.col("l_bin") == F.greatest(F.floor(F.col("l.start") / bin_width), F.floor(F.col("r.start") / bin_width))
    same = (F.col("l_ref") == F.col("r_ref")) & (F.col("l_bin") == F.col("r_bin")) & once & _meet(ordered, containing)
    return a.join(b, same & _unpruned(*whole) if whole else same).select("l", "r")


def level_of(start: Column, end: Column, least: int = LEVEL) -> Column:
    """The level whose bins are at least as wide as the edit."""
    return F.greatest(F.lit(least), F.ceil(F.log2(F.greatest(end - start, F.lit(1)))).cast("int"))


def meeting(lhs: DataFrame, rhs: DataFrame, ordered: bool = True, least: int = LEVEL, containing: bool = False) -> DataFrame:
    """The same pairs by levels: a row enters two bins at most of each level that is in use, however long it is.

    There are as many levels as bits of the longest edit, at most 31; they are the only thing broadcast. The work of long edits'
    pairs is by their lengths squared, not by their few bytes, so that no tasks are made one.
    """
    level = level_of(F.col("start"), F.col("end"), least)
    levels = lhs.select(level.alias("on")).unionByName(rhs.select(level.alias("on"))).distinct()

    def entered(df: DataFrame, name: str) -> DataFrame:
        own = df.select(F.struct(*df.columns).alias(name), level.alias(f"{name}_level")).join(F.broadcast(levels), F.col("on") >= F.col(f"{name}_level"))
        bins = F.sequence(F.expr(f"shiftright({name}.start, on)"), F.expr(f"shiftright({name}.end, on)"))
        return own.select(name, f"{name}_level", F.col(f"{name}.ref_id").alias(f"{name}_ref"), F.col("on").alias(f"{name}_on"), F.explode(bins).alias(f"{name}_bin")).repartition(_tasks(df), f"{name}_ref", f"{name}_on", f"{name}_bin")

    a, b = entered(lhs, "l"), entered(rhs, "r")
    once = (F.col("l_on") == F.greatest("l_level", "r_level")) & (F.col("l_bin") == F.expr("shiftright(greatest(l.start, r.start), l_on)"))
    same = (F.col("l_ref") == F.col("r_ref")) & (F.col("l_on") == F.col("r_on")) & (F.col("l_bin") == F.col("r_bin"))
    return a.join(b, same & once & _meet(ordered, containing)).select("l", "r")


def paired(lhs: DataFrame, rhs: DataFrame, ordered: bool = True, least: int = LEVEL, containing: bool = False, bin_width: int = 2 * BIN, short: int = SHORT) -> DataFrame:
    """The same pairs of rows that have a sequence and may have more that grows with the edit. An ordered join is of a table with itself."""
    is_short = (F.col("end") - F.col("start") <= short) & (F.coalesce(F.length("sequence"), F.lit(0)) <= short)
    # Nulls have no order, and a join of other conditions shares a shuffle only if it leaves out the same rows.
    few = lambda df: df.where(is_short & F.col("id").isNotNull() if ordered else is_short)
    long = lambda df: df.where(~is_short)
    names = ("id", "ref_id", "start", "end")

    def whole(found: DataFrame, side: str, rows: DataFrame) -> DataFrame:
        key = F.struct(F.col(f"{side}.id").alias("id"), F.col(f"{side}.ref_id").alias("ref_id")).alias("key")
        other, texts = "r" if side == "l" else "l", rows.select(F.struct("id", "ref_id").alias("key"), F.struct(*rows.columns).alias(side))
        return found.select(other, key).repartition(_tasks(rows), "key").join(texts.repartition(_tasks(rows), "key"), "key").select("l", "r")

    parts = [touching(few(lhs), few(rhs), bin_width, ordered, containing, "lr"), meeting(long(lhs), long(rhs), ordered, least, containing)]
    mixed = whole(touching(long(lhs).select(*names), few(rhs), bin_width, False, containing, "r"), "l", long(lhs))
    if ordered:
        first = F.col("l.id") < F.col("r.id")
        parts.append(mixed.select(F.when(first, F.col("l")).otherwise(F.col("r")).alias("l"), F.when(first, F.col("r")).otherwise(F.col("l")).alias("r")))
    else:
        parts += [mixed, whole(touching(few(lhs), long(rhs).select(*names), bin_width, False, containing, "l"), "r", long(rhs))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
