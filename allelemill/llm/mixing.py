"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time: the words of its source up to and including it, divided by the
source's target. The mix is the documents in the order of these times (a global range sort), truncated where the
total budget is reached. A source whose target exceeds its size goes round again: the second copy of a document
queues one source size after the first.

The queue is one narrow table of all copies, sorted globally by ranges of finish time; running totals (the words of all
copies ahead) are taken within each range and added up over the ranges. The targets add up to the budget. At the cut each
source has one document in service, which is taken in part (its first words); what these parts need is set aside, and every
copy whose running total stays within the rest of the budget is taken whole. So each source meets its target to a word.

Defined results: size counts the words of the text, 0 for null; a document without words takes nothing. Sources are
ordered by code point with null last, and null is a source of its own. Documents are shuffled by the md5 of seed,
doc_id and size; rows that agree in doc_id, source and size are interchangeable. An empty table gives an empty result,
and so do tables without any words (target 0). Extra columns are ignored by `taken` and kept by `mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, ordered_totals, stored

WEIGHTS = (5, 2, 1)
BUDGET, ROUNDS, SEED = 1.5, 2, "mix"
#: Copies in a range of the global order, about.
PER_RANGE = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """One row for each source of `sized` (source, size): source, source_size, target.

    The budget is shared by weight; a target stops at `rounds` times its source's size and the rest is shared again.
    With the sources in the order of cap over weight this is one scan: the share of one unit of weight, once all
    sources before have stopped at their caps, is largest where the filling ends. There is one row for each source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    ratio = totals.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(rounds)))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = ratio.withColumn("_unit", (F.sum("source_size").over(whole) * F.lit(budget) - full) / left)
    share = share.withColumn("_level", F.max("_unit").over(whole))
    return share.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def queue(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """sized (doc_id, source, size and more) with source_size, target, start (the words queued before it in its source), _key."""
    shuffle = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    placed = ordered_totals(sized.withColumn("_key", shuffle), ["source"], ["_key"], "size", "start")
    goal = targets(sized, weights, budget, rounds).withColumnRenamed("source", "_source")
    return placed.join(goal, placed["source"].eqNullSafe(goal["_source"])).drop("_source")


def served(round_no: int) -> Column:
    """Words that the document's copy of a round (from 0) is due by the cut."""
    begin = F.col("start") + round_no * F.col("source_size")
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.col("target")).cast("long") - begin))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"))


def line(queued: DataFrame, rounds: int = ROUNDS, per_range: int = PER_RANGE) -> DataFrame:
    """All copies of `queued` in the order of their finish times, stored in ranges: with round, finish and ahead (the words of
    all copies before). Of sources without a target (no words at all) finish is null, which comes last."""
    copies = queued.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("finish", F.when(F.col("target") > 0, (F.col("start") + F.col("round") * F.col("source_size") + F.col("size")) / F.col("target")))
    order = [F.col("finish").asc_nulls_last(), F.col("source").asc_nulls_last(), F.col("_key"), F.col("round")]
    copies = stored(copies, "copies")
    ranges = max(1, math.ceil(copies.count() / per_range))
    ranged = stored(copies.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "line")
    sums = ranged.groupBy("_range").agg(F.sum("size").alias("_sum"))  # one row a range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sums.select(F.col("_range").alias("_own"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")))
    within = F.sum("size").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_within", F.coalesce(within, F.lit(0))).join(starts, F.col("_range") == F.col("_own")).withColumn("ahead", F.col("_within") + F.col("_before")).drop("_own", "_within", "_before")


def cut(copies: DataFrame) -> int:
    """How many words of the budget go to whole documents: all but what the documents in service at the cut are due."""
    whole = F.col("start") + F.col("round") * F.col("source_size") + F.col("size") <= F.floor("target")
    each = copies.groupBy("source").agg(F.floor(F.first("target")).cast("long").alias("goal"), F.coalesce(F.sum(F.when(whole, F.col("size"))), F.lit(0)).alias("whole"))
    found = each.agg(F.sum("goal").alias("budget"), F.sum(F.col("goal") - F.col("whole")).alias("due")).first()
    return (found["budget"] or 0) - (found["due"] or 0)


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, rounds: int = ROUNDS, seed: str = SEED, per_range: int = PER_RANGE) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, and of its first copy finish and ahead."""
    copies = stored(line(queue(stored(sized(docs), "sizes"), weights, budget, rounds, seed), rounds, per_range), "ahead")
    begin = F.col("start") + F.col("round") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("long") - begin))
    own = F.when(F.col("ahead") + F.col("size") <= cut(copies), F.col("size")).otherwise(part)
    rows = copies.withColumn("own", own).groupBy("doc_id", "source", "size", "source_size", "target", "start").agg(F.sum("own").cast("long").alias("taken"), F.min("finish").alias("finish"), F.min("ahead").alias("ahead"), F.count("*").alias("n"))
    # Documents without words may agree in all of this.
    return rows.withColumn("_row", F.explode(F.sequence(F.lit(1), (F.col("n") / rounds).cast("int")))).drop("_row", "n", "start")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs in the order of virtual finish times, each as often as it is taken, whole.

    Of the document at the cut the larger half decides. A document without words has nothing to take and goes.
    """
    column = {c: F.col(f"`{c}`") for c in docs.columns}
    rows = docs.select(column["doc_id"].alias("doc_id"), column["source"].alias("source"), words(column["text"]).alias("size"), F.struct(*(column[c].alias(f"x{i}") for i, c in enumerate(docs.columns))).alias("row"))
    narrow = stored(rows.select("doc_id", "source", "size"), "sizes")
    queued = queue(narrow, weights, budget, rounds, seed).withColumn("no", F.lit(1))
    rows = rows.withColumn("no", F.lit(1))
    if not narrow.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # Rows that agree in all three are numbered on both sides, so that each finds one place in the queue.
        same = Window.partitionBy("doc_id", "source", "size")
        queued = queued.withColumn("no", F.row_number().over(same.orderBy("start")))
        rows = rows.withColumn("no", F.row_number().over(same.orderBy(F.xxhash64("row.x%d" % docs.columns.index("text")))))
    turns = F.array(*(F.struct(F.lit(r).alias("round"), served(r).alias("n")) for r in range(rounds)))
    turn = F.explode(F.filter(turns, lambda x: (x["n"] > 0) & (2 * x["n"] >= F.col("size"))))
    chosen = queued.withColumn("turn", turn)
    finish = (F.col("start") + F.col("size") + F.col("turn.round") * F.col("source_size")) / F.col("target")
    place = chosen.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size", "no")), finish.alias("_finish"))
    joined = rows.join(place, rows["doc_id"].eqNullSafe(F.col("_doc_id")) & rows["source"].eqNullSafe(F.col("_source")) & (rows["size"] == F.col("_size")) & (rows["no"] == F.col("_no")))
    ordered = joined.repartitionByRange("_finish").sortWithinPartitions("_finish")
    return ordered.select(*(F.col(f"row.x{i}").alias(c) for i, c in enumerate(docs.columns)))
