"""One summary for each distinct allele: distance, spanning edit, normal forms, their HGVS and unit edits.

Alleles meet tiles of their references and are patched natively; only a window around the edits goes to the kernel, which
remembers what it told of windows that are equal but for their symbols' names. Alleles whose spanning edit reaches the
window's border (repeats) are done again with windows WIDEN times as wide, round by round, on their references alone; there
are few of them, and fewer in each round. Of a window no more is kept than the spanning edit and a symbol on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, columns
from ..store import stored
from .references import with_text

PAD, WIDEN = 16, 16


def with_windows(alleles: DataFrame, references: DataFrame, pad: int = PAD, longest: int | None = None) -> DataFrame:
    """alleles (allele_id, ref_id, variants, and whole_length if they have it) with whole_length, shift and window; longest: how many
    symbols of the reference an allele spans at most, where that is known."""
    low = F.greatest(F.lit(0), F.array_min(F.transform("variants", lambda v: v["start"])) - pad)
    high = F.array_max(F.transform("variants", lambda v: v["end"])) + pad
    own = [c for c in alleles.columns if c == "whole_length"]
    placed = alleles.select("allele_id", "ref_id", "variants", *own, F.coalesce(low, F.lit(0)).alias("low"), F.coalesce(high, F.lit(0)).alias("high"))
    return with_text(placed, references, longest=None if longest is None else longest + 2 * pad).withColumnRenamed("low", "shift").drop("high")


def observed_window() -> Column:
    """What the variants make of the window; null if they have no order."""
    moved = F.transform("variants", lambda v: columns.variant(v["start"] - F.col("shift"), v["end"] - F.col("shift"), v["sequence"]))
    return columns.patch("window", moved)


FIELDS = ("distance", "supremal", "canonical", "local_supremal", "hgvs", "atoms")


#: What the spanning edit alone tells.
SPAN = ("distance", "supremal")


def spanning(alleles: DataFrame, references: DataFrame, pad: int = PAD, tasks: int | None = None, longest: int | None = None, windows: bool = True) -> DataFrame:
    """summaries() with distance and supremal alone, for less than half the kernel's work."""
    return summaries(alleles, references, pad, SPAN, tasks, longest, windows)


def summaries(alleles: DataFrame, references: DataFrame, pad: int = PAD, fields: tuple[str, ...] = FIELDS, tasks: int | None = None, longest: int | None = None, windows: bool = True) -> DataFrame:
    """allele_id, ref_id, variants, the summary's fields, and shift and window (a part of the reference, from `shift` on, that
    holds the spanning edit and a symbol on either side, where there is one). alleles: allele_id, ref_id, variants;
    references: ref_id, sequence. tasks: how many share the alleles (by default spark.sql.shuffle.partitions). Alleles that bring
    their reference's whole_length, and a `longest` that none spans more of, are placed without a second pass over them. Alleles that
    bring whole_length, shift and window (`pad` symbols beside their edits) are told of as they are dealt, without a join or a shuffle.
    Without `windows`, variants, shift and window are not kept, and the result has allele_id, ref_id, the fields and error.
    The result's stored_tables are its files: a query that has stored what it made of it may give them to `dropped`.

    Defined results: an allele without variants, or of net identity, has distance 0, spanning edit 0:0/ and empty lists;
    overlapping variants, and ends beyond the reference, give an error and null fields; alleles of unknown references are left out.
    """
    beyond = F.exists("variants", lambda v: v["end"] > F.col("whole_length"))
    problem = F.coalesce(columns.allele_error("variants"), F.when(beyond, "ValueError: the range ends beyond the reference"))
    shift, v = F.col("shift"), F.col("s.supremal")
    # Of an allele that changes something, the spanning edit and a symbol on either side, where the window has one.
    begin = F.when(F.col("s.distance") > 0, F.greatest(shift, v["start"] - 1)).otherwise(shift)
    kept = F.when(F.col("s.distance") > 0, columns.part(F.col("window"), begin - shift, v["end"] + 1 - shift)).otherwise(F.col("window"))
    told = arrow.window_summary(tuple(f for f in FIELDS if f in {*fields, *SPAN}))
    parts, files, left, some, narrow = [], [], alleles, references, F.col("s.error").eqNullSafe("narrow")
    more = (begin.alias("shift"), kept.alias("window")) if windows else ()
    while True:
        near = left
        if "window" not in left.columns:
            # The kernel's work is by alleles, not by bytes: few bytes would be left to few tasks, a hot tile to one.
            near = with_windows(left, some, pad, longest).repartition(tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "allele_id")
        near = near.withColumn("problem", problem)
        done = near.withColumn("s", told("window", F.when(F.col("problem").isNull(), observed_window()), "shift", "whole_length"))
        again = F.col("variants") if windows else F.when(narrow, F.col("variants")).alias("variants")
        done = stored(done.select("allele_id", "ref_id", again, "whole_length", "problem", "s", *more), "summaries")
        parts.append(done.where(~narrow))
        left = stored(done.where(narrow).select("allele_id", "ref_id", "variants", "whole_length"), "narrow")
        files += [done, left]
        if left.isEmpty():
            break
        some = references.join(left.select("ref_id").distinct(), "ref_id", "left_semi")
        pad = max(pad, 1) * WIDEN
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    told_of = (*(F.col(f"s.{f}").alias(f) for f in fields), F.coalesce(F.col("problem"), F.col("s.error")).alias("error"))
    out = whole.select("allele_id", "ref_id", *(("variants", *told_of, "shift", "window") if windows else told_of))
    out.stored_tables = files
    return out


def equivalence_classes(summarised: DataFrame) -> DataFrame:
    """ref_id, supremal, allele_id (the smallest), members: alleles with equal spanning edits are equivalent."""
    return summarised.where("error is null").groupBy("ref_id", "supremal").agg(F.min("allele_id").alias("allele_id"), F.count("*").alias("members"))
