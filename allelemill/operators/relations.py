"""Relations of pairs of alleles through a binned range join.

Pairs whose spanning edits lie apart are disjoint; so only pairs whose edits touch are joined: each allele enters the bins
that its edit covers, bins are joined by equality, and a pair is taken in the bin of its later start only (`intervals`). Equality
of the edits decides equivalence natively; distances over the union of both windows are computed for the rest, and shared unit
edits decide what distances leave open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, columns
from ..schema import CONTAINS, DISJOINT, EQUIVALENT, IS_CONTAINED, OVERLAP
from .intervals import BIN, paired, touching  # noqa: F401

#: Fields of a summary that relations are told by.
NEEDS = ("distance", "supremal", "atoms")


def facts(summarised: DataFrame, side: str, *more: Column) -> DataFrame:
    return summarised.where("error is null").select(F.struct("allele_id", "ref_id").alias(f"{side}_key"), columns.atom_numbers("atoms").alias(f"{side}_atoms"), F.col("shift").alias(f"{side}_shift"), F.col("window").alias(f"{side}_window"), *more)


def rows(summarised: DataFrame, *more: str) -> DataFrame:
    """id, ref_id, start, end, distance, sequence, atoms, shift, window (and more): all that pairs are told by."""
    found = facts(summarised, "own", "distance", "supremal", *more)
    own = (F.col(f"own_{c}").alias(c) for c in ("atoms", "shift", "window"))
    edit = (F.col(f"supremal.{c}").alias(c) for c in ("start", "end"))
    return found.select(F.col("own_key.allele_id").alias("id"), F.col("own_key.ref_id").alias("ref_id"), *edit, "distance", F.col("supremal.sequence").alias("sequence"), *own, *more)


def window_of(low: Column, high: Column) -> Column:
    """The reference from low to high out of the windows of l and r, which meet or overlap; of each what the other lacks."""
    l_shift, r_shift = F.col("l.shift"), F.col("r.shift")
    first = l_shift <= r_shift
    one, other = F.when(first, F.col("l.window")).otherwise(F.col("r.window")), F.when(first, F.col("r.window")).otherwise(F.col("l.window"))
    begin, next_begin = F.least(l_shift, r_shift), F.greatest(l_shift, r_shift)
    joined = F.concat(one, columns.rest(other, F.greatest(begin + F.length(one) - next_begin, F.lit(0))))
    return columns.part(joined, low - begin, high - begin)


def _ladder(equal: Column, apart: Column, left: Column, right: Column, between: Column, shared: Column) -> Column:
    """The order of the tests matters: nothing equals nothing, and is disjoint from all else."""
    return (
        F.when(equal, EQUIVALENT).when(apart, DISJOINT).when(left + right == between, DISJOINT).when(left - right == between, CONTAINS)
        .when(right - left == between, IS_CONTAINED).when(shared, OVERLAP).otherwise(DISJOINT)
    )


def told(pairs: DataFrame, *more: Column) -> DataFrame:
    """ref_id, lhs_id, rhs_id, relation, common, universe (and more) of pairs (structs l and r of `rows`). Pairs that equality and
    disjointness tell go to the kernel as nulls, so that all are one pass over the joined pairs."""
    edit = lambda v: columns.variant(F.col(f"{v}.start"), F.col(f"{v}.end"), F.col(f"{v}.sequence"))
    a, b = edit("l"), edit("r")
    nothing = (columns.variant_length(a) == 0) | (columns.variant_length(b) == 0)
    equal = (F.col("l.start") == F.col("r.start")) & (F.col("l.end") == F.col("r.end")) & (F.col("l.sequence") == F.col("r.sequence"))
    native = F.when(equal, EQUIVALENT).when(nothing | columns.variant_is_disjoint(a, b), DISJOINT)
    low, high = F.least("l.start", "r.start"), F.greatest("l.end", "r.end")
    near = pairs.withColumn("native", native).withColumn("low", low).withColumn("window", F.when(F.col("native").isNull(), window_of(low, high)))
    seen = lambda v: F.concat(columns.part(F.col("window"), F.lit(0), F.col(f"{v}.start") - F.col("low")), F.col(f"{v}.sequence"), columns.rest(F.col("window"), F.col(f"{v}.end") - F.col("low")))
    measured = near.withColumn("between", arrow.edit_distance(seen("l"), seen("r")))
    never = F.lit(False)
    ladder = _ladder(never, never, F.col("l.distance"), F.col("r.distance"), F.col("between"), F.arrays_overlap("l.atoms", "r.atoms"))
    named = measured.withColumn("relation", F.coalesce("native", ladder)).withColumn("sizes", F.when(F.col("relation") == OVERLAP, columns.overlap("l.atoms", "r.atoms")))
    return named.select(F.col("l.ref_id").alias("ref_id"), F.col("l.id").alias("lhs_id"), F.col("r.id").alias("rhs_id"), "relation", F.col("sizes.common").alias("common"), F.col("sizes.universe").alias("universe"), *more)


def relations(summarised: DataFrame, references: DataFrame | None = None, other: DataFrame | None = None, bin_width: int = 2 * BIN) -> DataFrame:
    """ref_id, lhs_id, rhs_id, relation, common, universe for pairs whose spanning edits touch; all other pairs are disjoint.

    Of one table its unordered pairs, of two tables all pairs. common and universe count unit edits of overlapping pairs.
    An allele whose summary is an error is one row without a partner and without a relation: nothing is known of its pairs.
    The windows that the summaries carry suffice, so references are not needed again (the argument is kept for callers).
    """
    own = rows(summarised)
    out = told(paired(own, own if other is None else rows(other), other is None, bin_width=bin_width))
    out = out.unionByName(_failed(summarised, "lhs_id", out))
    return out if other is None else out.unionByName(_failed(other, "rhs_id", out))


def _failed(summarised: DataFrame, side: str, like: DataFrame) -> DataFrame:
    """A row of `like` for each allele whose summary is an error: its reference and its name, the rest null."""
    names = {"ref_id": "ref_id", side: "allele_id"}
    columns_of = [(F.col(names[f.name]) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema]
    return summarised.where("error is not null").select(*columns_of)


def all_relations(summarised: DataFrame, references: DataFrame | None = None, bin_width: int = BIN) -> DataFrame:
    """relations(), with the disjoint pairs of each reference added: quadratic in a reference's alleles, by request only."""
    found = relations(summarised, references, bin_width=bin_width)
    ids = summarised.where("error is null").select("ref_id", "allele_id")
    every = ids.select("ref_id", F.col("allele_id").alias("lhs_id")).join(ids.select("ref_id", F.col("allele_id").alias("rhs_id")), "ref_id").where("lhs_id < rhs_id")
    told = every.join(found, ["ref_id", "lhs_id", "rhs_id"], "left").withColumn("relation", F.coalesce("relation", F.lit(DISJOINT)))
    return told.unionByName(_failed(summarised, "lhs_id", told))


def where_relation(found: DataFrame, relation: str) -> DataFrame:
    return found.where(F.col("relation") == relation)


def are_equivalent(found: DataFrame) -> DataFrame:
    return where_relation(found, EQUIVALENT)


def contains(found: DataFrame) -> DataFrame:
    return where_relation(found, CONTAINS)


def is_contained(found: DataFrame) -> DataFrame:
    return where_relation(found, IS_CONTAINED)


def are_disjoint(found: DataFrame) -> DataFrame:
    return where_relation(found, DISJOINT)


def have_overlap(found: DataFrame) -> DataFrame:
    return where_relation(found, OVERLAP)


def compare_sequences(df: DataFrame, reference: str = "reference", lhs: str = "lhs", rhs: str = "rhs") -> DataFrame:
    """df with relation: of two observed sequences. Equal ones are told natively, distances before unit edits."""
    return df.withColumn("relation", F.when(F.col(lhs) == F.col(rhs), EQUIVALENT).otherwise(arrow.sequence_relation(reference, lhs, rhs)))


def compare_alleles(df: DataFrame, reference: str = "reference", lhs: str = "lhs", rhs: str = "rhs") -> DataFrame:
    """df with relation: of two alleles of one reference in a row."""
    seen = df.withColumns({"_l": columns.patch(reference, lhs), "_r": columns.patch(reference, rhs)})
    return compare_sequences(seen, reference, "_l", "_r").drop("_l", "_r")


def compare_supremals(df: DataFrame, reference: str = "reference", lhs: str = "lhs", rhs: str = "rhs") -> DataFrame:
    """df with relation: of two spanning edits in a row; only the union of their windows is aligned."""
    a, b = F.col(lhs), F.col(rhs)
    nothing = (columns.variant_length(a) == 0) | (columns.variant_length(b) == 0)
    low, high = F.least(a["start"], b["start"]), F.greatest(a["end"], b["end"])
    window = columns.part(F.col(reference), low, high)
    seen = lambda v: F.concat(columns.part(F.col(reference), low, v["start"]), v["sequence"], columns.part(F.col(reference), v["end"], high))
    native = F.when(a == b, EQUIVALENT).when(nothing | columns.variant_is_disjoint(a, b), DISJOINT)
    return df.withColumn("relation", F.coalesce(native, arrow.sequence_relation(window, seen(a), seen(b))))


def histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("relation").agg(F.count("*").alias("pairs"))
