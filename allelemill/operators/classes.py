"""Relations of classes of equivalent alleles, and of spanning edits alone.

Equal spanning edits are one class however many alleles have them, so k equal alleles are one row and not k * k / 2 of them, and
each pair of distinct edits is told once. `expanded` gives the alleles' own pairs, by request.

Edits meet through joins of intervals (`intervals`): short ones in narrow bins, long ones on levels. A long edit's level is the power
of two that its length needs; on each level that is in use, from its own one up, it covers two bins at most, however long it is. Two
edits meet once. Edits that change nothing are left out, as they are disjoint with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, columns
from ..schema import CONTAINS, EQUIVALENT, IS_CONTAINED
from ..store import stored
from .intervals import LEVEL, level_of, meeting, paired  # noqa: F401
from .references import with_text
from .relations import rows, told, window_of

def classes(summarised: DataFrame) -> DataFrame:
    """One row for each spanning edit of each reference: that of the smallest of its alleles, as `rows`, with members."""
    own = rows(summarised)
    rest = [c for c in own.columns if c not in ("id", "ref_id", "start", "end", "sequence")]
    grouped = own.groupBy("ref_id", "start", "end", "sequence").agg(F.min("id").alias("id"), F.count("*").alias("members"), F.min_by(F.struct(*rest), "id").alias("b"))
    return grouped.select(*(F.col(f"b.{c}").alias(c) if c in rest else F.col(c) for c in own.columns), "members")


def members(summarised: DataFrame) -> DataFrame:
    """ref_id, class_id (as of `classes`), allele_id."""
    ids = summarised.where("error is null").groupBy("ref_id", "supremal").agg(F.min("allele_id").alias("class_id"))
    return summarised.where("error is null").select("ref_id", "supremal", "allele_id").join(ids, ["ref_id", "supremal"]).select("ref_id", "class_id", "allele_id")


def spans(summarised: DataFrame, windows: bool = False) -> DataFrame:
    """id, ref_id, start, end, distance, sequence of the spanning edits that change something; with windows also shift and window,
    the part of the reference that the summary kept, so that pairs need no other text."""
    s = F.col("supremal")
    rows = summarised.where(F.col("error").isNull() & (columns.variant_length("supremal") > 0))
    return rows.select(F.col("allele_id").alias("id"), "ref_id", s["start"].alias("start"), s["end"].alias("end"), "distance", s["sequence"].alias("sequence"), *(("shift", "window") if windows else ()))


def class_relations(summarised: DataFrame, least: int = LEVEL) -> DataFrame:
    """ref_id, lhs_id, rhs_id (the smallest alleles of two classes), relation, common, universe, lhs_members, rhs_members and pairs
    (of alleles that the row stands for), for classes whose spanning edits meet; a class of several alleles is equivalent with itself.
    Pairs of classes that are not listed are disjoint. Alleles with an error are left out: nothing is known of their pairs.
    """
    each = stored(classes(summarised), "classes")
    own = each.where("end > start or sequence != ''")
    sizes = (F.col(f"{side[0]}.members").alias(f"{side}_members") for side in ("lhs", "rhs"))
    sized = told(paired(own, own, least=least), *sizes).withColumn("pairs", F.col("lhs_members") * F.col("rhs_members"))
    none, n = F.lit(None).cast("int"), F.col("members")
    within = each.where("members > 1").select("ref_id", F.col("id").alias("lhs_id"), F.col("id").alias("rhs_id"), F.lit(EQUIVALENT).alias("relation"), none.alias("common"), none.alias("universe"), n.alias("lhs_members"), n.alias("rhs_members"), F.expr("members * (members - 1) div 2").alias("pairs"))
    return sized.select(within.columns).unionByName(within)


def mirrored(relation: Column) -> Column:
    return F.when(relation == CONTAINS, IS_CONTAINED).when(relation == IS_CONTAINED, CONTAINS).otherwise(relation)


def expanded(found: DataFrame, membership: DataFrame) -> DataFrame:
    """The pairs of alleles that rows of `class_relations` stand for, lhs_id < rhs_id; membership: of `members`."""
    one = membership.select("ref_id", F.col("class_id").alias("lhs_id"), F.col("allele_id").alias("_l"))
    two = membership.select("ref_id", F.col("class_id").alias("rhs_id"), F.col("allele_id").alias("_r"))
    every = found.join(one, ["ref_id", "lhs_id"]).join(two, ["ref_id", "rhs_id"]).where("lhs_id != rhs_id or _l < _r")
    relation = F.when(F.col("_l") < F.col("_r"), F.col("relation")).otherwise(mirrored(F.col("relation")))
    return every.select("ref_id", F.least("_l", "_r").alias("lhs_id"), F.greatest("_l", "_r").alias("rhs_id"), relation.alias("relation"), "common", "universe")


def histogram(found: DataFrame) -> DataFrame:
    """How many pairs of alleles relate in each way, from rows of `class_relations`."""
    return found.groupBy("relation").agg(F.sum("pairs").alias("pairs"))


def _seen(side: str, low: Column) -> Column:
    """What a side's edit makes of the window from `low` on."""
    return F.concat(columns.part(F.col("window"), F.lit(0), F.col(f"{side}.start") - low), F.col(f"{side}.sequence"), columns.rest(F.col("window"), F.col(f"{side}.end") - low))


def _windowed(pairs: DataFrame, references: DataFrame | None, *more: str) -> DataFrame:
    """pairs with low and the window of the reference that both edits span: out of the edits' own windows, or tiles of the references."""
    low, high = F.least("l.start", "r.start"), F.greatest("l.end", "r.end")
    if references is None:
        return pairs.select("l", "r", *more, F.col("l.ref_id").alias("ref_id"), low.alias("low"), window_of(low, high).alias("window"))
    return with_text(pairs.select("l", "r", *more, F.col("l.ref_id").alias("ref_id"), low.alias("low"), high.alias("high")), references)


def supremal_relations(edits: DataFrame, references: DataFrame | None, other: DataFrame | None = None, least: int = LEVEL) -> DataFrame:
    """ref_id, lhs_id, rhs_id, relation of spanning edits (id, ref_id, start, end, sequence) that meet; edits that change nothing are left
    out, pairs that are not listed are disjoint. Only the window that two edits span is read and aligned, and unit edits are only
    asked for where distances leave a pair open. Without references the edits bring windows (of `spans`): pairs are joined once then,
    and no tiles of the references with them; pairs that need no alignment go to the kernel as nulls."""
    real = lambda df: df.where("end > start or sequence != ''").drop("distance")
    pairs = paired(real(edits), real(edits if other is None else other), other is None, least)
    edit = lambda v: columns.variant(F.col(f"{v}.start"), F.col(f"{v}.end"), F.col(f"{v}.sequence"))
    a, b = edit("l"), edit("r")
    named = pairs.withColumn("relation", F.when(a == b, EQUIVALENT).when(columns.variant_is_disjoint(a, b), "disjoint"))
    shown = [F.col("l.ref_id").alias("ref_id"), F.col("l.id").alias("lhs_id"), F.col("r.id").alias("rhs_id"), "relation"]
    near = _windowed(named if references is None else named.where("relation is null"), references, "relation")
    near = near.withColumn("window", F.when(F.col("relation").isNull(), F.col("window")))
    aligned = near.withColumn("relation", F.coalesce("relation", arrow.sequence_relation("window", _seen("l", F.col("low")), _seen("r", F.col("low")))))
    if references is None:
        return aligned.select(*shown)
    return named.where("relation is not null").select(*shown).unionByName(aligned.select(*shown))


def supremal_contains(edits: DataFrame, references: DataFrame | None, other: DataFrame | None = None, least: int = LEVEL) -> DataFrame:
    """ref_id, lhs_id, rhs_id: pairs in which the edit lhs contains the edit rhs. A container spans what it contains, so only nested
    intervals are joined, and three distances tell: no unit edits at all. References as of `supremal_relations`."""
    real = lambda df: df.where("end > start or sequence != ''").drop("distance")
    pairs = paired(real(edits), real(edits if other is None else other), False, least, True)
    edit = lambda v: F.struct(F.col(f"{v}.start"), F.col(f"{v}.end"), F.col(f"{v}.sequence"))
    near = _windowed(pairs.where(edit("l") != edit("r")), references)
    one, two = _seen("l", F.col("low")), _seen("r", F.col("low"))
    far = near.withColumns({"dl": arrow.edit_distance("window", one), "dr": arrow.edit_distance("window", two), "d": arrow.edit_distance(one, two)})
    return far.where("dl - dr = d and dl + dr != d").select("ref_id", F.col("l.id").alias("lhs_id"), F.col("r.id").alias("rhs_id"))
