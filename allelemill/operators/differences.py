"""What can be taken away from an allele, and what then remains.

Two matches of an allele's minimal alignments, one before the other in both sequences, split it into three: what lies between is one
part, the rest the other. Matches are rows, and a join on dominance (row and column) makes the pairs; the matches of one
allele are dealt to blocks, and each pair of blocks is a group of the join, so no task has all pairs of an allele. A part is
named by tables of prefixes and suffixes, which each match carries: the name of what a pair makes is a product and a sum, so
equal parts are put together before any text is made. The kernel then sees each distinct part once, in any task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, columns
from ..kernel import align
from ..store import stored

#: Matches of a block of an allele.
BLOCK = 256


def _named(h: str, u: str, x: str, modulus: int) -> Column:
    return (F.col(h) + F.col(u) * F.col(x)) % modulus


def split_pairs(cores: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, p_row, p_col, q_row, q_col: for each distinct part of each of cores (id, points) the first pair of points around it."""
    points = cores.select("id", F.size("points").alias("n"), F.posexplode("points").alias("k", "at")).select("id", "at.*", F.floor(F.col("k") / block).cast("int").alias("own"), F.floor((F.col("n") - 1) / block).cast("int").alias("last"))
    left = points.select("id", F.col("own").alias("i"), F.explode(F.sequence("own", "last")).alias("j"), *(F.col(c).alias(f"p_{c}") for c in ("row", "col", "h1", "u1", "h2", "u2")))
    right = points.select("id", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *(F.col(c).alias(f"q_{c}") for c in ("row", "col", "x1", "x2")))
    pairs = left.join(right, ["id", "i", "j"]).where("p_row < q_row and p_col < q_col")
    names = [F.expr("p_row - p_col + q_col - q_row").alias("longer"), _named("p_h1", "p_u1", "q_x1", align.MODULI[0]).alias("name1"), _named("p_h2", "p_u2", "q_x2", align.MODULI[1]).alias("name2")]
    first = pairs.groupBy("id", *names).agg(F.min(F.struct("p_row", "p_col", "q_row", "q_col")).alias("at"))
    return first.select("id", "at.*")


def differences(alleles: DataFrame, reference: str = "reference", variants: str = "variants", block: int = BLOCK) -> DataFrame:
    """A row for each distinct subtrahend of each row: its columns, subtrahend, remainder, their HGVS and relations (of the allele with the
    subtrahend and with the remainder, and between the two).

    Equal pairs of reference and observed sequence are told once. Parts are named by 62 bits. Rows whose reference or variants are null,
    or whose variants overlap, are left out; an allele that changes nothing has one subtrahend, which changes nothing either.
    """
    both = F.sha2(F.concat(F.sha2(F.col(reference), 256), F.col("_observed")), 256)
    rows = alleles.withColumn("_observed", columns.patch(reference, variants)).where(F.col("_observed").isNotNull()).withColumn("_id", both)
    each = rows.select(F.col("_id").alias("id"), F.col(reference).alias("_reference"), "_observed").dropDuplicates(["id"])
    cores = stored(each.withColumn("c", arrow.core_points("_reference", "_observed")).select("id", "_reference", "c.shift", "c.a", "c.b", "c.points"), "cores")
    parts = split_pairs(cores, block).join(cores.drop("points"), "id")
    told = parts.withColumn("_d", arrow.difference_part("_reference", "shift", "a", "b", "p_row", "p_col", "q_row", "q_col"))
    fields = ("subtrahend", "remainder", "with_subtrahend", "with_remainder", "between")
    named = told.select(F.col("id").alias("_id"), *(F.col(f"_d.{f}").alias(f) for f in fields), arrow.rich_hgvs("_d.subtrahend", "_reference").alias("subtrahend_hgvs"), arrow.rich_hgvs("_d.remainder", "_reference").alias("remainder_hgvs"))
    return rows.join(named, "_id").select(*alleles.columns, *fields, "subtrahend_hgvs", "remainder_hgvs")


def extract(df: DataFrame, reference: str = "reference", observed: str = "observed") -> DataFrame:
    """df with the canonical allele of an observed sequence, its HGVS, distance, spanning and local spanning edits."""
    return df.withColumn("_s", arrow.summarise(reference, observed)).withColumns({k: F.col(f"_s.{k}") for k in ("canonical", "distance", "supremal", "local_supremal", "atoms", "hgvs")}).drop("_s")
