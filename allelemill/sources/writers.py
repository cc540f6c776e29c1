"""Text sinks; the primary sink of any result is df.write.parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, columns


def write_normalised(alleles: DataFrame, path: str) -> None:
    """Lines `label id:g.hgvs spdi` of alleles (allele_id, ref_id, reference, canonical, supremal)."""
    hgvs = F.concat(F.col("ref_id").cast("string"), F.lit(":g."), arrow.rich_hgvs("canonical", "reference"))
    alleles.select(F.concat_ws(" ", "allele_id", hgvs, columns.to_spdi("supremal", F.col("ref_id").cast("string")))).write.text(path)


def write_relations(pairs: DataFrame, path: str) -> None:
    """Lines `lhs rhs relation`, with the sizes of the overlap where alleles overlap."""
    sizes = F.when(F.col("relation") == "overlap", F.concat_ws(" ", F.col("common"), F.col("universe")))
    pairs.select(F.concat_ws(" ", "lhs_id", "rhs_id", "relation", sizes)).write.text(path)


def write_dot(pairs: DataFrame, path: str) -> None:
    """One Graphviz graph in lines for each row of (reference, observed), each graph in one file's order."""
    pairs.select(F.array_join(arrow.dot("reference", "observed"), "\n")).write.text(path)
