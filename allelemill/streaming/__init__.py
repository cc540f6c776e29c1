"""Alleles as a stream: everything about one allele is a function of its row, so streams need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, columns

#: Symbols beside an allele's edits in the windows that are tried in turn.
PADS = (32, 512, 8192, 1 << 17, None)

#: Changes that are read with their reference: what is given of it is checked, what is left out is taken from it.
ASKS = r"[ACGT][>\[=]|del[ACGT]|dup|inv"


def normalised(stream: DataFrame, references: DataFrame) -> DataFrame:
    """stream (allele_id, ref_id, hgvs) with variants, canonical_hgvs, supremal and error, for alleles of known references.

    references (ref_id, sequence) is a static table; the join is stateless. A reference goes to Python whole only with
    expressions that ask for it, and with alleles whose spanning edit exceeds all windows.
    """
    n = F.length("sequence").cast("long")
    joined = stream.join(references, "ref_id").withColumn("_parsed", arrow.parse_hgvs_with("hgvs", F.when(F.col("hgvs").rlike(ASKS), F.col("sequence"))))
    far = F.exists("_parsed.variants", lambda v: v["end"] > F.length("sequence"))
    problem = F.coalesce(F.col("_parsed.error"), F.when(far, "ValueError: the range ends beyond the reference"), columns.allele_error("_parsed.variants"))
    told = joined.withColumn("_error", problem)
    variants = F.col("_parsed.variants")
    for k, pad in enumerate(PADS):
        # Narrow windows first; wider ones only where these do not tell, and the whole reference for what exceeds them all.
        want = F.col("_error").isNull() & (F.lit(True) if k == 0 else F.col(f"_s{k - 1}.error").eqNullSafe("narrow"))
        low = F.lit(0).cast("long") if pad is None else F.coalesce(F.greatest(F.lit(0), F.array_min(F.transform(variants, lambda v: v["start"])) - pad), F.lit(0)).cast("long")
        high = n if pad is None else F.least(n, F.coalesce(F.array_max(F.transform(variants, lambda v: v["end"])) + pad, F.lit(0)))
        told = told.withColumn(f"_s{k}", arrow.summarise_allele(F.when(want, columns.part(F.col("sequence"), low, high)), variants, low, n))
    rounds = range(len(PADS))
    pick = lambda field: F.coalesce(*(F.when(~F.col(f"_s{k}.error").eqNullSafe("narrow"), F.col(f"_s{k}.{field}")) for k in rounds))
    return told.select("allele_id", "ref_id", "hgvs", variants.alias("variants"), pick("hgvs").alias("canonical_hgvs"), pick("supremal").alias("supremal"), F.col("_error").alias("error"))
