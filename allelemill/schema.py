"""Types of the engine: a variant is a deletion [start, end) with an insertion, an allele an array of variants."""

from __future__ import annotations

import pyarrow as pa

VARIANT = "struct<start: bigint, end: bigint, sequence: string>"
ALLELE = f"array<{VARIANT}>"
PARSED = f"struct<variants: {ALLELE}, error: string>"

ARROW_VARIANT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sequence", pa.string())])
ARROW_ALLELE = pa.list_(ARROW_VARIANT)
ARROW_UNITS = pa.list_(pa.struct([("pos", pa.int64()), ("symbol", pa.string())]))
ARROW_STRETCHES = pa.list_(pa.struct([("row", pa.int64()), ("col", pa.int64()), ("length", pa.int32())]))

#: The five ways in which two alleles relate.
EQUIVALENT, CONTAINS, IS_CONTAINED, OVERLAP, DISJOINT = RELATIONS = ("equivalent", "contains", "is_contained", "overlap", "disjoint")
