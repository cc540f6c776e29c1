"""SQL names for the functions, for spark.sql and selectExpr."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import arrow, tables

#: Functions that SQL can say itself; parameters are named in the text.
SQL = {
    "reverse_complement(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGT', 'TGCA'))",
    "variant_length(v STRUCT<start: BIGINT, end: BIGINT, sequence: STRING>) RETURNS BIGINT": "v.end - v.start + length(v.sequence)",
    "to_spdi(id STRING, v STRUCT<start: BIGINT, end: BIGINT, sequence: STRING>) RETURNS STRING": "concat_ws(':', id, v.start, v.end - v.start, v.sequence)",
}

ARROW = ("edit_distance", "bounded_distance", "sequence_relation", "parse_hgvs", "parse_hgvs_with", "summarise", "summarise_window", "summarise_supremal", "edges", "steps", "stretches", "unit_edits", "supremal", "path_count", "paths", "atomics", "atomic_paths", "diagonal", "rich_hgvs_of", "dot", "internal_dot", "summarise_allele", "core_points", "difference_part")


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session under their own names, and the table functions under those of `tables.TABLES`."""
    for name in ARROW:
        spark.udf.register(name, getattr(arrow, name))
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    tables.register(spark)
