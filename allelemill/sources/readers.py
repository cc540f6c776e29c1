"""FASTA, VCF and label files as DataFrames; all parsing is native and splits by file block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow, columns


def read_fasta(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    """ref_id, sequence: a row for each record, or with merge one row for each file (its records joined, ref_id the path).

    Records are cut at line breaks before '>', so a large file of many records is read by many tasks.
    """
    if merge:
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.col("_metadata.file_path").alias("ref_id"), columns.fasta_sequence("value").alias("sequence"))
    record = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("record"))
    lines = F.split("record", "\r\n|\r|\n")
    body = F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x))
    named = record.where(F.trim("record") != "")
    return named.select(F.regexp_extract(lines[0], r"^\s*(\S*)", 1).alias("ref_id"), F.array_join(body, "").alias("sequence"))


def read_vcf(spark: SparkSession, path: str, split_alternatives: bool = True) -> DataFrame:
    """chrom, id, variants, from the data lines. Several alternatives give a row each, or stay one verbatim text."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    alternatives = F.split(f[4], ",") if split_alternatives else F.array(f[4])
    rows = lines.select(f[0].alias("chrom"), f[2].alias("id"), (f[1].cast("long") - 1).alias("start"), f[3].alias("ref"), F.explode(alternatives).alias("alt"))
    return rows.select("chrom", "id", F.array(columns.variant(F.col("start"), F.col("start") + F.length("ref"), F.col("alt"))).alias("variants"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """allele_id, hgvs, variants, error: lines of a label and an HGVS expression."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("allele_id"), f[1].alias("hgvs"))
    return rows.withColumn("parsed", arrow.parse_hgvs("hgvs")).select("allele_id", "hgvs", "parsed.variants", "parsed.error")


def literals(spark: SparkSession, **named: str) -> DataFrame:
    """Inline sequences: ref_id, sequence."""
    return spark.createDataFrame(list(named.items()), "ref_id string, sequence string")
