"""Exact deduplication by skew-safe combining.

Every stage groups by the digest *and* the whole normalised text, so texts are compared in full and two texts that
share a digest stay apart:

1. deduplicate locally: Spark's partial aggregation leaves one row for each text and task;
2. merge salted digest groups: what the tasks left of a digest meets in one of SALTS groups;
3. combine the salts' winners globally: at most SALTS rows for each text.

A group that holds a third of all rows thus reaches a task as one row for each earlier task, divided by SALTS.
Texts beyond the first of each group travel no further than their own task.

Defined results: a null text counts as empty, and all empty texts are one group. Of equal texts the smallest doc_id
stays; null doc_ids come after all others. Of rows that agree in doc_id and text, one stays. Extra columns are
carried through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, salted_join, stored

SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def winners(keyed: DataFrame, salt_by: Column, local: list[Column], final: list[Column], salts: int = SALTS) -> DataFrame:
    """One row for each (digest, norm) of `keyed`: n (its rows) and the aggregates `final` of the aggregates `local`."""
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    merged = salted.groupBy("digest", "norm", "_salt").agg(F.count("*").alias("n"), *local)
    return merged.groupBy("digest", "norm").agg(F.sum("n").alias("n"), *final)


def keyed(docs: DataFrame, digest=_digest) -> DataFrame:
    """docs with norm and digest in place of what has these names."""
    return docs.withColumn("norm", normalised(F.col("text"))).withColumn("digest", digest(F.col("norm")))


def groups(docs: DataFrame, salts: int = SALTS, digest=_digest) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A digest is nearly always one text's, and then the row finds its group by the digest alone (digests that very many rows
    have are dealt to many tasks); rows of a digest that several texts share find theirs by the whole text.
    """
    rows = keyed(docs.select("doc_id", "text"), digest)
    # min skips null doc_ids
    won = winners(rows, F.col("doc_id"), [F.min("doc_id").alias("best")], [F.min("best").alias("best")], salts)
    by_digest = stored(won.groupBy("digest").agg(F.count("*").alias("texts"), F.min("best").alias("best"), F.sum("n").alias("n")), "digests")
    # One row for each doc_id of a digest, counted: repeated rows never pile up in one task.
    ids = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    columns = ["digest", "doc_id", "copies", "best", "n"]
    both = salted_join(ids, by_digest.where("texts = 1"), "digest", "n", "doc_id").select(*columns)
    shared = by_digest.where("texts > 1").select("digest")
    if not shared.isEmpty():  # two texts with one digest: their rows are joined by the whole text
        apart = rows.join(shared, "digest", "left_semi").groupBy("digest", "norm", "doc_id").agg(F.count("*").alias("copies"))
        both = both.unionByName(apart.join(won, ["digest", "norm"]).select(*columns))
    number = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return both.select("doc_id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), "digest", number.alias("number")).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("number") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, whole and with all their columns."""
    column = {c: F.col(f"`{c}`") for c in docs.columns}
    whole, norm = column["text"], normalised(column["text"])
    # A text that is its own normal form need not travel twice.
    kind = F.when(whole.isNull(), 2).when(whole == norm, 0).otherwise(1)
    row = F.struct(kind.alias("kind"), F.when(kind == 1, whole).alias("text"), *(column[c].alias(f"x{i}") for i, c in enumerate(docs.columns) if c != "text"))
    comparable = [column[c] for c in docs.columns if c not in ("doc_id", "text") and not re.search("map<|variant", docs.schema[c].dataType.simpleString())]
    order = F.struct(column["doc_id"].isNull(), column["doc_id"], kind, *comparable)
    rows = docs.select(norm.alias("norm"), _digest(norm).alias("digest"), row.alias("row"), order.alias("rank"))
    local = [F.min_by("row", "rank").alias("best"), F.min("rank").alias("rank")]
    won = winners(rows, F.col("rank"), local, [F.min_by("best", "rank").alias("best")], salts)
    text = F.when(F.col("best.kind") == 0, F.col("norm")).otherwise(F.col("best.text"))
    return won.select(*(text.alias(c) if c == "text" else F.col(f"best.x{i}").alias(c) for i, c in enumerate(docs.columns)))
