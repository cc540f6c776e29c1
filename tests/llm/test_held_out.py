"""What the learning queries tell of rows that they did not learn from, through the registered functions."""

import zlib

import duckdb
import pytest

from allelemill.llm import queries

SF = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def auc(pairs):
    """How often a row of label 1 scores higher than one of label 0; a tie is half."""
    good, bad = ([s for s, y in pairs if y == k] for k in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("query", "label", "n", "rest", "least"), [("op1_quality_zstd", "quality", 5, 0, 0.85), ("op7_toxicity_crf", "toxic", 4, 2, 0.75)])
def test_scores(spark, query, label, n, rest, least):
    labels = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{SF}/labels.parquet'").fetchall())
    rows = queries.queries()[query](spark, SF).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 1000
    assert all(r["held_out"] == (fold(r["doc_id"], n) == rest) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert auc([(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]) > least


def test_languages(spark):
    known = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = queries.op6_language_id(spark, SF).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and known[r["doc_id"]]]
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in held) > 0.98 * len(held) > 200
