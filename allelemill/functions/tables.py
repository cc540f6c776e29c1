"""Table functions for SQL: FROM t, LATERAL paths(t.a, t.b). Each yields its rows one by one; null arguments give none.

One row's results come from one task here; `operators.expand` and `operators.differences` deal them to many.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernel import align
from ..schema import ALLELE, VARIANT


def _edits(edits) -> list[tuple]:
    return [tuple(e) for e in edits]


class Edges:
    """The distinct edits between neighbouring matches of minimal alignments."""

    def eval(self, reference: str, observed: str) -> Iterator[tuple]:
        if reference is not None and observed is not None:
            for e in align.windowed(reference, observed).edges():
                yield (tuple(e),)


class Steps:
    """Edges with the matches that they join; with atomics a row for each way of single deletions and insertions."""

    def eval(self, reference: str, observed: str, atomics: bool = False) -> Iterator[tuple]:
        if reference is None or observed is None:
            return
        w = align.windowed(reference, observed)
        for p, q, e in w.steps():
            if e.start < e.end or e.sequence:
                for way in align.interleavings(e) if atomics else [[e]]:
                    yield (*(x + w.shift for x in (*p, *q)), _edits(way))


class Paths:
    """Minimal alignments; with atomics in every way of single deletions and insertions."""

    def eval(self, reference: str, observed: str, atomics: bool = False) -> Iterator[tuple]:
        if reference is not None and observed is not None:
            yield from ((k, _edits(w)) for k, w in enumerate(align.windowed(reference, observed).walks(atomics=bool(atomics))))


class Ways:
    """The ways to write a variant as single deletions and insertions."""

    def eval(self, start: int, end: int, sequence: str) -> Iterator[tuple]:
        if start is not None and end is not None and sequence is not None:
            yield from ((k, _edits(w)) for k, w in enumerate(align.interleavings(align.Edit(start, end, sequence))))


class Differences:
    """What can be taken away from the allele that makes observed of reference, and what remains."""

    def eval(self, reference: str, observed: str) -> Iterator[tuple]:
        if reference is not None and observed is not None:
            for d in align.difference(reference, observed):
                yield _edits(d["subtrahend"]), _edits(d["remainder"]), d["with_subtrahend"], d["with_remainder"], d["between"]


#: Names in SQL, with the columns of their rows.
TABLES = {
    "edges_of": (Edges, f"edge {VARIANT}"),
    "steps_of": (Steps, f"source_row bigint, source_col bigint, sink_row bigint, sink_col bigint, variants {ALLELE}"),
    "paths_of": (Paths, f"path bigint, variants {ALLELE}"),
    "ways_of": (Ways, f"way bigint, variants {ALLELE}"),
    "differences_of": (Differences, f"subtrahend {ALLELE}, remainder {ALLELE}, with_subtrahend string, with_remainder string, between string"),
}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session."""
    for name, (rows, kind) in TABLES.items():
        spark.udtf.register(name, F.udtf(rows, returnType=kind, useArrow=True))
