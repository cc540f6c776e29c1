"""Minimal alignments and atomic ways as rows. There may be exponentially many of one row, and no list or task holds them.

First each row is counted, by the table of its alignments, and becomes ranges of RANGE numbers; these are dealt to all tasks,
where each number is turned into its alignment by the counts alone. So one row's alignments are made by many tasks, and what a
lost executor had is made again range by range.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import allele_lists
from ..kernel import align
from ..schema import ALLELE

#: Alleles of a range, and of a batch.
RANGE, BATCH = 10_000, 1000


def _ranged(df: DataFrame, columns: list[str], count: Callable[..., int], size: int) -> DataFrame:
    """df with _first and _size, a row for each range of the numbers that count(*values of columns) tells."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]

            def made(some: list[tuple[int, int, int]]) -> pa.RecordBatch:
                rows, starts, sizes = (pa.array(x, pa.int64()) for x in zip(*some, strict=True))
                return pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), starts, sizes], [*batch.schema.names, "_first", "_size"])

            counts = (0 if any(x is None for x in row) else count(*row) for row in zip(*values, strict=True))
            ranges = ((i, k, min(size, n - k)) for i, n in enumerate(counts) for k in range(0, n, size))
            # Ranges of many rows are one batch: rows have few each.
            while some := list(itertools.islice(ranges, BATCH)):
                yield made(some)

    return df.mapInArrow(run, f"{fields}, _first long, _size long")


def _rows(df: DataFrame, columns: list[str], name: str, count: Callable[..., int], many: Callable[..., Iterator], size: int) -> DataFrame:
    """df with `name` (a number from 0) and `variants`, a row for each allele: count(*values of columns) of them, of which
    many(*values, first, size) yields a range."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    # Dealt by all that a row has, as many rows may have equal texts; to a given number of tasks, as the work is not by bytes.
    own = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _ranged(df, columns, count, size).repartition(tasks, F.xxhash64(*own, "_first"))

    def run(batches):
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*columns, "_first", "_size")]
            found = ((i, k, way) for i, row in enumerate(zip(*values, strict=True)) for k, way in enumerate(many(*row), row[-2]))
            while some := list(itertools.islice(found, BATCH)):
                rows, numbers, ways = zip(*some, strict=True)
                taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-2]]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(numbers, pa.int64()), allele_lists(ways)], [*batch.schema.names[:-2], name, "variants"])

    return dealt.mapInArrow(run, f"{fields}, {name} long, variants {ALLELE}")


def _up_to(limit: int | None, n: int) -> int:
    return n if limit is None else min(limit, n)


def paths(df: DataFrame, reference: str = "reference", observed: str = "observed", atomics: bool = False, limit: int | None = None, size: int = RANGE) -> DataFrame:
    """df with path and variants: a row for each minimal alignment, at most `limit` for each row of df (none by default)."""
    count = lambda r, o: _up_to(limit, align.windowed(r, o).walk_count(atomics))
    return _rows(df, [reference, observed], "path", count, lambda r, o, first, n: align.windowed(r, o).walks(n, atomics, first), size)


def ways(df: DataFrame, variant: str = "variant", limit: int | None = None, size: int = RANGE) -> DataFrame:
    """df with way and variants: a row for each way to write a variant as single deletions and insertions."""
    read = lambda v: align.Edit(v["start"], v["end"], v["sequence"])
    return _rows(df, [variant], "way", lambda v: _up_to(limit, align.forms(read(v))), lambda v, first, n: align.interleavings(read(v), n, first), size)
