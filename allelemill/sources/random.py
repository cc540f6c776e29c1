"""Random sequences and alleles; a seed and a row's number decide a row, so a lost task gives the same rows again."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import _each, arrow_udf
from ..kernel.notation import NUCLEOTIDES
from ..schema import ARROW_ALLELE


def _unit(*seeds) -> F.Column:
    """A number in [0, 1) from a hash of the seeds."""
    return F.pmod(F.xxhash64(*seeds), F.lit(1 << 40)) / F.lit(float(1 << 40))


def random_sequences(spark: SparkSession, n: int, max_length: int, min_length: int = 0, alphabet: str = NUCLEOTIDES, weights: list[float] | None = None, seed: int = 0) -> DataFrame:
    """id, sequence: n sequences of uniform length and weighted symbols."""
    if not 0 <= min_length <= max_length:
        raise ValueError("lengths must be 0 <= min_length <= max_length")
    shares = weights or [1.0] * len(alphabet)
    if len(shares) != len(alphabet) or min(shares) < 0 or not sum(shares):
        raise ValueError("weights must be as many as symbols, none negative, not all zero")
    length = (F.lit(min_length) + F.floor(_unit("id", F.lit(seed), F.lit("length")) * (max_length - min_length + 1))).cast("int")

    def symbol(i: F.Column) -> F.Column:
        at, passed, chosen = _unit("id", F.lit(seed), i), 0.0, None
        for letter, share in zip(alphabet, shares, strict=True):
            passed += share / sum(shares)
            chosen = F.when(at < passed, letter) if chosen is None else chosen.when(at < passed, letter)
        return chosen.otherwise([x for x, share in zip(alphabet, shares, strict=True) if share][-1])

    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    return spark.range(n).select("id", F.array_join(F.transform(places, symbol), "").alias("sequence"))


def random_allele(reference: str, seed: int, p: float | None = None, mean_deletion: float = 1.0, mean_insertion: float = 1.0) -> list[dict]:
    """Edits that never adjoin: a place begins one with chance p (1 in the reference's length by default), if no earlier one
    reaches it; lengths are whole parts of exponential draws. Each place has its own draws, from the seed and the place.

    Places are drawn first, lengths next, and last the texts: where symbols are replaced, each differs from what it stands for.
    """
    chance = p if p is not None else 1 / max(1, len(reference))
    draws = random.Random(seed)
    places = [at for at in range(len(reference)) if draws.random() <= chance]
    sizes = [(int(draws.expovariate(1 / mean_deletion)), int(draws.expovariate(1 / mean_insertion))) for _ in places]
    free, edits = 0, []
    for at, (cut, put) in zip(places, sizes, strict=True):
        if at >= free:
            cut, put = (min(cut, len(reference) - at), put) if cut or put else (1, 1)
            edits.append((at, at + cut, max(put, cut) if put else 0))
            free = at + cut + 1
    other = {"": NUCLEOTIDES} | {x: NUCLEOTIDES.replace(x, "") for x in set(reference)}
    text = lambda old, size: "".join(draws.choice(other[old[k] if k < len(old) else ""]) for k in range(size))
    return [{"start": start, "end": end, "sequence": text(reference[start:end], size)} for start, end, size in edits]


def random_variants(p: float | None = None, mean_deletion: float = 1.0, mean_insertion: float = 1.0):
    """An Arrow function (reference, seed) -> allele."""

    def run(reference: pa.Array, seed: pa.Array) -> pa.Array:
        return _each(lambda r, s: random_allele(r, s, p, mean_deletion, mean_insertion), ARROW_ALLELE, reference, seed)

    return arrow_udf(ARROW_ALLELE)(run)
