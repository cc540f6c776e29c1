"""What Column expressions can say, without leaving the JVM. Positions are from 0; null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALLELE, PARSED


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]"""
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def rest(text: Column, start: Column) -> Column:
    return part(text, start, F.length(text).cast("long"))


def deleted_texts(vs, reference) -> Column:
    """What each variant deletes."""
    return F.transform(_col(vs), lambda v: part(_col(reference), v["start"], v["end"]))


def variant(start, end, sequence) -> Column:
    return F.struct(_col(start).cast("long").alias("start"), _col(end).cast("long").alias("end"), _col(sequence).alias("sequence"))


def variant_error(start, end) -> Column:
    """Why no variant can have these ends; null if one can."""
    start, end = _col(start), _col(end)
    return F.when(start < 0, "ValueError: a variant cannot begin before the first symbol").when(start > end, "ValueError: a variant cannot end before it begins")


def safe_variant(start, end, sequence) -> Column:
    """The variant, or null where its ends are invalid."""
    return F.when(variant_error(start, end).isNull(), variant(start, end, sequence))


def variant_length(v) -> Column:
    v = _col(v)
    return v["end"] - v["start"] + F.length(v["sequence"])


def way_count(v) -> Column:
    """In how many ways a variant is one of single deletions and insertions: the ways to choose the insertions' places."""
    v = _col(v)
    cut, new = v["end"] - v["start"], F.length(v["sequence"]).cast("long")
    less, more = F.least(cut, new), F.greatest(cut, new)
    one = F.lit(1).cast("long")
    return F.when(less == 0, one).otherwise(F.aggregate(F.sequence(one, less), one, lambda ways, k: F.call_function("div", ways * (more + k), k)))


def variant_text(v) -> Column:
    v = _col(v)
    return F.concat(v["start"].cast("string"), F.lit(":"), v["end"].cast("string"), F.lit("/"), v["sequence"])


def to_spdi(v, reference_id="") -> Column:
    v = _col(v)
    name = reference_id if isinstance(reference_id, Column) else F.lit(reference_id)
    return F.concat_ws(":", name, v["start"].cast("string"), (v["end"] - v["start"]).cast("string"), v["sequence"])


def parse_spdi(text) -> Column:
    """struct<variants, error>: an SPDI expression's one variant, natively."""
    p = F.split(_col(text), ":")
    # A position as Python's int() reads it: white space around and single underscores between digits.
    number = lambda c: F.when(F.trim(c).rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast("bigint"))
    start = number(F.get(p, F.lit(1)))
    end = start + F.coalesce(number(F.get(p, F.lit(2))), F.length(F.get(p, F.lit(2))).cast("long"))
    error = F.when(F.size(p) != 4, "ValueError: four parts make an SPDI expression").when(start.isNull(), "ValueError: the position is not a number").otherwise(variant_error(start, end))
    allele = F.when(error.isNull(), F.array(variant(start, end, F.get(p, F.lit(3)))))
    return F.when(_col(text).isNull(), F.struct(F.lit(None).cast(ALLELE).alias("variants"), F.lit("TypeError: expression must be a string").alias("error"))).otherwise(F.struct(allele.alias("variants"), error.alias("error"))).cast(PARSED)


def to_hgvs(v, reference=None, only_substitutions: bool = True) -> Column:
    """Plain HGVS of one variant. Deleted symbols show in substitutions; in all if only_substitutions is off."""
    v = _col(v)
    start, end, new = v["start"], v["end"], v["sequence"]
    size = end - start
    old = F.lit("") if reference is None else part(_col(reference), start, end)
    shown = F.lit("") if only_substitutions else old
    text = lambda x: x.cast("string")
    place = F.when(size == 1, text(end)).otherwise(F.concat(text(start + 1), F.lit("_"), text(end)))
    return (
        F.when((size == 0) & (new == ""), "=")
        .when(size == 0, F.concat(text(start), F.lit("_"), text(start + 1), F.lit("ins"), new))
        .when((size == 1) & (F.length(new) == 1), F.concat(text(end), old, F.lit(">"), new))
        .when(new == "", F.concat(place, F.lit("del"), shown))
        .otherwise(F.concat(place, F.lit("del"), shown, F.lit("ins"), new))
    )


def in_order(vs) -> Column:
    """The allele's variants by start, then end."""
    return F.array_sort(_col(vs))


def allele_error(vs) -> Column:
    """Why the allele has no order (variants overlap or share a place); null if it has one."""
    v = in_order(vs)
    pairs = F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: (b["start"] < a["end"]) | ((a["start"] == b["start"]) & (a["end"] == b["end"])))
    return F.when((F.size(_col(vs)) > 1) & F.exists(pairs, lambda x: x), "ValueError: variants overlap or share a place")


def allele_to_hgvs(vs, reference=None, only_substitutions: bool = True, sequence_prefix: bool = False, sort: bool = True) -> Column:
    v = in_order(vs) if sort else _col(vs)
    each = F.transform(v, lambda x: to_hgvs(x, reference, only_substitutions))
    many = F.size(_col(vs)) > 1  # the texts are made once, whatever surrounds them
    body = F.when(F.size(_col(vs)) == 0, "=").otherwise(F.concat(F.when(many, "[").otherwise(""), F.array_join(each, ";"), F.when(many, "]").otherwise("")))
    return F.concat(_col(reference), F.lit(":g."), body) if sequence_prefix and reference is not None else body


def patch(reference, vs, strict: bool = False, sort: bool = True) -> Column:
    """The observed sequence. Overlapping variants give null, or an error if strict. A reference of one byte a symbol may come as
    binary, of which parts are cut without a walk over its symbols; the result is a string."""
    reference, v = _col(reference), in_order(vs) if sort else _col(vs)
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(v, begin, lambda acc, x: F.struct(F.concat(acc["out"], part(reference, acc["at"], x["start"]), x["sequence"]).alias("out"), x["end"].alias("at")), lambda acc: F.concat(acc["out"], rest(reference, acc["at"])))
    error, one = allele_error(vs), F.get(_col(vs), F.lit(0))
    # Most alleles are one variant, whose parts are joined once.
    single = F.concat(part(reference, F.lit(0).cast("long"), one["start"]), one["sequence"], rest(reference, one["end"]))
    done = F.when(F.size(_col(vs)) == 1, single).otherwise(done)
    return F.when(error.isNull(), done).otherwise(F.raise_error(error) if strict else F.lit(None))


def reverse_complement(sequence) -> Column:
    return F.reverse(F.translate(_col(sequence), "ACGT", "TGCA"))


def variant_reverse_complement(v, pivot) -> Column:
    v, pivot = _col(v), _col(pivot)
    return variant(pivot - v["end"] - 1, pivot - v["start"] - 1, reverse_complement(v["sequence"]))


def variant_is_disjoint(lhs, rhs) -> Column:
    """No symbol deleted by both, and at a common border no symbol inserted by both."""
    a, b = _col(lhs), _col(rhs)
    symbols = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    crossing = (b["start"] < a["end"]) & (a["start"] < b["end"])
    apart = (b["start"] > a["end"]) | (a["start"] > b["end"])
    return ~crossing & (apart | ~F.arrays_overlap(symbols(a["sequence"]), symbols(b["sequence"])))


def trim(lhs, rhs) -> Column:
    """struct<prefix, suffix>: common prefix, and common suffix of what remains; by halving, so each side is cut few times."""
    a, b = _col(lhs), _col(rhs)
    n = F.least(F.length(a), F.length(b))

    def common(x: Column, y: Column, most: Column) -> Column:
        # The length's binary digits, highest first: a digit stays if the longer piece still agrees.
        digits = F.sequence(F.ceil(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))
        return F.aggregate(digits, F.lit(0), lambda at, bit: F.when((at + F.pow(F.lit(2), bit).cast("int") <= most) & (F.substring(x, 1, at + F.pow(F.lit(2), bit).cast("int")) == F.substring(y, 1, at + F.pow(F.lit(2), bit).cast("int"))), at + F.pow(F.lit(2), bit).cast("int")).otherwise(at))

    front = common(a, b, n)
    return F.struct(front.alias("prefix"), common(F.reverse(a), F.reverse(b), n - front).alias("suffix"))


def slice_sequence(sequence, positions, inversion: bool = False) -> Column:
    """Pieces between pairs of positions, joined; a last position alone runs to the end. Optionally turned round."""
    s, p = _col(sequence), _col(positions)
    pairs = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.floor((F.size(p) - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = F.array_join(F.transform(pairs, lambda k: part(s, F.get(p, 2 * k).cast("long"), F.coalesce(F.get(p, 2 * k + 1).cast("long"), F.length(s).cast("long")))), "")
    out = F.when(s.isNotNull() & p.isNotNull(), out)
    return reverse_complement(out) if inversion else out


def atom_numbers(atoms) -> Column:
    """Unit edits as numbers, equal where they are equal: place and code point (none: 0). Spark hashes arrays of numbers; of arrays of
    structs it compares each element with each."""
    return F.transform(_col(atoms), lambda u: u["pos"] * (1 << 21) + F.ascii(u["symbol"]))


def overlap(lhs_atoms, rhs_atoms) -> Column:
    """struct<common, universe>: how many unit edits both have, and how many either has; as structs or as numbers."""
    a, b = _col(lhs_atoms), _col(rhs_atoms)
    return F.struct(F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("universe"))


def atoms_disjoint(lhs_atoms, rhs_atoms) -> Column:
    return ~F.arrays_overlap(_col(lhs_atoms), _col(rhs_atoms))


def vcf_variant(line) -> Column:
    """The variant of a VCF data line: columns 2, 4 and 5, the alternative verbatim."""
    f = F.split(F.trim(_col(line)), r"\s+")
    start = f[1].cast("long") - 1
    return variant(start, start + F.length(f[3]), f[4])


def fasta_sequence(whole) -> Column:
    """All records of a FASTA text as one sequence."""
    lines = F.split(_col(whole), "\r\n|\r|\n")
    return F.array_join(F.transform(F.filter(lines, lambda x: ~x.startswith(">")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "")


