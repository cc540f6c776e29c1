"""Classes of alleles, spanning edits, differences and ranges of alignments against all pairs and whole lists."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from allelemill.functions import columns
from allelemill.kernel import align
from allelemill.operators import classes, differences, expand, intervals, references, relations, summaries

V = "array<struct<start: bigint, end: bigint, sequence: string>>"


@pytest.fixture(scope="module")
def done(spark):
    """Alleles of repeats, many of them equivalent, some that change nothing, one far too long for a bin, one broken."""
    rng = random.Random(3)
    text = "".join(rng.choices("AC", k=90)) + "".join(rng.choices("ACGT", k=900))
    alleles = []
    for k in range(70):
        at = rng.randrange(80)
        alleles.append((f"a{k:02}", "r", [(at, at + rng.randrange(3), "".join(rng.choices("AC", k=rng.randrange(3))))]))
    alleles += [("long", "r", [(5, 800, "")]), ("none", "r", []), ("same", "r", [(3, 4, text[3])]), ("bad", "r", [(0, 3, "A"), (1, 2, "")])]
    refs = spark.createDataFrame([("r", text)], "ref_id string, sequence string")
    told = summaries.summaries(spark.createDataFrame(alleles, f"allele_id string, ref_id string, variants {V}"), refs)
    return text, refs, told.persist()


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_classes_expand_to_all_pairs(done):
    _, _, told = done
    found = classes.class_relations(told, least=3)
    pairs = classes.expanded(found, classes.members(told))
    names = "lhs_id", "rhs_id", "relation", "common", "universe"
    nothing = {r["allele_id"] for r in told.where(columns.variant_length("supremal") == 0).collect()}
    every = [r for r in relations.relations(told, bin_width=7).where("rhs_id is not null").collect() if not nothing & {r["lhs_id"], r["rhs_id"]} or nothing >= {r["lhs_id"], r["rhs_id"]}]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, (tuple(r[n] for n in names) for r in pairs.collect()))) == sorted(map(key, (tuple(r[n] for n in names) for r in every)))
    assert found.count() < pairs.count() and {r["relation"]: r["pairs"] for r in classes.histogram(found).collect()} == {r["relation"]: r["count"] for r in pairs.groupBy("relation").count().collect()}
    assert classes.class_relations(told.limit(0)).count() == 0


def test_edits_with_windows_need_no_references(done):
    _, refs, told = done
    plain, own = classes.spans(told), classes.spans(told, windows=True)
    for compare in (classes.supremal_relations, classes.supremal_contains):
        found = compare(own, None)
        assert rows(found, *found.columns) == rows(compare(plain, refs), *found.columns)


def test_equal_alleles_are_one_row(spark):
    refs = spark.createDataFrame([("r", "ACGTTTTACG")], "ref_id string, sequence string")
    many = spark.range(300).select(F.concat(F.lit("x"), F.col("id")).alias("allele_id"), F.lit("r").alias("ref_id"), F.expr("array(named_struct('start', 3L + id % 4, 'end', 4L + id % 4, 'sequence', ''))").alias("variants"))
    (row,) = classes.class_relations(summaries.summaries(many, refs)).collect()
    assert (row["lhs_id"], row["rhs_id"], row["relation"], row["lhs_members"], row["pairs"]) == ("x0", "x0", "equivalent", 300, 300 * 299 // 2)


def test_spanning_edits_alone_tell_the_same(done):
    _, refs, told = done
    edits = classes.spans(told)
    want = [r for r in relations.relations(told).collect() if r["rhs_id"] and not {"none", "same"} & {r["lhs_id"], r["rhs_id"]}]
    real = {r["id"] for r in edits.collect()}
    want = sorted((r["lhs_id"], r["rhs_id"], r["relation"]) for r in want if {r["lhs_id"], r["rhs_id"]} <= real)
    assert rows(classes.supremal_relations(edits, refs, least=4), "lhs_id", "rhs_id", "relation") == want
    inside = sorted([(a, b) for a, b, r in want if r == "contains"] + [(b, a) for a, b, r in want if r == "is_contained"])
    assert rows(classes.supremal_contains(edits, refs), "lhs_id", "rhs_id") == inside
    both = classes.supremal_relations(edits.where("id < 'a30'"), refs, edits.where("id >= 'a30'"))
    assert rows(both, "lhs_id", "rhs_id", "relation") == [w for w in want if w[0] < "a30" <= w[1]]


def test_meeting(spark):
    rng = random.Random(1)
    spans = [(f"s{k:03}", rng.choice("xy"), s, s + rng.choice([0, 1, 3, 40, 700])) for k in range(150) for s in [rng.randrange(600)]]
    df = spark.createDataFrame(spans, "id string, ref_id string, start long, end long")
    touch = lambda a, b: a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]
    got = lambda df: sorted((r["l"]["id"], r["r"]["id"]) for r in df.collect())
    assert got(classes.meeting(df, df, least=2)) == sorted((a[0], b[0]) for a, b in itertools.combinations(spans, 2) if touch(a, b))
    nested = [(a[0], b[0]) for a in spans for b in spans if a[1] == b[1] and a[2] <= b[2] and b[3] <= a[3]]
    assert got(classes.meeting(df, df, ordered=False, least=2, containing=True)) == sorted(nested)


def test_windows_beyond_the_end(spark):
    refs = spark.createDataFrame([("r", "ACGT" * 10), ("e", "")], "ref_id string, sequence string")
    wanted = spark.createDataFrame([("r", 3, 9), ("r", 38, 60), ("r", 70, 90), ("e", 0, 5), ("?", 0, 1)], "ref_id string, low long, high long")
    assert rows(references.with_text(wanted, refs, least=2), "ref_id", "low", "window") == [("e", 0, ""), ("r", 3, "TACGTA"), ("r", 38, "GT"), ("r", 70, "")]


@pytest.mark.parametrize("block", [2, 256])
def test_differences(spark, block):
    rng = random.Random(block)
    pairs = [("".join(rng.choices("ACG", k=rng.randrange(9))), "".join(rng.choices("ACG", k=rng.randrange(9)))) for _ in range(25)]
    pairs += [("ACGT", "ACGT"), ("", ""), pairs[0]]
    table = spark.createDataFrame([(k, a, [(0, len(a), b)]) for k, (a, b) in enumerate(pairs)] + [(98, None, []), (99, "ACG", [(0, 2, ""), (1, 3, "")])], f"id int, reference string, variants {V}")
    fields = "with_subtrahend", "with_remainder", "between"
    text = lambda edits: [(e["start"], e["end"], e["sequence"]) for e in edits]
    got = sorted((r["id"], text(r["subtrahend"]), text(r["remainder"]), *(r[f] for f in fields)) for r in differences.differences(table, block=block).collect())
    want = sorted((k, *([tuple(e) for e in d[n]] for n in ("subtrahend", "remainder")), *(d[f] for f in fields)) for k, (a, b) in enumerate(pairs) for d in align.difference(a, b))
    assert got == want
    for k, subtrahend, remainder, *_ in got:
        # What is taken away makes what lies between two matches, and the rest makes the rest; neither is lost.
        assert subtrahend or remainder or pairs[k][0] == pairs[k][1]


def test_ranges_of_alignments(spark):
    a, b = "AAGTAAGTAAGT", "GTAGTAAGAA"
    df = spark.createDataFrame([(1, a, b), (2, None, b), (3, "A", "A")], "key int, reference string, observed string")
    whole = [[tuple(e) for e in w] for w in align.windowed(a, b).walks()]
    found = expand.paths(df, size=7)
    got = sorted((r["path"], [tuple(e) for e in r["variants"]]) for r in found.where("key = 1").collect())
    assert [n for n, _ in got] == list(range(len(whole))) and [w for _, w in got] == whole
    assert found.where("key = 3").count() == 1 and expand.paths(df, limit=3, size=2).where("key = 1").count() == 3
    at = spark.createDataFrame([((4, 10, "ACGTA"),)], "variant struct<start: bigint, end: bigint, sequence: string>")
    ways = sorted((r["way"], [tuple(e) for e in r["variants"]]) for r in expand.ways(at, size=50).collect())
    assert [w for _, w in ways] == [[tuple(e) for e in w] for w in align.interleavings(align.Edit(4, 10, "ACGTA"))] and len(ways) == 462


def test_a_range_of_very_many_alignments_is_made_alone():
    whole = align.windowed("ACGT" * 12, "TGCA" * 12)
    total = whole.walk_count()
    assert total > 10**9
    (last,) = whole.walks(first=total - 1)
    (middle,) = whole.walks(1, first=total // 2)
    assert align.patched("ACGT" * 12, last) == align.patched("ACGT" * 12, middle) == "TGCA" * 12 and last != middle


def test_equal_texts_and_few_ways_are_dealt_in_whole_batches(spark):
    """Many rows with equal texts, and variants of equal shape, each have all their own alignments and ways."""
    pairs = spark.range(300).selectExpr("id", "'AAGTAAGT' AS reference", "'GTAGAA' AS observed")
    n = align.windowed("AAGTAAGT", "GTAGAA").walk_count()
    assert {r["count"] for r in expand.paths(pairs, size=3).groupBy("id").count().collect()} == {n} and n > 3
    at = spark.range(40).selectExpr("id", "named_struct('start', id, 'end', id + id % 4, 'sequence', substr('ACG', 1, int(id % 3) + 1)) AS variant")
    got = {}
    for r in expand.ways(at).select("id", "way", "variants").collect():
        got.setdefault(r["id"], {})[r["way"]] = [tuple(e) for e in r["variants"]]
    edit = lambda k: align.Edit(k, k + k % 4, "ACG"[: k % 3 + 1])
    assert got == {k: {w: [tuple(e) for e in align.interleaving(edit(k), w)] for w in range(align.forms(edit(k)))} for k in range(40)}
    counted = {r["id"]: r["n"] for r in at.select("id", columns.way_count("variant").alias("n")).collect()}
    assert counted == {k: align.forms(edit(k)) for k in range(40)}


def test_windows_that_differ_in_names_are_told_once():
    align._small.cache_clear()
    for letters in ("ACGT", "TGCA", "CATG", "XYZW"):
        a, b = ("GGATCATCATTT".translate(str.maketrans("ACGT", letters)), "GGATCATTT".translate(str.maketrans("ACGT", letters)))
        told = align.told(a, b)
        assert align.patched(a, [told.spanning]) == b and list(told.units) == sorted(align.Alignments(a, b).unit_edits())
    assert align._small.cache_info().currsize == align._small.cache_info().misses <= 3


def test_summaries_keep_a_window_no_wider_than_the_edit(spark):
    refs = spark.createDataFrame([("r", "ACGTTGCATGCCATGACCAGTCATGACGTACGTTTGACC")], "ref_id string, sequence string")
    one = spark.createDataFrame([("x", "r", [(18, 19, "")])], f"allele_id string, ref_id string, variants {V}")
    (row,) = summaries.summaries(one, refs, fields=relations.NEEDS).collect()
    assert row["shift"] == row["supremal"]["start"] - 1 and len(row["window"]) == row["supremal"]["end"] - row["supremal"]["start"] + 2
    assert not {"canonical", "hgvs", "local_supremal"} & set(row.asDict())


def test_table_functions_of_distinct_texts_reach_all_keys(spark):
    from allelemill.plans import queries

    names = spark.range(8).selectExpr("id AS key", "'AAAT' AS a", "'ATT' AS b")
    found = queries._lateral(spark, names, "SELECT a, b, edge FROM {rows} t, LATERAL edges_of(t.a, t.b)")
    edges = align.windowed("AAAT", "ATT").edges()
    assert sorted((r["key"], tuple(r["edge"])) for r in found.collect()) == sorted((k, tuple(e)) for k in range(8) for e in edges)


def test_unit_edits_meet_as_numbers(spark):
    """Arrays of numbers are hashed; of arrays of structs each element is compared with each."""
    atoms = "array<struct<pos: bigint, symbol: string>>"
    df = spark.createDataFrame([([(3, "A"), (3, ""), (70_000_000_000, "T")], [(3, ""), (3, "C"), (70_000_000_000, "T")]), ([], [(0, "G")])], f"l {atoms}, r {atoms}")
    number = columns.atom_numbers
    got = df.select(columns.overlap("l", "r").alias("s"), columns.overlap(number("l"), number("r")).alias("n"), F.arrays_overlap(number("l"), number("r")).alias("o")).collect()
    assert [(tuple(x["s"]), tuple(x["n"]), x["o"]) for x in got] == [((2, 4), (2, 4), True), ((0, 1), (0, 1), False)]
    told = spark.createDataFrame([], f"allele_id string, ref_id string, atoms {atoms}, shift bigint, window string, error string")
    assert dict(relations.facts(told, "l").dtypes)["l_atoms"] == "array<bigint>"


def test_alleles_with_windows_need_no_join(spark):
    """They are told of where they are: nothing is read of the references unless a spanning edit reaches its window's border."""
    text = "ACGTTGCA" * 3 + "GATTACA" + "A" * 40 + "CC"
    refs = spark.createDataFrame([("r", text)], "ref_id string, sequence string")
    edits = [(3, 5, "G"), (26, 28, ""), (0, 0, "T"), (40, 41, ""), (len(text), len(text), "GG")]
    rows = [(f"{i}", "r", [(i, j, s)], len(text), max(0, i - 16), text[max(0, i - 16) : j + 16]) for i, j, s in edits]
    brought = spark.createDataFrame(rows, f"allele_id string, ref_id string, variants {V}, whole_length long, shift long, window string")
    plain = brought.select("allele_id", "ref_id", "variants")
    want = {repr(r) for r in summaries.summaries(plain, refs).drop("variants", "shift", "window").collect()}
    got = summaries.summaries(brought, refs, windows=False)
    assert {repr(r) for r in got.collect()} == want and got.columns == ["allele_id", "ref_id", *summaries.FIELDS, "error"]
    assert summaries.summaries(brought.where("allele_id != '40'"), None, windows=False).count() == 4


def test_parts_of_binary_references(spark):
    """References of one byte a symbol are patched as binary, with one variant or several."""
    alleles = [[], [(0, 0, "T")], [(2, 5, "")], [(7, 8, "GG")], [(1, 2, "A"), (4, 4, "CC"), (6, 8, "")]]
    rows = spark.createDataFrame([("ACGTACGT", a) for a in alleles], f"s string, v {V}")
    both = rows.select(columns.patch("s", "v").alias("a"), columns.patch(F.col("s").cast("binary"), "v").alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] == ["ACGTACGT", "TACGTACGT", "ACCGT", "ACGTACGGG", "AAGTCCAC"]


def test_nucleotides_of_documents(spark):
    """Letters A to Z alone, of any text, as the SQL has them."""
    from allelemill.plans import derived

    rows = spark.createDataFrame([("Ab-Z é ßıKz\n9",), ("",), (None,)], "t string")
    assert [tuple(r) for r in rows.select(derived.dna("t"), derived.letters("t")).collect()] == [("ACCGC", 5), ("", 0), (None, None)]


def test_long_and_short_rows_pair_once(spark):
    """Whole rows come out of each of the joins, by names and by texts; nothing meets twice."""
    rng = random.Random(5)
    spans = [(f"s{k:03}", rng.choice("xy"), s, s + rng.choice([0, 1, 3, 9, 40, 700]), "A" * rng.choice([0, 0, 1, 2, 50]), k) for k in range(150) for s in [rng.randrange(600)]]
    df = spark.createDataFrame(spans, "id string, ref_id string, start long, end long, sequence string, more int")
    touch = lambda a, b: a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]
    got = lambda df: sorted((tuple(r["l"]), tuple(r["r"])) for r in df.collect())
    for short in (0, 4, 32, 1000):
        assert got(intervals.paired(df, df, least=2, bin_width=8, short=short)) == sorted((a, b) for a, b in itertools.combinations(spans, 2) if touch(a, b))
    nested = sorted((a, b) for a in spans for b in spans if a[1] == b[1] and a[2] <= b[2] and b[3] <= a[3])
    assert got(intervals.paired(df, df, ordered=False, containing=True, short=4)) == nested
    one, two = df.where("more < 60"), df.where("more >= 60")
    assert got(intervals.paired(one, two, ordered=False, short=4)) == sorted((a, b) for a in spans[:60] for b in spans[60:] if touch(a, b))


@pytest.mark.parametrize("compare", ["supremal_relations", "supremal_contains", "relations", "class_relations"])
def test_rows_are_shuffled_once_for_their_pairs(done, spark, compare):
    """The windows of short edits, which are nearly all, go into one shuffle that all joins read; no join of pairs fetches them."""
    _, _, told = done
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(kept, ("false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        if compare in ("relations", "class_relations"):
            found = (relations if compare == "relations" else classes).__dict__[compare](told)
        else:
            found = classes.__dict__[compare](classes.spans(told, windows=True), None)
        plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    binned = [line for line in plan if re.search(r"Exchange hashpartitioning\([lr]_ref#\d+L?, [lr]_bin", line) and "Reused" not in line]
    # One of whole rows, and one of the names of the long ones.
    assert len(binned) == 2, binned
    assert not any("Join [l_key" in line for line in plan)


def test_class_relations_leave_no_summaries(done, spark):
    """Classes are stored with unit edits as numbers, and the summaries' files go once they are."""
    import pathlib

    from allelemill import store
    from allelemill.plans import queries

    folder = pathlib.Path(store.shared_folder(spark))
    names = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    before = names()
    found = queries.class_relations(spark, "/root/testdata/sf0.001")
    assert {name.split("-")[0] for name in names() - before} == {"classes"}
    assert found.count() > 0
    assert dict(classes.classes(done[2]).dtypes)["atoms"] == "array<bigint>"


def test_equal_edits_are_made_one_where_they_are_made(spark):
    """They are of one reference, by which line items and references were dealt: no third shuffle brings their windows together."""
    from allelemill.plans import derived

    for windows in (False, True):
        edits = derived.edits(spark, "/root/testdata/sf0.001", windows)
        plan = edits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 2 and edits.count() == edits.select("ref_id", "vstart", "vend", "seq").distinct().count()
