"""Columns, Arrow functions, readers, writers and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from allelemill.functions import arrow, columns, register
from allelemill.kernel import align
from allelemill.operators import differences, relations, summaries
from allelemill.sources import random as rnd
from allelemill.sources import readers, writers

V = "array<struct<start: bigint, end: bigint, sequence: string>>"


def test_columns(spark):
    rows = spark.createDataFrame([("ACGTACGT", [(3, 4, "T"), (0, 1, "")], [0, 2, 4]), ("ACGT", [(0, 2, "T"), (1, 3, "")], [1]), ("ACGT", [], []), (None, None, None)], f"r string, v {V}, p array<int>")
    got = rows.select(columns.patch("r", "v").alias("o"), columns.allele_error("v").alias("e"), columns.slice_sequence("r", "p").alias("s"), columns.allele_to_hgvs("v", "r").alias("h")).collect()
    assert [x["o"] for x in got] == ["CGTACGT", None, "ACGT", None]
    assert [x["e"] is None for x in got] == [True, False, True, True]
    assert [x["s"] for x in got] == ["ACACGT", "CGT", "", None]
    assert [x["h"] for x in got][2] == "="


def test_trim_matches_kernel(spark):
    pairs = [("AAATAAA", "AAACAAA"), ("", "A"), ("ACGT", "ACGT"), ("AAAA", "AA"), ("ABCD", "XBCD")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", columns.trim("a", "b").alias("t")).collect()
    assert all(tuple(x["t"]) == align.common_ends(x["a"], x["b"]) for x in got)


def test_sql_names(spark):
    register.register(spark)
    row = spark.sql("select edit_distance('CTCGGCATTA', 'GGCTGGCTGT') d, reverse_complement('AACG') r, parse_hgvs('3del').variants[0].start s, parse_hgvs('x').error e").first()
    assert (row["d"], row["r"], row["s"]) == (6, "CGTT", 2) and row["e"].startswith("ValueError")


def brute(refs, alleles):
    seen = {}
    for name, ref, edits in alleles:
        seen[name] = (refs[ref], align.patched(refs[ref], sorted(align.Edit(*e) for e in edits)), ref)
    out = {}
    for a in seen:
        for b in seen:
            if a < b and seen[a][2] == seen[b][2]:
                out[a, b] = align.relation(seen[a][0], seen[a][1], seen[b][1])
    return out


@pytest.fixture(scope="module")
def tables(spark):
    import random

    rng = random.Random(5)
    refs = {f"r{i}": "".join(rng.choices("AC" if i else "ACGT", k=120)) for i in range(3)}
    alleles = []
    for k in range(60):
        at = rng.randrange(110)
        edits = [(at, at + rng.randrange(3), "".join(rng.choices("ACGT", k=rng.randrange(3))))]
        if k % 4 == 0:
            edits.append((at + 5, at + 6, ""))
        alleles.append((f"a{k:02}", f"r{k % 3}", edits))
    return refs, alleles, spark.createDataFrame(list(refs.items()), "ref_id string, sequence string"), spark.createDataFrame(alleles, f"allele_id string, ref_id string, variants {V}")


def test_relations_equal_all_pairs(tables):
    refs, alleles, r, a = tables
    done = summaries.summaries(a, r, pad=2)
    got = {(x["lhs_id"], x["rhs_id"]): x["relation"] for x in relations.all_relations(done, r, bin_width=7).collect()}
    assert got == brute(refs, alleles)
    found = relations.relations(done, r, bin_width=64)
    assert {x["relation"]: x["pairs"] for x in relations.histogram(found).collect()}.keys() <= {"equivalent", "contains", "is_contained", "overlap", "disjoint"}


def test_summary_errors(spark, tables):
    refs, _, r, _ = tables
    bad = spark.createDataFrame([("x", "r0", [(0, 3, "A"), (1, 2, "")]), ("y", "r0", [(119, 130, "")]), ("z", "r0", [])], f"allele_id string, ref_id string, variants {V}")
    got = {x["allele_id"]: x for x in summaries.summaries(bad, r).collect()}
    assert "overlap" in got["x"]["error"] and "range" in got["y"]["error"]
    assert got["z"]["error"] is None and got["z"]["distance"] == 0 and got["z"]["canonical"] == []


def test_failed_alleles_stay_visible(spark):
    r = spark.createDataFrame([("r", "ACGTACGTTTACG")], "ref_id string, sequence string")
    a = spark.createDataFrame([("x", "r", [(1, 2, "")]), ("y", "r", [(0, 3, "A"), (1, 2, "")]), ("z", "r", [(1, 2, "")])], f"allele_id string, ref_id string, variants {V}")
    done = summaries.summaries(a, r)
    want = {("x", "z", "equivalent"), ("y", None, None)}
    assert {(x["lhs_id"], x["rhs_id"], x["relation"]) for x in relations.relations(done, r).collect()} == want
    assert {(x["lhs_id"], x["rhs_id"], x["relation"]) for x in relations.all_relations(done, r).collect()} == want


def test_compare_flavours(spark):
    df = spark.createDataFrame([("CATATATC", [(7, 7, "AT")], [(5, 5, "T")])], f"reference string, lhs {V}, rhs {V}")
    want = align.relation("CATATATC", "CATATATATC", "CATATTATC")
    assert relations.compare_alleles(df).first()["relation"] == want
    s = df.select("reference", arrow.supremal("reference", columns.patch("reference", "lhs")).alias("lhs"), arrow.supremal("reference", columns.patch("reference", "rhs")).alias("rhs"))
    assert relations.compare_supremals(s).first()["relation"] == want


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\n\nGG\n")
    assert {tuple(x) for x in readers.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {("one", "ACGTAC"), ("two", "GG")}
    assert readers.read_fasta(spark, str(tmp_path / "a.fa"), merge=True).first()["sequence"] == "ACGTACGG"
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\nchr1\t3\t.\tAC\tA,T\t9\n")
    got = readers.read_vcf(spark, str(tmp_path / "a.vcf")).select(F.explode("variants").alias("v")).select("v.*").collect()
    assert {tuple(x) for x in got} == {(2, 4, "A"), (2, 4, "T")}
    assert readers.read_vcf(spark, str(tmp_path / "a.vcf"), False).first()["variants"][0]["sequence"] == "A,T"
    (tmp_path / "labels.txt").write_text("x 3del\ny 3insA\n")
    got = {x["allele_id"]: x for x in readers.read_labels(spark, str(tmp_path / "labels.txt")).collect()}
    assert got["x"]["variants"][0]["start"] == 2 and got["y"]["error"].startswith("ValueError")
    pairs = spark.createDataFrame([("a", "b", "overlap", 1, 3), ("a", "c", "disjoint", None, None)], "lhs_id string, rhs_id string, relation string, common int, universe int")
    writers.write_relations(pairs, str(tmp_path / "out"))
    assert {x["value"] for x in spark.read.text(str(tmp_path / "out")).collect()} == {"a b overlap 1 3", "a c disjoint"}
    alleles = spark.createDataFrame([("x", "R", "CATATATC", "CATATATATC")], "allele_id string, ref_id string, reference string, observed string")
    writers.write_normalised(differences.extract(alleles), str(tmp_path / "norm"))
    assert spark.read.text(str(tmp_path / "norm")).first()["value"] == "x R:g.2_7AT[4] R:1:6:ATATATAT"
    writers.write_dot(alleles, str(tmp_path / "dot"))
    assert spark.read.text(str(tmp_path / "dot")).first()["value"] == "digraph{"


def test_random(spark):
    rows = rnd.random_sequences(spark, 200, 30, 3, seed=1).collect()
    assert rows == rnd.random_sequences(spark, 200, 30, 3, seed=1).collect()
    assert {len(x["sequence"]) for x in rows} <= set(range(3, 31)) and set("".join(x["sequence"] for x in rows)) == set("ACGT")
    skewed = rnd.random_sequences(spark, 50, 30, weights=[0, 1, 0, 0], seed=1).collect()
    assert set("".join(x["sequence"] for x in skewed)) <= {"C"}
    for seed in range(100):
        edits = [align.Edit(**e) for e in rnd.random_allele("ACGTACGTAC", seed, 0.4, 2, 2)]
        assert all(a.end < b.start for a, b in zip(edits, edits[1:]))
        assert all(e.end - e.start or e.sequence for e in edits)
        assert all(x != "ACGTACGTAC"[e.start + i] for e in edits for i, x in enumerate(e.sequence[: e.end - e.start]))


def normalised_stream(spark, tmp_path, rows, refs):
    from allelemill.streaming import normalised

    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "allele_id string, ref_id string, hgvs string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("allele_id string, ref_id string, hgvs string").parquet(str(tmp_path / "in"))
    run = normalised(stream, spark.createDataFrame(refs, "ref_id string, sequence string")).writeStream.format("memory").queryName("norm").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    return {x["allele_id"]: x for x in spark.table("norm").collect()}


def test_stream(spark, tmp_path):
    got = normalised_stream(spark, tmp_path, [("x", "R", "3GA[3]"), ("y", "R", "oops"), ("z", "R", "[1del;3del]"), ("u", "R", "99del")], [("R", "TTGAGAGAGATT")])
    assert got["x"]["canonical_hgvs"] == "3_10GA[3]" and got["y"]["error"] is not None
    assert got["z"]["supremal"] is not None and got["u"]["error"].startswith("ValueError")


@pytest.mark.parametrize("repeats", [10, 200, 3000, 10_000])
def test_stream_of_alleles_in_long_repeats(spark, tmp_path, repeats):
    """The spanning edit of a lost copy is the whole repeat, which exceeds windows of 32, 512 and 8,192 in turn."""
    before, body = "ACGGTTCAGATTACA" * 50, "CA" * repeats
    reference = before + "G" + body + "TTT" + before
    at = len(before) + 1
    got = normalised_stream(spark, tmp_path, [("x", "R", f"{at + repeats + 1}_{at + repeats + 2}del")], [("R", reference)])["x"]
    assert got["error"] is None and (got["supremal"]["start"], got["supremal"]["end"]) == (at, at + 2 * repeats)
    assert got["canonical_hgvs"] == f"{at + 1}_{at + 2 * repeats}CA[{repeats - 1}]"


def test_table_functions(spark):
    register.register(spark)
    spark.createDataFrame([(1, "AAAT", "ATT"), (2, None, "A"), (3, "A", "A")], "key int, a string, b string").createOrReplaceTempView("pairs")
    whole = align.windowed("AAAT", "ATT")
    edits = lambda vs: [align.Edit(*v) for v in vs]
    got = spark.sql("SELECT key, path, variants FROM pairs t, LATERAL paths_of(t.a, t.b)").collect()
    assert [edits(r["variants"]) for r in sorted(got, key=lambda r: r["path"]) if r["key"] == 1] == list(whole.walks())
    assert [r["variants"] for r in got if r["key"] == 3] == [[]] and not [r for r in got if r["key"] == 2]
    assert sorted(tuple(r["edge"]) for r in spark.sql("SELECT edge FROM pairs t, LATERAL edges_of(t.a, t.b)").collect()) == sorted(map(tuple, whole.edges()))
    steps = spark.sql("SELECT s.* FROM pairs t, LATERAL steps_of(t.a, t.b, true) s").collect()
    assert len(steps) == sum(align.forms(e) for _, _, e in whole.steps() if e.start < e.end or e.sequence)
    ways = spark.sql("SELECT variants FROM ways_of(1, 3, 'AC') ORDER BY way").collect()
    assert [edits(r["variants"]) for r in ways] == list(align.interleavings(align.Edit(1, 3, "AC")))
    apart = spark.sql("SELECT between FROM pairs t, LATERAL differences_of(t.a, t.b) WHERE key = 1").collect()
    assert sorted(r["between"] for r in apart) == sorted(d["between"] for d in align.difference("AAAT", "ATT"))
