import json

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import chem, geometry, text
from sparkassay.operators import joins
from sparkassay.sources import scan, sinks


def test_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿SMILES,TARGET\nCCO,1.5\nC,abc\n".encode())
    df = scan.csv_tolerant(spark, str(tmp_path / "a.csv"), ["TARGET"])
    assert df.columns == ["SMILES", "TARGET"] and [r.TARGET for r in df.collect()] == [1.5, None]
    (tmp_path / "b.csv").write_text("m1,1.0,NaN\nm2,x,2.0\n")
    rows = scan.csv_named(spark, str(tmp_path / "b.csv"), "id string, a double, b double").collect()
    assert [(r.id, r.a, r.b) for r in rows] == [("m1", 1.0, None), ("m2", None, 2.0)]
    assert scan.resolve_columns(["Smiles", "n", "mean"]) == ("Smiles", "mean")
    assert scan.resolve_columns(["smiles", "split", "weird"]) == ("smiles", "weird")
    with pytest.raises(ValueError):
        scan.resolve_columns(["x"])


def test_json_map_and_reports(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": "x", "b": "y"}, indent=1))
    assert {(r.key, r.value) for r in scan.json_map(spark, str(tmp_path / "m.json")).collect()} == {("a", "x"), ("b", "y")}
    (tmp_path / "r").mkdir()
    (tmp_path / "r/1.json").write_text('{"name": "one",\n "folds": [{"e": 2}, {"e": 4}]}')
    (tmp_path / "r/2.json").write_text('{"name": "two", "folds": []}')
    (tmp_path / "r/3.json").write_text('{"name": broken')
    df = scan.json_reports(spark, str(tmp_path / "r"), "name string, folds array<struct<e:double>>").cache()
    good = {r.name: r.e_mean for r in scan.mean_of_reports(df.where("_corrupt_record IS NULL"), "folds", "e").collect()}
    assert good == {"one": 3.0, "two": 0.0} and df.where("_corrupt_record IS NOT NULL").count() == 1


def test_files_by_name(spark, tmp_path):
    for n in ("Data_tox_20240101.csv", "Data_Tox_20240301.csv", "Data_sol_20250101.csv", "x_report.csv"):
        (tmp_path / n).write_text("smiles\nC\n")
    files = scan.list_files(spark, str(tmp_path), "*.csv")
    assert scan.newest(files, "TOX").first().path.endswith("Data_Tox_20240301.csv")
    assert scan.datasets(files).count() == 3 and scan.datasets(files, only=["Data_sol_20250101"]).count() == 1
    for k, part in ((1, "train"), (2, "test")):
        (tmp_path / "f").mkdir(exist_ok=True)
        (tmp_path / f"f/cv{k}_{part}.csv").write_text("SMILES,TARGET\nC,1\n")
    assert {(r.fold, r.part) for r in scan.fold_files(spark, str(tmp_path / "f")).collect()} == {(1, "train"), (2, "test")}
    (tmp_path / "s.smi").write_text("CCO name\n\n  C\tx\n")
    assert [r.value for r in scan.token_list(spark, str(tmp_path / "s.smi")).collect()] == ["CCO", "C"]


RECORD = """water
  tool

  3  2  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.1000 O   0  0
    0.7600    0.0000   -0.4800 H   0  0
   -0.7600    0.0000   -0.4800 H   0  0
  1  2  1  0
  1  3  1  0
M  END
> <energy>
-76.4

$$$$
"""


def test_structure_files_round_trip(spark, tmp_path):
    (tmp_path / "a.sdf").write_text(RECORD + "broken\n$$$$\n" + RECORD.replace("water", "again"))
    df = scan.structure_records(spark, str(tmp_path / "a.sdf"))
    rows = df.collect()
    assert [r.title for r in rows] == ["water", "again"] and rows[0].properties == {"energy": "-76.4"}
    assert [a.element for a in rows[0].atoms] == ["O", "H", "H"] and rows[0].bonds[1].dst == 3
    sinks.structure_text(df, "title", "atoms", "bonds", "properties").write.text(str(tmp_path / "out"))
    back = scan.structure_records(spark, str(tmp_path / "out")).collect()
    assert sorted((r.title, r.atoms, r.bonds, r.properties) for r in back) == sorted((r.title, r.atoms, r.bonds, r.properties) for r in rows)
    (tmp_path / "x.xyz").write_text("2\nh2\nH 0 0 0\nH 0 0 0.74\n")
    one = scan.xyz_structures(spark, str(tmp_path / "x.xyz")).first()
    assert one.title == "h2" and one.atoms[1].z == 0.74
    assert sinks.xyz_text(scan.xyz_structures(spark, str(tmp_path / "x.xyz")), "title", "atoms").first().value.startswith("2\nh2\nH 0.000000")


def test_staged_overwrite(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(5).write.parquet(at)
    df = spark.read.parquet(at).where("id > 1")
    sinks.replace_table(df, at, dry_run=True)
    assert spark.read.parquet(at).count() == 5
    sinks.replace_table(df, at)
    assert spark.read.parquet(at).count() == 3 and spark.read.parquet(at + ".bak").count() == 5
    sinks.write_folds(spark.range(4).selectExpr("id", "id % 2 AS fold", "'test' AS part"), str(tmp_path / "folds"))
    assert (tmp_path / "folds/fold=0/part=test").is_dir()
    assert not sinks.is_fresh(spark, at, str(tmp_path / "none")) and sinks.is_fresh(spark, at + ".bak", at)
    assert "| 3 |" in sinks.markdown(spark.range(3, 4), "t")
    log = sinks.append_log(spark.createDataFrame([(1, "x")], "k int, extra string"), spark.createDataFrame([(2,)], "k int"))
    assert {(r.k, r.extra) for r in log.collect()} == {(1, "x"), (2, None)}


def test_log_records(spark):
    lines = ["Hf for A is 1.5 kJ/mol", "Hf for A is 2e0 kJ/molS0 for A is 3 J/K", "Hf for A is 4 kcal noise", "noise", "S0 for x is y is -5 J/K", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    got = [(r.line_no, r.pos, r.name, r.key, r.value, r.ok) for r in text.log_records(df, {"Hf": "kJ/mol", "S0": "J/K"}).orderBy("line_no", "pos").collect()]
    assert got[:4] == [(0, 0, "Hf", "A", 1.5, True), (1, 0, "Hf", "A", 2.0, True), (1, 1, "S0", "A", 3.0, True), (2, 0, "Hf", "A", 4.0, False)]
    t = spark.createDataFrame([(0.0001, "a<b>:c", "1.0"), (None, None, "x")], "x double, n string, f string")
    assert [tuple(r) for r in t.select(text.number_text(F.col("x")), text.safe_name(F.col("n")), text.flag("f"), text.int_or("f")).collect()] == [("1.00e-04", "a_b__c", True, -1), ("-", None, True, -1)]


def test_notation_facts(spark):
    rows = ["CCO", "c1ccccc1", "[13CH4]", "CC.O", "[NH4+].[Cl-]", "C1CC", "", None, "[Fe+3]", "C(C", "ClCBr"]
    df = spark.createDataFrame([(r,) for r in rows], "s string").select("s", chem.notation_facts("s").alias("f"))
    got = {r.s: r.f for r in df.collect()}
    assert got["CCO"].n_atoms == 3 and got["c1ccccc1"].n_rings == 1 and got["c1ccccc1"].n_aromatic == 6
    assert got["[13CH4]"].has_isotope and got["CC.O"].n_fragments == 2 and got["[NH4+].[Cl-]"].net_charge == 0
    assert not any(got[s].valid for s in ("C1CC", "", None, "C(C")) and got["ClCBr"].elements == ["Cl", "C", "Br"]


def test_molecules(spark):
    """Values that follow from the structures; the same graph written otherwise has the same key."""
    from sparkassay.functions.molecule import describe, FIELDS, fingerprint, graph_key, molecule, read_molecule, rejection_checks
    from sparkassay.operators.clean import reject_reason

    names = [p.split()[0] for p in FIELDS.split(", ")]
    one = lambda s: dict(zip(names, describe(s)))
    aspirin = one("CC(=O)Oc1ccccc1C(=O)O")
    assert (aspirin["n_heavy"], aspirin["n_hydrogens"], aspirin["n_rings"], aspirin["n_donors"], aspirin["n_acceptors"], aspirin["n_rotatable"]) == (13, 8, 1, 1, 4, 3)
    assert abs(aspirin["weight"] - 180.159) < 0.01 and abs(aspirin["frac_sp3"] - 1 / 9) < 1e-9
    assert abs(one("Cn1c(=O)c2c(ncn2C)n(C)c1=O")["weight"] - 194.194) < 0.01
    assert one("O=C1CCCC1c1ccccc1")["n_aliphatic_rings"] == 1 and one("c1ccc2ccccc2c1")["n_rings"] == 2
    for same in (["CCO", "OCC", "C(O)C"], ["c1ccccc1C", "Cc1ccccc1", "c1cc(C)ccc1"], ["C1CC1N", "NC1CC1"]):
        assert len({graph_key(read_molecule(s)) for s in same}) == 1 and len({tuple(fingerprint(read_molecule(s))) for s in same}) == 1
    assert one("CCc1ccccc1")["scaffold"] == one("Oc1ccccc1")["scaffold"] == one("c1ccccc1")["scaffold"] != one("C1CCCCC1")["scaffold"]
    assert [one(s)["status"] for s in ("C(C)(C)(C)(C)C", "C1CC", "C..C", "CC.O", "CC", "C()C", None, "c1ccncc1", "C[N+](=O)[O-]")] == [1, 0, 0, 4, 5, 0, 0, 5, 5]
    assert [one(s)["n_radicals"] for s in ("[CH3]", "[O]", "[NH4+]", "[CH3-]", "[OH-]", "[Cl-]", "[BH4-]", "[nH]1cccc1")] == [1, 2, 0, 0, 0, 0, 0, 0]
    rows = [None, "nan", " ", "C(C", "[CH3]", "[13CH4]", "CC.O", "[Na+]", "[O-2]", "CCO", "C(C)(C)(C)(C)C"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").withColumn("f", molecule("s"))
    why = [r.w for r in df.select("i", reject_reason(rejection_checks("f", "s", chem.ELEMENTS)).alias("w")).orderBy("i").collect()]
    assert why == ["empty", "empty", "empty", "unparsable", "radical", "isotope", "disconnected", "element", "charge", None, "unparsable"]


def test_stability_and_codes(spark):
    rows = [("C", 1, 3, True), ("C", 0, 3, True), ("C", 0, 2, False), ("N", 0, 2, True), ("N", 1, 4, True), ("Hg", 0, 1, True), ("Bi", 0, 5, True), ("S", 0, 4, False), ("S", 2, 4, True),
            ("Cl", 1, 1, True), ("Br", 1, 2, True), ("F", -1, 0, True), ("Xe", 0, 0, False), (None, 0, 1, False), ("O", 2, 2, False)]
    df = spark.createDataFrame(rows, "e string, q int, v int, want boolean")
    assert df.where(chem.stable(F.col("e"), F.col("q"), F.col("v")) != F.col("want")).count() == 0
    codes = df.select("e", "q", chem.decode(chem.encode(F.col("e"))).alias("e2"), chem.decode_charge(chem.encode_charge(F.col("q"))).alias("q2")).collect()
    assert all(r.e2 == (r.e if r.e in chem.ELEMENTS else None) and r.q2 == r.q for r in codes)


def test_assignment():
    import itertools

    import numpy as np

    from sparkassay.functions import geometry

    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6):
        for _ in range(20):
            cost = rng.integers(0, 9, (n, n)).astype(float)
            got = geometry.assignment(cost)
            assert sorted(got) == list(range(n))
            assert cost[np.arange(n), got].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"name {i}", i * 0.5) for i in range(40)], "id long, name string, x double").repartition(5)
    sinks.write_aligned(df, str(tmp_path / "a"), "id", ["id"], 3)
    ids = [int(r.value) for r in spark.read.text(str(tmp_path / "a.list")).collect()]
    lists, tables = ([sorted(p.name for p in (tmp_path / f"a.{k}").glob("part-*"))] for k in ("list", "csv"))
    assert sorted(ids) == list(range(40)) and len(lists[0]) == len(tables[0])
    for one, two in zip(sorted((tmp_path / "a.list").glob("part-*")), sorted((tmp_path / "a.csv").glob("part-*"))):
        rows = [line.split(",")[0] for line in two.read_text().splitlines()[1:]]
        assert one.read_text().split() == rows
    stats = sinks.write_json(df, str(tmp_path / "j"), n=F.count(F.lit(1)), total=F.sum("x"))
    assert tuple(stats.first()) == (40, 390.0) and spark.read.json(str(tmp_path / "j")).count() == 40
    df.write.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in sinks.copy_snapshot(spark, {"t": str(tmp_path / "t")}, str(tmp_path / "snap")).collect()] == [("t", 40, 3)]
    sinks.alias_views(spark, {"aliased": str(tmp_path / "t")})
    assert spark.sql("SELECT count(*) FROM aliased").first()[0] == 40


def test_geometry(spark):
    import numpy as np

    p = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame([((1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 2.0, 3.0))], f"a {p}, b {p}, c {p}, d {p}")
    c = [F.col(x) for x in "abcd"]
    r = df.select(geometry.distance(c[0], c[2]), geometry.angle(*c[:3]), geometry.dihedral(*c)).first()
    assert np.allclose([r[0], r[1], abs(r[2])], [5**0.5, 90.0, 90.0])
    rng = np.random.default_rng(1)
    a = rng.normal(size=(7, 3))
    turn = geometry.quaternion_matrix(rng.normal(size=4))
    assert np.allclose(turn @ turn.T, np.eye(3)) and geometry.kabsch(a, a @ turn.T + 5)[2] < 1e-9
    assert spark.createDataFrame([(350.0, 10.0)], "a double, b double").select(geometry.circular(F.col("a"), F.col("b"))).first()[0] == 20.0


def test_fallback_and_alias_joins(spark):
    labels = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    df = spark.createDataFrame([(1, "a", "b"), (2, "x", "b"), (3, "x", "y"), (4, None, "a")], "i int, p string, q string")
    got = {r.i: (r.matched_key, r.v) for r in joins.fallback_join(df, labels, "k", [F.col("p"), F.col("q")], ["v"]).collect()}
    assert got == {1: (0, 1.0), 2: (1, 2.0), 3: (None, None), 4: (1, 1.0)}
    index = spark.createDataFrame([("c", "a"), ("b", "a"), ("d", "c"), ("e", "zz")], "a string, t string")
    assert {(r.k, r.v) for r in joins.expand_aliases(labels, index, "k", "a", "t").collect()} == {("a", 1.0), ("b", 2.0), ("c", 1.0)}
    assert {(r.k, r.v) for r in joins.close_aliases(labels, index, "k", "a", "t").collect()} == {("a", 1.0), ("b", 2.0), ("c", 1.0), ("d", 1.0)}
    pts = spark.createDataFrame([(1, 0.5), (2, 7.0)], "i int, x double")
    rng = spark.createDataFrame([("r", 0.0, 1.0), ("s", 0.4, 9.0)], "n string, lo double, hi double")
    assert {(r.i, r.n) for r in joins.range_join(pts, rng, "x", "lo", "hi", 2.0).collect()} == {(1, "r"), (1, "s"), (2, "s")}


def test_numbers_read_as_in_c(spark, tmp_path):
    from sparkassay.plans.molecules import number_texts

    rows = [(1, -33.65), (2, 14.85), (3, None), (4, float("nan")), (5, 0.0), (6, 9999.99), (7, 625000.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.s_suppkey: r.shown for r in number_texts(spark, str(tmp_path)).collect()}
    assert got == {1: "-3.36e-06", 2: "1.48e-06", 3: None, 4: "nan", 5: "0.000", 6: "1.00e-03", 7: "0.062"}
