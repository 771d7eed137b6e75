import pytest
from pyspark.sql import functions as F

from posemill.functions import chemistry
from posemill.operators import residues
from posemill.sources import materialize as M
from posemill.sources import textfiles as T
from posemill.sources.rejects import parse_mol2, read_fingerprint_lines, read_mol2_records

NAME = "m1_stereo1_ion1_tau1_pose2"
SDF = f"{NAME}\n  tool\n\n  0  0\nM  END\n> <energy>\n-3.5\n\n> <note>\nhello\n\n$$$$\n{NAME}\n\n\nM  END\n> <energy>\n-4.5\n\n$$$$\n"
MOL2 = """@<TRIPOS>MOLECULE
{name}
 3 2 1 0 0
SMALL
GASTEIGER
Energy: {energy}

@<TRIPOS>ATOM
# comment
 1  C1  0.0  0.0  0.0  C.3  1  LIG  0.1
 2  N1  1.0  0.0  0.0  N.3  1  LIG  -0.1

 3  O1  0.0  2.0  0.0  O.3  1  LIG  {charge}
@<TRIPOS>BOND
 1  1  2  1
 2  1  {end}  1
"""


def mol(name=NAME, energy="-1.5", charge="0.0", end="3"):
    return MOL2.format(name=name, energy=energy, charge=charge, end=end)


def line(name, counts):
    return ",".join([name, *map(str, counts)])


def plec(spark, texts, n=4):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "line_id long, raw string, reason string")
    loaded, rejected = read_fingerprint_lines(df, "line_id", "raw", n)
    return {r["line_id"]: r for r in loaded.collect()}, {r["line_id"]: r["reason"] for r in rejected.collect()}


def test_fingerprint_reasons(spark):
    ok = f"{NAME}_frm1"
    texts = [
        line(ok, [0, 1, 2, 255]), line(f'"{ok.upper()}"', [" 1", "2 ", "007", 0]), line(ok, [1, 2, 3]), line(ok, [1, 2, 3, 256]), line(ok, [1, 2, 3, "+4"]),
        line(ok, [1, "", 3, 4]), line(f'"{ok}', [1, 2, 3, 4]), line(f'"{ok}" ', [1, 2, 3, 4]), line(f'a"{ok}', [1, 2, 3, 4]), line("m1_pose2_frm1", [1, 2, 3, 4]),
        "complex_name,0,1,2,3", "", "   ", None, line(f'"a,""b{ok}"', [1, 2, 3, 4]), line(ok, [1, 2, 3, '"4"']), line(f"a b{ok}", [1, 2, 3, 4]), line(ok, [0, 1, 2, 255]),
    ]
    loaded, rejected = plec(spark, texts)
    assert rejected == {2: "column_count", 3: "bad_value", 4: "bad_value", 5: "bad_value", 6: "quoting", 7: "quoting", 8: "quoting", 9: "bad_name", 16: "bad_name"}
    assert sorted(loaded) == [0, 1, 14, 15, 17]
    assert loaded[1]["complex_name"] == ok and list(loaded[1]["counts"]) == [1, 2, 7, 0] and loaded[14]["complex_name"] == f'a,"b{ok}'
    assert list(loaded[15]["counts"]) == [1, 2, 3, 4]


def test_fingerprint_lines_long_and_none(spark):
    loaded, rejected = plec(spark, ['"' + 'a""' * 200_000, "x," * 300_000, '"' * 100_001])
    assert not loaded and set(rejected.values()) <= {"quoting", "column_count"} and len(rejected) == 3
    assert plec(spark, []) == ({}, {})


def test_mol2_reasons(spark):
    texts = [
        mol(), mol(energy="nan"), mol(energy=""), mol().replace("\n", "\r\n"), mol().replace("@<TRIPOS>BOND", "@<TRIPOS>BONDS"), mol(name="m1"), mol(charge="0.0 7"),
        mol(energy="1,5"), mol(end="4"), mol(charge="inf"), mol().replace(" 3 2 1", " 3 3 1"), None, "", mol().replace(" 3 2 1", " x 2 1"), mol() + "@<TRIPOS>SUBSTRUCTURE\n 1 LIG 1\n",
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "record_id long, raw string, atoms int")
    loaded, rejected = read_mol2_records(df, "record_id", "raw")
    assert {r["record_id"]: r["reason"] for r in rejected.collect()} == {
        4: "missing_section", 5: "bad_name", 6: "column_count", 7: "bad_value", 8: "bad_value", 9: "bad_value", 10: "count_mismatch", 11: "missing_section", 12: "missing_section", 13: "bad_value",
    }
    good = {r["record_id"]: r for r in loaded.collect()}
    assert sorted(good) == [0, 1, 2, 3, 14] and good[0]["energy"] == -1.5 and good[1]["energy"] is None and len(good[14]["bonds"]) == 2
    assert read_mol2_records(df.limit(0), "record_id", "raw")[0].count() == 0


def test_mol2_counts_and_numbers_the_lenient_reader_takes(spark):
    texts = [
        mol().replace(" 3 2 1", " 3.5 2 1"), mol().replace(" 3 2 1", " 3.0 2 1"), mol(charge="0.1f"), mol(charge="0x1p3"), mol(charge="Infinity"), mol(charge='"0.1"'),
        mol().replace("  C1 ", '  "C1 '), mol(charge="1e400"), mol(charge="1.e-3"), mol().replace(" 3 2 1", " 3 1.5 1").replace("C1", "#C1"),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, raw string")
    loaded, rejected = read_mol2_records(df, "record_id", "raw")
    assert {r["record_id"]: r["reason"] for r in rejected.collect()} == dict.fromkeys([0, 2, 3, 4, 5, 7, 9], "bad_value")
    good = {r["record_id"]: r for r in loaded.collect()}
    assert sorted(good) == [1, 6, 8] and good[6]["atoms"][0]["name"] == '"C1' and good[8]["atoms"][2]["charge"] == 0.001


def test_structure_descriptors(spark):
    parsed = parse_mol2(spark.createDataFrame([(1, mol())], "record_id long, raw string"), "record_id", "raw")
    r = parsed.select(chemistry.molecular_weight("atoms").alias("mw"), chemistry.heavy_atoms("atoms").alias("h"), chemistry.heteroatoms("atoms").alias("x"), chemistry.rmsd("atoms", "atoms").alias("d"), *[c.alias(n) for n, c in chemistry.bond_type_counts("bonds").items()]).first()
    assert r["mw"] == pytest.approx(12.011 + 14.007 + 15.999) and (r["h"], r["x"], r["d"], r["bondType_1"], r["bondType_ar"]) == (3, 2, 0.0, 2, 0)
    s = chemistry.shape_descriptors(parsed, "id", "atoms").first()
    assert s["pmi1"] + s["pmi2"] == pytest.approx(s["pmi3"]) and 0 <= s["asphericity"] <= 1
    assert list(chemistry.rotor_groups(parsed, "id", "atoms", "bonds").first()["histogram"])[:2] == [1, 0]
    assert chemistry._bridges([(1, 2), (2, 3), (3, 1), (3, 4)]) == {3} and chemistry._component_sizes([(1, 2), (2, 3), (7, 8)]) == [1, 2]


def test_conversion_files_and_properties(spark, tmp_path):
    raw = spark.createDataFrame([(1, mol()), (2, mol(energy="-9")), (3, "broken")], "record_id long, raw string")
    parsed = parse_mol2(raw, "record_id", "raw")
    sdf = {r["id"]: r["sdf"] for r in T.mol2_to_sdf(parsed).collect()}
    assert sorted(sdf) == [1, 2] and "  3  2  0" in sdf[1] and "> <Energy>\n-1.5\n" in sdf[1]
    (tmp_path / "x.sdf").write_text("".join(sdf.values()))
    again = T.sdf_records(spark, str(tmp_path / "x.sdf"))
    assert again.count() == 2 and {r["value"] for r in T.sdf_properties(again, ["Energy"]).collect()} == {"-1.5", "-9.0"}
    assert [r["id"] for r in T.lowest_variants(parsed).collect()] == [2]
    assert T.list_files(spark, str(tmp_path), "*.sdf").count() == 1
    poses = spark.createDataFrame([("m1_stereo1_ion1_tau1", 2), ("q", 1)], "n string, p int")
    props = spark.createDataFrame([(NAME, 5)], "molname string, v int")
    assert sorted((r["n"], r["v"]) for r in T.attach_conformer_property(poses, props, "n", "p").collect()) == [("m1_stereo1_ion1_tau1", 5), ("q", None)]


def test_sdf(spark, tmp_path):
    p = tmp_path / "a.sdf"
    p.write_text(SDF)
    records = T.read_structures(spark, str(p))
    assert [r["molname"] for r in records.collect()] == [NAME, NAME]
    props = {(r["property"], r["value"]) for r in T.sdf_properties(records, ["energy", "note"], {"note": "none"}).collect()}
    assert props == {("energy", "-3.5"), ("energy", "-4.5"), ("note", "hello"), ("note", "none")}
    c = T.conformers(records, "energy").first()
    assert c["n_conformers"] == 2 and list(c["energies"]) == [-4.5, -3.5] and c["conf_energy"] == "0:-4.5|1:-3.5"


def test_mol2_smiles_and_dispatch(spark, tmp_path):
    (tmp_path / "a.mol2").write_text(mol() + mol(energy="-9"))
    parsed = parse_mol2(T.read_structures(spark, str(tmp_path / "a.mol2")).withColumn("i", F.monotonically_increasing_id()), "i", "raw_text")
    low = T.lowest_energies(parsed).first()
    assert (low["molname"], low["n_records"], low["min_energy"]) == (NAME, 2, -9.0)
    (tmp_path / "b.smi").write_text("CC ethane\nC\n# no\nCO\n")
    assert sorted(r["molname"] for r in T.read_structures(spark, str(tmp_path / "b.smi")).collect()) == ["ethane", "unk1", "unk2"]
    with pytest.raises(ValueError):
        T.read_structures(spark, "c.pdbx")


def test_tables(spark, tmp_path):
    (tmp_path / "act.txt").write_text("# head\nMol1  1\n\nmol2\t0 # late\nmol3\n")
    assert sorted((r[0], r[1]) for r in T.read_activities(spark, str(tmp_path / "act.txt")).collect()) == [("mol1", 1), ("mol2", 0), ("mol3", None)]
    (tmp_path / "q.txt").write_text("#molname stereo ion tau frame pose E c l p\nM1 1 2 3 1 7 -1.5 -9 nan 4\n")
    q = T.read_qm_scores(spark, str(tmp_path / "q.txt"), "P6C", "prot", header=False).first()
    assert q["structvar"] == "m1_stereo1_ion2_tau3" and q["P6C_Eint"] == -1.5 and q["pose"] == 7
    (tmp_path / "g.csv").write_text(f"molname,r_i_docking_score\n{NAME.upper()},-7.5\n")
    g = T.read_properties(spark, str(tmp_path / "g.csv"), {"r_i_docking_score": "double"}).first()
    assert (g["basemolname"], g["pose"], g["r_i_docking_score"]) == ("m1", 2, -7.5)
    (tmp_path / "n.csv").write_text("a,b\nM1,2\n")
    assert tuple(T.read_net_charges(spark, {"P": str(tmp_path / "n.csv")}).first()) == ("P", "m1", 2)
    (tmp_path / "e.csv").write_text(f"molname,Energy:\n{NAME},-2\n{NAME[:-1]}1,-5\nbad,-9\n")
    e = T.free_ligand_minima(spark, str(tmp_path / "e.csv")).first()
    assert (e["min_Energy"], e["best_molname"]) == (-5.0, f"{NAME[:-1]}1")
    (tmp_path / "f.csv").write_text("complex_name,0,1,2\nA_x,1,2,3\nB,1,,3\n")
    f = T.read_fingerprints(spark, str(tmp_path / "f.csv"), "complex_name", 3).collect()
    assert len(f) == 1 and f[0]["complex_name"] == "a_x" and list(f[0]["fp"]) == [1, 2, 3]
    (tmp_path / "c.log").write_text("x\nAUC-ROC = 0.5\nAUC-ROC = 0.7\nMK: 0.1\n")
    log = T.scrape_metrics(spark, str(tmp_path / "c.log")).first()
    assert log["AUC-ROC"] == 0.7 and log["MK"] == 0.1 and log["DOR"] is None
    assert T.incomplete_files(spark, str(tmp_path / "c.log")).first()["n_lines"] == 4
    (tmp_path / "p.pdb").write_text("ATOM      1  CA  ALA A   1\nHETATM    2  C1  LIG A   2\nEND\n")
    assert sorted(r["part"] for r in T.pdb_parts(spark, str(tmp_path / "p.pdb"), "LIG").collect()) == ["ligand", "receptor"]


def test_decomposition(spark, tmp_path):
    values = ",".join(f"{i}.0" for i in range(18))
    (tmp_path / "d.csv").write_text(f"Total Energy Decomposition:\nResid 1,Resid 2\nALA 1,LIG 9,{values}\nALA 1,GLY 2,{values}\n")
    rows = T.read_decomposition(spark, str(tmp_path / "d.csv")).collect()
    assert len(rows) == 6 and rows[0]["section"] == "Total Energy Decomposition" and (rows[1]["mean"], rows[1]["stdev"], rows[1]["stderr"]) == (3.0, 4.0, 5.0)
    (tmp_path / "e.csv").write_text("Total:\n1,ALA 1,LIG 9,1,2,3,4,5,6\nx,y\n")
    assert sorted(r["value"] for r in T.read_frame_decomposition(spark, str(tmp_path / "e.csv")).collect()) == [1, 2, 3, 4, 5, 6]


def test_residue_fingerprints(spark):
    df = spark.createDataFrame([("c1", "r1", 1.0, 0.5), ("c1", "r2", 2.0, 0.1), ("c2", "r2", 4.0, 0.2), ("c2", None, 9.0, 9.0)], "c string, r string, m double, s double")
    fp = {r["c"]: list(r["fingerprint"]) for r in residues.residue_fingerprint(df, "c", "r", ["m", "s"]).collect()}
    assert fp == {"c1": [1.0, 0.5, 2.0, 0.1], "c2": [0.0, 0.0, 4.0, 0.2]}
    scaled = residues.joint_minmax(residues.residue_fingerprint(df, "c", "r", ["m"]), "fingerprint")
    assert {r["c"]: list(r["fingerprint"]) for r in scaled.collect()}["c2"] == [0.0, 1.0]
    assert residues.complete_only(df, "c", "r", 2).select("c").distinct().count() == 1


def test_materialize(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for settings, force in (({"a": 1, "b": 2}, False), ({"b": 2, "a": 1}, False), ({"a": 2}, False), ({"a": 1, "b": 2}, True)):
        assert M.materialize(spark, str(tmp_path), "t", settings, make, force).count() == 3
    assert len(made) == 3
    M.append_side_output(spark.range(2), str(tmp_path / "side"))
    M.append_side_output(spark.range(2), str(tmp_path / "side"))
    assert spark.read.parquet(str(tmp_path / "side")).count() == 4
    M.write_single_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
