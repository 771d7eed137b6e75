"""Tables written out in the formats of the sources and read back: what the readers give against SQL on the tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.functions.keys import clean_name
from posemill.operators.joins import join_all
from posemill.operators.residues import TERMS
from posemill.plans.parsing import _MOL2, _PLEC
from posemill.plans.registry import query, rounded
from posemill.plans.views import FEATURES, LABELS, POSES, RUNS, features, labels, poses, runs
from posemill.runtime import shared_root, table
from posemill.sources import materialize as M
from posemill.sources import textfiles as T
from posemill.sources.rejects import parse_mol2, read_fingerprint_lines


def _place(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/texts-{uuid4().hex[:8]}"


def _lines(df: DataFrame, line: Column) -> str:
    path = _place(df.sparkSession)
    df.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return path


def _csv(df: DataFrame) -> str:
    path = _place(df.sparkSession)
    df.write.option("header", True).option("compression", "gzip").csv(path)
    return path


_PARTS = "^(.*)_stereo([0-9]+)_ion([0-9]+)_tau([0-9]+)_pose([0-9]+)$"


@query(f"""WITH {POSES}, m AS (SELECT structvar || '_pose' || pose AS molname, row_id, score FROM poses) SELECT molname, nullif(regexp_extract(molname, '{_PARTS}', 1), '') AS basemolname,
 {", ".join(f"TRY_CAST(regexp_extract(molname, '{_PARTS}', {i}) AS INTEGER) AS {n}" for i, n in ((2, "stereoisomer"), (3, "ionstate"), (4, "tautomer"), (5, "pose")))}, row_id, score FROM m""")
def read_properties(spark: SparkSession, folder: str) -> DataFrame:
    rows = poses(spark, folder).select(F.upper(F.concat("structvar", F.lit("_pose"), "pose")).alias("molname"), "row_id", "score")
    back = T.read_properties(spark, _csv(rows.withColumn("molname", F.replace(F.replace(F.replace(F.replace(F.col("molname"), F.lit("_STEREO"), F.lit("_stereo")), F.lit("_ION"), F.lit("_ion")), F.lit("_TAU"), F.lit("_tau")), F.lit("_POSE"), F.lit("_pose")))), {"row_id": "long", "score": "double"})
    return back


@query(f"WITH {LABELS} SELECT basemolname, is_active FROM labels")
def read_activities(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels(spark, folder)
    return T.read_activities(spark, _lines(rows, F.concat(F.lit("# head\n  "), F.upper("basemolname"), F.lit(" \t "), F.col("is_active").cast("string"), F.lit("  # seen"))))


_QM = """SELECT coalesce(upper(trim(protein)), '') AS protein, lower(trim(basemolname)) AS basemolname, stereoisomer, ionstate, tautomer, frame, pose,
 lower(trim(basemolname)) || '_stereo' || stereoisomer || '_ion' || ionstate || '_tau' || tautomer AS structvar, Eint AS "pm7_Eint", complexE AS "pm7_complexE", ligandE_bound AS "pm7_ligandE_bound",
 proteinE_bound AS "pm7_proteinE_bound" FROM scores_df WHERE trim(basemolname) <> ''"""


@query(f"SELECT * REPLACE ('ALL' AS protein) FROM ({_QM})")
def read_qm_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "scores_df").select(clean_name("basemolname").alias("molname"), "stereoisomer", "ionstate", "tautomer", "frame", "pose", *T.ENERGIES)
    return T.read_qm_scores(spark, _csv(rows.where("molname is not null")), "pm7", "ALL")


@query(f"WITH {FEATURES} SELECT protein, structvar, CAST(net_charge AS INTEGER) AS net_charge FROM features WHERE protein IS NOT NULL")
def read_net_charges(spark: SparkSession, folder: str) -> DataFrame:
    rows = features(spark, folder).where("protein is not null").select("protein", F.col("structvar").alias("Name"), F.col("net_charge").cast("int").alias("Charge"))
    proteins = [r[0] for r in rows.select("protein").distinct().collect()]
    return T.read_net_charges(spark, {p: _csv(rows.where(F.col("protein") == p).drop("protein")) for p in proteins})


@query("SELECT lower(trim(molname)) AS structvar, CASE WHEN isnan(schrodinger_confS) THEN NULL ELSE schrodinger_confS END AS \"schrodinger_confS\" FROM conformational_entropy WHERE trim(molname) <> ''")
def read_entropies(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(~F.isnan("schrodinger_confS"), F.col("schrodinger_confS")).alias("schrodinger_confS")
    rows = table(spark, folder, "conformational_entropy").select(F.trim("molname").alias("molname"), value).where("molname <> ''")
    return T.read_entropies(spark, _csv(rows), "schrodinger_confS")


@query(f"WITH {POSES} SELECT structvar, min(ligandE_bound) AS \"min_Energy\", min(structvar || '_pose' || pose) AS best_molname FROM poses GROUP BY 1")
def read_free_ligands(spark: SparkSession, folder: str) -> DataFrame:
    rows = poses(spark, folder).select(F.concat("structvar", F.lit("_pose"), "pose").alias("molname"), F.col("ligandE_bound").alias("Energy:"))
    return T.free_ligand_minima(spark, _csv(rows))


@query(f"WITH {_PLEC} SELECT complex_name, CAST(list_sum(list_transform(c, lambda v: CAST(v AS INTEGER))) AS BIGINT) AS contacts, CAST(c[1] AS INTEGER) AS first_count FROM plec WHERE reason IS NULL")
def read_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    loaded = read_fingerprint_lines(table(spark, folder, "plec_raw"), "line_id", "raw_line")[0]
    path = _csv(loaded.select("complex_name", *[F.col("counts")[i].alias(str(i)) for i in range(128)]))
    back = T.read_fingerprints(spark, path, "complex_name", 128)
    return back.select("complex_name", F.aggregate("fp", F.lit(0).cast("long"), lambda s, x: s + x).alias("contacts"), F.col("fp")[0].cast("int").alias("first_count"))


@query(f"WITH {FEATURES}, f AS (SELECT feature_id, protein, MW FROM features WHERE protein IS NOT NULL) SELECT feature_id, MW FROM f WHERE protein NOT IN (SELECT protein FROM f WHERE MW IS NULL)")
def gather_csv(spark: SparkSession, folder: str) -> DataFrame:
    """One file per protein; those with a missing weight are left out whole."""
    rows = features(spark, folder).where("protein is not null").select("feature_id", "MW", "protein")
    path = _place(spark)
    rows.repartition("protein").write.partitionBy("protein").option("header", True).csv(path)
    return T.gather_csv(spark, f"{path}/*", "feature_id long, MW double")[0]


def _structures(spark: SparkSession, folder: str) -> DataFrame:
    return parse_mol2(table(spark, folder, "mol2_raw"), "record_id", "raw_text")


@query(f"WITH {_MOL2} SELECT lower(name) AS molname, 'Energy' AS property, CASE WHEN lower(e) <> 'nan' THEN round(CAST(e AS DOUBLE), 6) END AS value FROM mol2 WHERE reason IS NULL")
def read_sdf_properties(spark: SparkSession, folder: str) -> DataFrame:
    path = _lines(T.mol2_to_sdf(_structures(spark, folder)), F.regexp_replace("sdf", "\n$", ""))
    return T.sdf_properties(T.sdf_records(spark, path), ["Energy"]).select("molname", "property", F.round(F.col("value").try_cast("double"), 6).alias("value"))


_LOWEST = f"WITH {_MOL2} SELECT lower(name) AS molname, count(*) AS n_records, min(CASE WHEN lower(e) <> 'nan' THEN CAST(e AS DOUBLE) END) AS min_energy FROM mol2 WHERE reason IS NULL GROUP BY 1"


@query(_LOWEST)
def read_mol2_records(spark: SparkSession, folder: str) -> DataFrame:
    path = _lines(_structures(spark, folder).where("reason is null"), F.col("raw"))
    back = T.mol2_records(spark, path).where(F.col("raw_text").contains("@<TRIPOS>ATOM"))
    return T.lowest_energies(parse_mol2(back.withColumn("i", F.monotonically_increasing_id()), "i", "raw_text"))


@query(f"WITH {LABELS} SELECT 'C' || upper(basemolname) AS smiles, CASE WHEN is_active = 1 THEN basemolname ELSE 'unk' || row_number() OVER (PARTITION BY is_active ORDER BY basemolname) END AS molname FROM labels")
def read_smiles(spark: SparkSession, folder: str) -> DataFrame:
    """In one file in the order of names, so that the numbers of the unnamed can be compared."""
    rows = labels(spark, folder).orderBy("basemolname").coalesce(1)
    return T.smiles(spark, _lines(rows, F.concat_ws(" ", F.concat(F.lit("C"), F.upper("basemolname")), F.when(F.col("is_active") == 1, F.col("basemolname")))))


_TERM_VALUES = ", ".join(f"('{t}', {i})" for i, t in enumerate(TERMS))


@query(f"""WITH {POSES}, g AS (SELECT frame, round(avg(Eint), 4) AS e FROM poses GROUP BY 1) SELECT 'DELTAS' AS section, 'RES ' || frame AS residue, t.column0 AS term, round(e + t.column1, 4) AS mean, round(e / 2, 4) AS stdev, 1.0::DOUBLE AS stderr
 FROM g, (VALUES {_TERM_VALUES}) t(column0, column1)""")
def read_decomposition(spark: SparkSession, folder: str) -> DataFrame:
    means = poses(spark, folder).groupBy("frame").agg(F.round(F.avg("Eint"), 4).alias("e"))  # one row per frame of the trajectories: few
    fields = [x for i in range(len(TERMS)) for x in (F.round(F.col("e") + i, 4), F.round(F.col("e") / 2, 4), F.lit(1.0))]
    line = F.concat_ws(",", F.concat(F.lit("RES "), "frame"), F.lit("LIG 1"), *[x.cast("string") for x in fields])
    back_line = F.concat_ws(",", F.lit("LIG 1"), F.concat(F.lit("RES "), "frame"), *[x.cast("string") for x in fields])
    text = means.agg(F.concat(F.lit("DELTAS:\n"), F.array_join(F.flatten(F.collect_list(F.array(line, back_line))), "\n")).alias("text"))
    path = _place(spark)
    text.coalesce(1).write.text(path)
    out = T.read_decomposition(spark, path)
    return out.select("section", "residue", "term", rounded("mean", 4), rounded("stdev", 4), "stderr")


@query(f"""WITH {RUNS} SELECT run_id, auc_roc, protein AS "HYPER_PROTEIN", 'comb' || CAST(HYPER_OUTLIER_MAD_THRESHOLD * 10 AS INTEGER) AS "HYPER_EXECUTION_DIR_NAME", CAST(HYPER_OUTLIER_MAD_THRESHOLD AS DOUBLE) AS mad FROM runs WHERE protein IS NOT NULL""")
def collect_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A folder per threshold with its parameter list and one evaluation per protein, written and collected again."""
    rows = runs(spark, folder).where("protein is not null")
    rows = rows.select("run_id", "auc_roc", F.col("HYPER_OUTLIER_MAD_THRESHOLD").alias("mad"), F.concat(F.lit("comb"), (F.col("HYPER_OUTLIER_MAD_THRESHOLD") * 10).cast("int")).alias("dir"), "protein")
    place = _place(spark)
    fs = spark._jvm.org.apache.hadoop.fs
    for d, mad in [(r["dir"], r["mad"]) for r in rows.select("dir", "mad").distinct().collect()]:
        target = fs.Path(f"{place}/{d}/hyper_parameters.list")
        with_stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        with_stream.write(bytearray(f"parameter\tvalue\nHYPER_EXECUTION_DIR_NAME\t{d} \nmad\t{mad!r}\n".encode()))
        with_stream.close()
    flat = _place(spark)
    rows.drop("mad").repartition("dir", "protein").write.partitionBy("dir", "protein").option("header", True).csv(flat)
    system = fs.Path(flat).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in system.globStatus(fs.Path(f"{flat}/dir=*/protein=*/part-*")):
        parts = dict(x.split("=") for x in f.getPath().toString().split("/") if x.startswith(("dir=", "protein=")))
        to = f"{place}/{parts['dir']}/{parts['protein']}_{uuid4().hex[:6]}_evaluation.csv"
        system.rename(f.getPath(), fs.Path(to))
    out = T.collect_runs(spark, place)
    return out.select("run_id", "auc_roc", "HYPER_PROTEIN", "HYPER_EXECUTION_DIR_NAME", F.col("mad").cast("double").alias("mad"))


@query(f"WITH {FEATURES} SELECT basemolname, count(*) AS n, max(MW) AS mw FROM features GROUP BY 1")
def materialized_report(spark: SparkSession, folder: str) -> DataFrame:
    """Made once under the fingerprint of its settings and then read; the second call makes nothing."""
    place, made = _place(spark), []

    def make() -> DataFrame:
        made.append(1)
        return features(spark, folder).groupBy("basemolname").agg(F.count("*").alias("n"), F.max("MW").alias("mw"))

    M.materialize(spark, place, "report", {"a": 1, "b": [2]}, make)
    out = M.materialize(spark, place, "report", {"b": [2], "a": 1}, make)
    if len(made) != 1:
        raise RuntimeError("the stored result was made again")
    return out


@query(f"WITH {POSES} SELECT row_id, structvar FROM poses WHERE Eint IS NULL UNION ALL SELECT row_id, structvar FROM poses WHERE score IS NULL")
def appended_side_outputs(spark: SparkSession, folder: str) -> DataFrame:
    rows, place = poses(spark, folder), _place(spark)
    for missing in ("Eint", "score"):
        M.append_side_output(rows.where(F.col(missing).isNull()).select("row_id", "structvar"), place)
    return spark.read.schema("row_id long, structvar string").parquet(place)


@query(f"WITH {RUNS} SELECT score_name, count(*) AS n FROM runs GROUP BY 1")
def single_csv_report(spark: SparkSession, folder: str) -> DataFrame:
    place = _place(spark)
    M.write_single_csv(runs(spark, folder).groupBy("score_name").agg(F.count("*").alias("n")), place)
    return spark.read.schema("score_name string, n long").option("header", True).csv(place)


@query(f"""WITH {FEATURES}, {_PLEC}, m AS (SELECT *, regexp_replace(regexp_replace(complex_name, '_frm[0-9]+', ''), '_pose[0-9]+', '') AS structvar FROM plec WHERE reason IS NULL)
 SELECT feature_id, line_id, protein FROM features JOIN m USING (structvar)""")
def variant_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints by (protein, structvar): each protein's wanted variants first, then its rows."""
    from posemill.functions.names import structvar_of

    rows = features(spark, folder).select("feature_id", "protein", "structvar")
    loaded = read_fingerprint_lines(table(spark, folder, "plec_raw"), "line_id", "raw_line")[0].withColumn("structvar", structvar_of("complex_name"))
    wanted = loaded.join(rows.select("structvar").distinct(), "structvar", "left_semi").select("structvar", "line_id")
    return rows.join(wanted, "structvar").select("feature_id", "line_id", "protein")


@query(f"""WITH {FEATURES}, {POSES}, d AS (SELECT protein, structvar, max(MW) AS mw_2d FROM features GROUP BY 1, 2), c AS (SELECT protein, structvar, pose, frame, max(ring_flexibility) AS complex_3d FROM features GROUP BY 1, 2, 3, 4),
 q AS (SELECT protein, structvar, max(net_charge) AS charge FROM features GROUP BY 1, 2), l AS (SELECT protein, structvar, max(AMW) AS ligand_3d FROM features GROUP BY 1, 2),
 k AS (SELECT protein, structvar, count(score) AS valid_pose_num FROM poses GROUP BY 1, 2)
 SELECT feature_id, f.protein, structvar, mw_2d, complex_3d, charge, ligand_3d, valid_pose_num FROM features f JOIN d USING (protein, structvar) JOIN c USING (protein, structvar, pose, frame) JOIN q USING (protein, structvar)
 JOIN l USING (protein, structvar) JOIN k USING (protein, structvar)""")
def feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows with 2-D, complex, charge, 3-D and conformer descriptors, five joins on (protein, structvar[, pose, frame])."""
    rows = features(spark, folder)
    key = ["protein", "structvar"]
    two = rows.groupBy(*key).agg(F.max("MW").alias("mw_2d"))
    inside = rows.groupBy(*key, "pose", "frame").agg(F.max("ring_flexibility").alias("complex_3d"))
    charge = rows.groupBy(*key).agg(F.max("net_charge").alias("charge"))
    shape = rows.groupBy(*key).agg(F.max("AMW").alias("ligand_3d"))
    states = poses(spark, folder).groupBy(*key).agg(F.count("score").alias("valid_pose_num"))
    base = join_all([*key, "pose", "frame"], rows.select("feature_id", *key, "pose", "frame"), inside)
    return join_all(key, base, two, charge, shape, states).select("feature_id", *key, "mw_2d", "complex_3d", "charge", "ligand_3d", "valid_pose_num")
