"""Clean views of the screening tables, as Spark plans and as the SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.functions.keys import base_of, clean_name, clean_protein, present
from posemill.operators.reduce import latest
from posemill.runtime import table

ENERGIES = ("Eint", "complexE", "ligandE_bound", "proteinE_bound")
DESCRIPTORS = ("MW", "AMW", "deepFl_logP", "ring_flexibility", "function_group_count", "bondType_SINGLE", "bondType_AROMATIC", "net_charge")
VECTOR = tuple(f"plec_ump{i}" for i in range(1, 41))


def poses(spark: SparkSession, folder: str) -> DataFrame:
    """Current poses: the latest delivery of every (structvar, frame, pose), names canonical, NaN as null."""
    rows = table(spark, folder, "scores_df").select(
        clean_name("structvar").alias("structvar"), "frame", "pose", clean_protein("protein").alias("protein"),
        base_of(clean_name("structvar")).alias("basemolname"), present("r_i_docking_score").alias("score"),
        *[present(e).alias(e) for e in ENERGIES], "loaded_at", "row_id",
    )
    return latest(rows, ["structvar", "frame", "pose"], ["loaded_at", "row_id"]).drop("loaded_at")


def _nan(c: str, name: str | None = None) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {name or c}"


POSES = f"""poses AS (SELECT * EXCLUDE (rn, loaded_at) FROM (SELECT lower(trim(structvar)) AS structvar, frame, pose,
 nullif(upper(trim(protein)), '') AS protein,
 nullif(regexp_extract(lower(trim(structvar)), '^(.+)_stereo[0-9]+_ion[0-9]+_tau[0-9]+$', 1), '') AS basemolname,
 {_nan("r_i_docking_score", "score")}, {", ".join(_nan(e) for e in ENERGIES)}, loaded_at, row_id,
 row_number() OVER (PARTITION BY lower(trim(structvar)), frame, pose ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn
 FROM scores_df) WHERE rn = 1)"""


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows with canonical names (a missing molecule name read from the variant) and NaN as null."""
    return table(spark, folder, "features_df").select(
        "feature_id", clean_protein("protein").alias("protein"), clean_name("structvar").alias("structvar"),
        F.coalesce(clean_name("basemolname"), base_of(clean_name("structvar"))).alias("basemolname"), "pose", "frame", "is_active",
        present("nofusion_Eint").alias("nofusion_Eint"), *[present(F.col(d).cast("double")).alias(d) for d in DESCRIPTORS],
    )


FEATURES = f"""features AS (SELECT feature_id, nullif(upper(trim(protein)), '') AS protein, lower(trim(structvar)) AS structvar,
 coalesce(nullif(lower(trim(basemolname)), ''), nullif(regexp_extract(lower(trim(structvar)), '^(.+)_stereo[0-9]+_ion[0-9]+_tau[0-9]+$', 1), '')) AS basemolname,
 pose, frame, is_active, {_nan("nofusion_Eint")},
 {", ".join(_nan(f"CAST({d} AS DOUBLE)", d) for d in DESCRIPTORS)} FROM features_df)"""


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """One label per molecule: active if any of its rows says so."""
    rows = table(spark, folder, "activities").select(clean_name("basemolname").alias("basemolname"), "is_active")
    return rows.where("basemolname is not null and is_active is not null").groupBy("basemolname").agg(F.max("is_active").alias("is_active"))


LABELS = """labels AS (SELECT nullif(lower(trim(basemolname)), '') AS basemolname, max(is_active) AS is_active FROM activities
 WHERE is_active IS NOT NULL AND nullif(lower(trim(basemolname)), '') IS NOT NULL GROUP BY 1)"""


def entropies(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conformational_entropy").select(clean_name("molname").alias("structvar"), present("schrodinger_confS").alias("confS"))
    return rows.where("structvar is not null").groupBy("structvar").agg(F.min("confS").alias("confS"))


ENTROPIES = f"""entropies AS (SELECT structvar, min(confS) AS confS FROM (SELECT nullif(lower(trim(molname)), '') AS structvar,
 {_nan("schrodinger_confS", "confS")} FROM conformational_entropy) WHERE structvar IS NOT NULL GROUP BY 1)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hyper_opt_df").select(
        "run_id", F.col("HYPER_EXECUTION_DIR_NAME").alias("directory"), clean_protein("HYPER_PROTEIN").alias("protein"), "score_name",
        "HYPER_RATIO_SCORED_POSES", "HYPER_OUTLIER_MAD_THRESHOLD", "HYPER_KEEP_MAX_DeltaG_POSES",
        present("auc_roc").alias("auc_roc"), present("auc_bedroc").alias("auc_bedroc"), present("r_i_docking_score").alias("score"),
    )


RUNS = f"""runs AS (SELECT run_id, HYPER_EXECUTION_DIR_NAME AS directory, nullif(upper(trim(HYPER_PROTEIN)), '') AS protein, score_name,
 HYPER_RATIO_SCORED_POSES, HYPER_OUTLIER_MAD_THRESHOLD, HYPER_KEEP_MAX_DeltaG_POSES,
 {_nan("auc_roc")}, {_nan("auc_bedroc")}, {_nan("r_i_docking_score", "score")} FROM hyper_opt_df)"""
