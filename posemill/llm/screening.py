"""Views of the screening tables shared by the queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.functions.keys import clean_name, clean_protein, present
from posemill.runtime import table


def current_poses(scores: DataFrame) -> DataFrame:
    """Latest delivery of each (structvar, frame, pose): largest loaded_at, then row_id; null loaded_at counts as oldest.

    One shuffle on the full key with a map-side pre-aggregate, so neither a hot structvar nor a pose delivered again
    and again gathers in one task. ``protein`` is the only non-null one among all deliveries. Names are canonical.
    """
    rows = scores.select(
        clean_name("structvar").alias("structvar"), "frame", "pose", clean_protein("protein").alias("protein"),
        present("r_i_docking_score").alias("score"), "loaded_at", "row_id",
    ).where("structvar is not null")
    return rows.groupBy("structvar", "frame", "pose").agg(
        F.max_by("score", F.struct("loaded_at", "row_id")).alias("score"), F.max("protein").alias("protein")
    )


def variant_records(scores: DataFrame) -> DataFrame:
    """One record per structvar: lowest present score of its current poses and its protein."""
    return current_poses(scores).groupBy("structvar").agg(F.min("score").alias("score"), F.max("protein").alias("protein"))


def scored_records(spark: SparkSession, folder: str) -> DataFrame:
    """record_set, protein, record_key, score of the structvars of scores_df and the runs of hyper_opt_df."""
    variants = variant_records(table(spark, folder, "scores_df")).select(
        F.lit("scores_df").alias("record_set"), "protein", F.col("structvar").alias("record_key"), "score"
    )
    runs = table(spark, folder, "hyper_opt_df").select(
        F.lit("hyper_opt_df").alias("record_set"), clean_protein("HYPER_PROTEIN").alias("protein"),
        F.col("run_id").cast("string").alias("record_key"), present("r_i_docking_score").alias("score"),
    )
    return variants.unionByName(runs).where("protein is not null and score is not null")


def keep_targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "keep_targets").select("record_set", clean_protein("protein").alias("protein"), "keep_permille")
