"""The screening pipeline: settings, feature preparation for all proteins at once, and its further queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.functions import chemistry
from posemill.functions.names import structvar_of
from posemill.operators import filters, learning, ranking, reduce
from posemill.operators.joins import beside, join_all, natural_join, null_safe_join
from posemill.plans.learned import FEATURE_COLUMNS
from posemill.plans.registry import query, rounded
from posemill.plans.views import ENTROPIES, FEATURES, LABELS, POSES, RUNS, VECTOR, entropies, features, labels, poses, runs
from posemill.runtime import Scratch, shared_root, table
from posemill.sources.rejects import parse_mol2, read_fingerprint_lines
from posemill.sources.textfiles import lowest_variants, mol2_to_sdf
from posemill.streaming.deliveries import delivery_counts


@dataclass(frozen=True)
class Settings:
    """What the preparation depends on; results are kept under its fingerprint."""

    score_window: float = 1.0
    most_poses: int = 100
    scored_ratio: float = 0.8
    mad_threshold: float = 3.5
    outlier_columns: tuple[str, ...] = ("complexE",)
    with_entropy: bool = True


def prepare_features(spark: SparkSession, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Best variant per protein and molecule with its energies, label and receptor fluctuations.

    Poses near the best score -> reaction energies -> labels -> variants with enough scored poses -> no outliers -> best pose
    per variant -> best variant per molecule -> fluctuations of the protein beside each row.
    """
    near = filters.top_window(poses(spark, folder), ["protein", "structvar"], "score", settings.score_window, settings.most_poses)
    good, _ = filters.well_scored(near, ["protein", "structvar"], F.col("Eint").isNotNull(), settings.scored_ratio)
    clean = filters.without_outliers(good, ["protein", "structvar", "frame"], list(settings.outlier_columns), settings.mad_threshold)
    energy = reduce.delta_h(clean, "structvar", "complexE", "proteinE_bound", "ligandE_bound", "DeltaH", ["protein"]).select("protein", "structvar", "DeltaH")
    rows = null_safe_join(clean, energy, ["protein", "structvar"])
    order = [F.col(c).asc_nulls_last() for c in ("complexE", "Eint", "pose", "frame")]
    variants = ranking.first_in_group(rows, ["protein", "structvar"], order)
    best = ranking.first_in_group(variants, ["protein", "basemolname"], [F.col("Eint").asc_nulls_last(), F.col("structvar")])
    spread = rows.groupBy("protein", "structvar").agg(F.stddev_samp("proteinE_bound").alias("s")).groupBy("protein").agg(F.avg("s").alias("protein_fluctuation"))
    out = null_safe_join(best, spread, ["protein"], "left")
    if settings.with_entropy:
        out = out.join(entropies(spark, folder), "structvar", "left")
        out = out.withColumn("score_with_entropy", F.col("DeltaH") + F.coalesce("confS", F.lit(0.0)))
    return out.join(labels(spark, folder), "basemolname", "left")


@query()
def prepared_features(spark: SparkSession, folder: str) -> DataFrame:
    out = prepare_features(spark, folder)
    keep = ["protein", "basemolname", "structvar", "pose", "frame", "Eint", "is_active"]
    return out.select(*keep, rounded("DeltaH", 4), rounded("score_with_entropy", 4), rounded("protein_fluctuation", 3))


@query(f"""WITH {FEATURES}, {ENTROPIES}, {LABELS} SELECT feature_id, protein, MW, net_charge, confS, l.is_active AS label FROM features f
 JOIN entropies USING (structvar) JOIN labels l USING (basemolname)""")
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = features(spark, folder).drop("is_active")
    both = join_all(["structvar"], rows, entropies(spark, folder))
    return join_all(["basemolname"], both, labels(spark, folder)).select("feature_id", "protein", "MW", "net_charge", "confS", F.col("is_active").alias("label"))


@query(f"""WITH {POSES}, v AS (SELECT protein, structvar, min(complexE) AS c, min(ligandE_bound) AS l FROM poses GROUP BY 1, 2),
 r AS (SELECT protein, min(proteinE_bound) AS p FROM poses GROUP BY 1), b AS (SELECT protein, structvar, min(complexE) AS low FROM poses GROUP BY 1, 2)
 SELECT row_id, CASE WHEN complexE = low THEN round(c - p - l, 4) END AS delta FROM poses s
 LEFT JOIN b ON b.protein IS NOT DISTINCT FROM s.protein AND b.structvar = s.structvar LEFT JOIN v ON v.protein IS NOT DISTINCT FROM s.protein AND v.structvar = s.structvar
 LEFT JOIN r ON r.protein IS NOT DISTINCT FROM s.protein""")
def delta_h_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that attain their variant's lowest complex energy carry the reaction energy, the others null."""
    rows = poses(spark, folder)
    energy = reduce.delta_h(rows, "structvar", "complexE", "proteinE_bound", "ligandE_bound", "d", ["protein"]).select("protein", "structvar", F.round("d", 4).alias("d"))
    best = null_safe_join(reduce.all_minima(rows, ["protein", "structvar"], "complexE").select("protein", "structvar", "row_id"), energy, ["protein", "structvar"])
    return rows.select("row_id").join(best.select("row_id", F.col("d").alias("delta")), "row_id", "left")


_DIFFERENCE = f"""WITH {RUNS}, a AS (SELECT run_id, (rank() OVER (ORDER BY auc_roc) + (count(*) OVER (PARTITION BY auc_roc) - 1) / 2) / count(*) OVER () AS x FROM runs WHERE auc_roc IS NOT NULL),
 b AS (SELECT run_id, (rank() OVER (ORDER BY auc_bedroc) + (count(*) OVER (PARTITION BY auc_bedroc) - 1) / 2) / count(*) OVER () AS y FROM runs WHERE auc_bedroc IS NOT NULL),
 d AS (SELECT run_id, round(x - y, 9) AS difference FROM a JOIN b USING (run_id))"""


@query(_DIFFERENCE + """ SELECT * FROM ((SELECT 'highest' AS side, run_id, difference FROM d ORDER BY difference DESC, run_id LIMIT 10)
 UNION ALL (SELECT 'lowest' AS side, run_id, difference FROM d ORDER BY difference, run_id LIMIT 10))""")
def largest_rank_differences(spark: SparkSession, folder: str) -> DataFrame:
    """A top-k report: the ten runs whose two ranks differ most in either direction."""
    rows = ranking.add_ranks(runs(spark, folder), "auc_roc", "share", "x")
    rows = ranking.add_ranks(rows, "auc_bedroc", "share", "y").where("x is not null and y is not null")
    d = rows.select("run_id", F.round(F.col("x") - F.col("y"), 9).alias("difference"))
    high = d.orderBy(F.desc("difference"), "run_id").limit(10).withColumn("side", F.lit("highest"))
    return high.unionByName(d.orderBy("difference", "run_id").limit(10).withColumn("side", F.lit("lowest")))


@query()
def fingerprint_features(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of the wanted poses joined to their features, the counts as one array column."""
    lines = read_fingerprint_lines(table(spark, folder, "plec_raw"), "line_id", "raw_line")[0]
    wanted = features(spark, folder).select("feature_id", F.concat("structvar", F.lit("_pose"), "pose", F.lit("_frm"), "frame").alias("complex_name"))
    found = lines.join(wanted.select("complex_name").distinct(), "complex_name", "left_semi")
    joined = wanted.join(found, "complex_name")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
    return joined.select("feature_id", "line_id", "complex_name", total.alias("contacts"), F.size(F.filter("counts", lambda c: c > 0)).alias("n_bits"))


@query(f"WITH {FEATURES} SELECT f.feature_id, CASE WHEN is_active = 1 THEN 'active' WHEN is_active = 0 THEN 'inactive' ELSE 'unknown' END AS label FROM features f")
def scatter_labels(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("is_active") == 1, "active").when(F.col("is_active") == 0, "inactive").otherwise("unknown")
    return features(spark, folder).select("feature_id", label.alias("label"))


@query()
def scatter_components(spark: SparkSession, folder: str) -> DataFrame:
    """First three principal components of the fingerprint vectors with readable labels, for a 3-D plot."""
    columns = [F.when(~F.isnan(v), F.col(v).cast("double")).alias(v) for v in VECTOR]
    rows = table(spark, folder, "features_df").select("feature_id", *columns).dropna("any")
    out, _, names = learning.reduce_dimensions(rows, rows.limit(0), list(VECTOR), 3)
    return out.join(scatter_labels(spark, folder), "feature_id").select("feature_id", "label", *[F.round(n, 4).alias(n) for n in names])


@query()
def leave_one_out_average(spark: SparkSession, folder: str) -> DataFrame:
    from posemill.plans.learned import leave_one_protein_out

    out = leave_one_protein_out(spark, folder)
    return out.agg(*[F.avg(c).alias(c) for c in ("auc_roc", "auc_croc", "auc_bedroc")], F.count("auc_roc").alias("n_folds"))


@query()
def adaboost_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = features(spark, folder).where("is_active is not null")
    model = learning.fit_adaboost(rows, FEATURE_COLUMNS, "is_active", rounds=5, depth=2)
    return learning.predict(model, rows, FEATURE_COLUMNS, "score").select("feature_id", rounded("score", 4))


@query()
def kernel_svc_margins(spark: SparkSession, folder: str) -> DataFrame:
    """RBF support vectors approximated by random Fourier features under a linear machine."""
    from posemill.operators.scaling import standardize

    rows = standardize(features(spark, folder).where("is_active is not null"), FEATURE_COLUMNS).dropna("any", subset=FEATURE_COLUMNS)
    rows = Scratch(spark, "kernel").cut(rows.select("feature_id", "is_active", *FEATURE_COLUMNS))
    mapped, names = learning.random_fourier(rows, FEATURE_COLUMNS, 32)
    model = learning.fit(mapped, "linear_svc", names, "is_active")
    return learning.predict(model, mapped, names, "margin").select("feature_id", rounded("margin", 4))


@query()
def cross_validated_lr(spark: SparkSession, folder: str) -> DataFrame:
    rows = features(spark, folder).where("is_active is not null")
    model = learning.fit_cross_validated(rows, FEATURE_COLUMNS, "is_active", [0.1, 10.0])
    return learning.predict(model, rows, FEATURE_COLUMNS, "probability").select("feature_id", rounded("probability", 3))


@query()
def regression_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    rows = features(spark, folder)
    out = None
    for kind in ("linear", "lasso", "ridge"):
        part = learning.regression(rows, ["MW", "AMW", "deepFl_logP"], "nofusion_Eint", kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.select("kind", "feature", rounded("coefficient", 4))


@query()
def descriptor_table(spark: SparkSession, folder: str) -> DataFrame:
    """Atom counts, weight, bond types and shape of the lowest-energy structure of every variant."""
    parsed = parse_mol2(table(spark, folder, "mol2_raw"), "record_id", "raw_text")
    low = lowest_variants(parsed)
    counts = low.select("id", "structvar", F.size("atoms").alias("n_atoms"), F.round(chemistry.molecular_weight("atoms"), 3).alias("mw"), *[c.alias(n) for n, c in chemistry.bond_type_counts("bonds").items()])
    shape = chemistry.shape_descriptors(low.select("id", "atoms"), "id", "atoms")
    return counts.join(shape, "id").select("structvar", "id", "n_atoms", "mw", "bondType_ar", rounded("rg", 4), rounded("npr1", 4), rounded("npr2", 4))


@query()
def sdf_conversion(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_mol2(table(spark, folder, "mol2_raw"), "record_id", "raw_text")
    return mol2_to_sdf(parsed).select(F.col("id").alias("record_id"), structvar_of("molname").alias("structvar"), F.length("sdf").alias("n_chars"))


@query("""SELECT date_trunc('day', loaded_at) AS "from", upper(trim(protein)) AS protein, count(*) AS n_rows, count(CASE WHEN isnan(r_i_docking_score) THEN NULL ELSE r_i_docking_score END) AS n_scored,
 min(CASE WHEN isnan(r_i_docking_score) THEN NULL ELSE r_i_docking_score END) AS lowest FROM scores_df WHERE protein IS NOT NULL GROUP BY 1, 2""")
def stream_delivery_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The table replayed as a stream into daily windows per protein."""
    from uuid import uuid4

    source = table(spark, folder, "scores_df")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/scores_df.parquet" if len(source.inputFiles()) > 1 else f"{folder}/scores_df*.parquet")
    score = F.when(~F.isnan("r_i_docking_score"), F.col("r_i_docking_score"))
    rows = stream.where("protein is not null").select(F.col("loaded_at").cast("timestamp").alias("at"), F.upper(F.trim("protein")).alias("protein"), score.alias("score"))
    out = f"{shared_root(spark)}/deliveries-{uuid4().hex}"
    counts = delivery_counts(rows, "at", ["protein"], late="30 days")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{out}/counts")

    q = counts.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = spark.read.schema(counts.schema.add("batch", "long")).parquet(f"{out}/counts")
    last = reduce.latest(kept, ["from", "protein"], ["batch"]).drop("batch")
    return last.withColumn("from", F.col("from").cast("timestamp_ntz"))


@query(f"WITH {POSES}, {LABELS} SELECT row_id, score - (SELECT avg(score) FROM poses WHERE frame = 1) < 0 AS better FROM poses")
def better_than_first_frame(spark: SparkSession, folder: str) -> DataFrame:
    rows = poses(spark, folder)
    both = beside(rows, rows.where("frame = 1").agg(F.avg("score").alias("a")))
    return both.select("row_id", (F.col("score") - F.col("a") < 0).alias("better"))


@query(f"""WITH {FEATURES}, {POSES}, a AS (SELECT structvar, pose, frame, protein, min(nofusion_Eint) AS e FROM features GROUP BY ALL), b AS (SELECT structvar, pose, frame, protein, score FROM poses)
 SELECT coalesce(a.structvar, b.structvar) AS structvar, coalesce(a.pose, b.pose) AS pose, coalesce(a.frame, b.frame) AS frame, e, score FROM a FULL JOIN b
 ON a.structvar = b.structvar AND a.pose = b.pose AND a.frame = b.frame AND a.protein IS NOT DISTINCT FROM b.protein""")
def combined_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Two scores of every pose side by side, whichever of them exists."""
    a = features(spark, folder).groupBy("structvar", "pose", "frame", "protein").agg(F.min("nofusion_Eint").alias("e"))
    b = poses(spark, folder).select("structvar", "pose", "frame", "protein", "score")
    return natural_join(a, b, how="full").select("structvar", "pose", "frame", "e", "score")
