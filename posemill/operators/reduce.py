"""Reductions from poses to variants to molecules, and other group aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posemill.operators.joins import beside, null_safe_join
from posemill.operators.ranking import first_in_group


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row delivered last for every key (nulls in ``order`` count as oldest); pre-aggregated before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def best_in_two_steps(df: DataFrame, variant: list[str], molecule: list[str], pose_score: str, variant_score: str, ties: list[str], into: str) -> DataFrame:
    """Lowest pose_score per variant, then lowest variant_score per molecule; its score is copied to ``into``.

    Missing scores sort last, NaN after numbers; ties go by the ``ties`` columns, which must make the order total.
    """
    def order(score: str) -> list[Column]:
        return [F.col(score).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]

    poses = first_in_group(df, variant, order(pose_score))
    return first_in_group(poses, molecule, order(variant_score)).withColumn(into, F.col(variant_score))


def columnwise_min(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Minimum of every column on its own, so values of one result row may stem from different rows."""
    return df.groupBy(*by).agg(*[F.min(c).alias(f"min_{c}") for c in columns])


def all_minima(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Every row that attains its group's lowest score; ties stay, missing scores go."""
    low = df.groupBy(*by).agg(F.min(score).alias("_low"))
    return null_safe_join(df, low, by).where(F.col(score) == F.col("_low")).drop("_low")


def add_group_min(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """Group minima of columns (name -> new name) beside every row."""
    return null_safe_join(df, df.groupBy(*by).agg(*[F.min(c).alias(n) for c, n in columns.items()]), by)


def delta_h(df: DataFrame, variant: str, complex_e: str, protein_e: str, ligand_e: str, into: str, by: list[str]) -> DataFrame:
    """Per variant: lowest complex energy - lowest protein energy of the whole ``by`` group - the variant's free-ligand energy.

    A variant without one of the energies gets null.
    """
    variants = df.groupBy(*by, variant).agg(F.min(complex_e).alias("min_complexE"), F.min(ligand_e).alias("min_ligandE"))
    receptor = df.groupBy(*by).agg(F.min(protein_e).alias("min_proteinE"))
    both = null_safe_join(variants, receptor, by)
    return both.withColumn(into, F.col("min_complexE") - F.col("min_proteinE") - F.col("min_ligandE"))


def fluctuations(df: DataFrame, variant: list[str], best: DataFrame, columns: list[str]) -> DataFrame:
    """One row: per column the mean over variants of the sample deviation, the deviation over best rows and over all rows.

    Variants of one row have no deviation and are left out of the mean.
    """
    inner = df.groupBy(*variant).agg(*[F.stddev_samp(c).alias(c) for c in columns])
    one = inner.agg(*[F.avg(c).alias(f"mean_stdev_{c}") for c in columns])
    for name, rows in (("best", best), ("all", df)):
        one = beside(one, rows.agg(*[F.stddev_samp(c).alias(f"stdev_{name}_{c}") for c in columns]))
    return one


def score_summary(df: DataFrame, name: str, score: str, label: str, by: list[str]) -> DataFrame:
    """Distinct actives and inactives, minimum, mean, maximum, deviation, range, min-max-scaled population deviation."""
    s = F.col(score)
    return df.groupBy(*by).agg(
        F.count_distinct(F.when(F.col(label) == 1, F.col(name))).alias("num_of_actives"),
        F.count_distinct(F.when(F.col(label) == 0, F.col(name))).alias("num_of_inactives"),
        F.min(s).alias("minimum"), F.avg(s).alias("mean"), F.max(s).alias("max"), F.stddev_samp(s).alias("stdev"),
        (F.max(s) - F.min(s)).alias("range"), F.try_divide(F.stddev_pop(s), F.max(s) - F.min(s)).alias("scaled_stdev"),
    )


def energy_histogram(df: DataFrame, by: list[str], energy: str, bins: int = 6) -> DataFrame:
    """Per group the number of rows whose energy lies k to k+1 above the group's lowest, k = 0..bins-1."""
    low = df.groupBy(*by).agg(F.min(energy).alias("_low"))
    d = F.col(energy) - F.col("_low")
    return null_safe_join(df, low, by).groupBy(*by).agg(*[F.count_if((d >= k) & (d < k + 1)).alias(f"DeltaG_{k}to{k + 1}") for k in range(bins)])


def class_shares(df: DataFrame, by: list[str], label: str, into: str) -> DataFrame:
    """Share of each label in its group (nulls are a label): by..., label, n, share."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    whole = df.groupBy(*by).agg(F.count("*").alias("_n"))
    return null_safe_join(counts, whole, by).withColumn(into, F.col("n") / F.col("_n")).drop("_n")


def type_counts(df: DataFrame, by: list[str], kind: str, vocabulary: list[str], prefix: str) -> DataFrame:
    """A column per word of a fixed vocabulary with its count, 0 where absent; other words count nowhere."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(kind) == v).alias(f"{prefix}{v}") for v in vocabulary])


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """avg, population deviation, standard error (sample), biased skewness. A single row has no error, a constant no skewness."""
    n = F.count(value)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"), (F.stddev_samp(value) / F.sqrt(n)).alias("stderr"),
        F.when(F.stddev_pop(value) > 0, F.skewness(value)).alias("skewness"),
    )
