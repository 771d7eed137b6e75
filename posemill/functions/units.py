"""Conversions between affinities and energies, and shapes of inhibition values."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RT = 0.5957632602
KCAL_PER_KJ = 0.238846
MICRO = 1e6
PERCENT = 1e2


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ki_to_energy(ki: Column | str, original: bool = True) -> Column:
    """RT ln(K/1e6), or /1e2 for values in percent; null where K <= 0."""
    c = _col(ki)
    return F.when(c > 0, F.log(c / (MICRO if original else PERCENT)) * RT)


def energy_to_kd(energy: Column | str, original: bool = True) -> Column:
    return F.exp(_col(energy) / RT) * (MICRO if original else PERCENT)


def kj_to_kcal(energy: Column | str) -> Column:
    return _col(energy) * KCAL_PER_KJ


def _beside(df: DataFrame, one: DataFrame) -> DataFrame:
    from posemill.operators.joins import beside

    return beside(df, one)


def odds_scale(df: DataFrame, column: str, into: str, by: list[str] | None = None, negate: bool = False) -> DataFrame:
    """Shift to >= 0, then y/(top-y) with top = 101 where the largest y is at most 100, else largest + 1. Nulls stay null."""
    stats = _stats(df, column, by, F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    shift = F.when(F.col("_lo") < 0, -F.col("_lo")).otherwise(0.0)
    y, most = F.col(column) + shift, F.col("_hi") + shift
    value = y / (F.when(most <= 100, F.lit(101.0)).otherwise(most + 1) - y)
    return stats.withColumn(into, -value if negate else value).drop("_lo", "_hi")


def _stats(df: DataFrame, column: str, by: list[str] | None, *aggs: Column) -> DataFrame:
    """Aggregates of few values joined back to every row: pre-aggregated, so no group is gathered in one task."""
    from posemill.operators.joins import beside, null_safe_join

    return beside(df, df.agg(*aggs)) if not by else null_safe_join(df, df.groupBy(*by).agg(*aggs), by, "left")


def melting_to_energy(df: DataFrame, column: str, into: str, by: list[str] | None = None) -> DataFrame:
    """-(12 ** m) with m the value scaled to [0.7, 1]; a constant column scales to 0.7."""
    stats = _stats(df, column, by, F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    part = F.coalesce(F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.col(column) * 0)
    return stats.withColumn(into, -F.pow(F.lit(12.0), part * 0.3 + 0.7)).drop("_lo", "_hi")


def melting_to_kd(df: DataFrame, column: str, into: str, by: list[str] | None = None) -> DataFrame:
    """Dissociation constant of melting_to_energy."""
    return melting_to_energy(df, column, into, by).withColumn(into, energy_to_kd(into))


def active_cutoff(df: DataFrame, energy: str, into: str, by: list[str] | None = None, fold: float = 100.0) -> DataFrame:
    """1 where the energy is below (smallest energy + RT ln fold) of its group, else 0; null stays null."""
    stats = _stats(df, energy, by, F.min(energy).alias("_lo"))
    return stats.withColumn(into, (F.col(energy) < F.col("_lo") + RT * log(fold)).cast("int")).drop("_lo")


def relative_to(df: DataFrame, column: str, into: str, name: str, reference: str, reference_value: float) -> DataFrame:
    """Values scaled so that the reference compound has reference_value; null where it has none."""
    value = df.where(F.col(name) == reference).agg(F.first(column, ignorenulls=True).alias("_ref"))
    return _beside(df, value).withColumn(into, F.try_divide(F.col(column) * reference_value, F.col("_ref"))).drop("_ref")


SHAPES = ("none", "zscore", "minmax", "maxabs", "robust", "uniform", "normal", "l2", "odds", "energy", "energy_tenth", "energy_scaled")


def inhibition_shape(df: DataFrame, column: str, into: str, mode: str | int) -> DataFrame:
    """An inhibition, the higher the better, as a score, the lower the better, in one of twelve shapes (by name or number in SHAPES).

    none leaves it as it is. zscore, minmax (to 0..0.8), maxabs, robust (median and quartile range), uniform (average rank as a share),
    normal (its probit within +-5.2) and l2 are negated. odds is 1000 times the negated odds_scale. The energies are
    ki_to_energy in percent of 1/(y+1), of 0.1/(y+1) and of 1/(y'+1) with y' scaled to 0.001..1000. Constant columns give 0 where a spread
    divides (y' = 0.001). Nulls and NaN give null.
    """
    mode = SHAPES[mode] if isinstance(mode, int) else mode
    if mode == "none":
        return df.withColumn(into, F.col(column))
    raw = F.col(column).cast("double")
    c = F.when(~F.isnan(raw), raw)
    if mode in ("energy", "energy_tenth"):
        return df.withColumn(into, ki_to_energy((1.0 if mode == "energy" else 0.1) / (c + 1), original=False))
    if mode == "odds":
        out = odds_scale(df.withColumn("_odds_of", c), "_odds_of", into, negate=True)
        return out.withColumn(into, F.col(into) * 1000).drop("_odds_of")
    if mode == "energy_scaled":
        part = F.coalesce(F.try_divide(c - F.col("_a"), F.col("_b") - F.col("_a")), c * 0)
        y = part * (1000.0 - 0.001) + 0.001
        return _stats(df, column, None, F.min(c).alias("_a"), F.max(c).alias("_b")).withColumn(into, ki_to_energy(1 / (y + 1), original=False)).drop("_a", "_b")
    aggs = {
        "zscore": (F.avg(c).alias("_a"), F.stddev_pop(c).alias("_b")),
        "minmax": (F.min(c).alias("_a"), ((F.max(c) - F.min(c)) / 0.8).alias("_b")),
        "maxabs": (F.lit(0.0).alias("_a"), F.max(F.abs(c)).alias("_b")),
        "l2": (F.lit(0.0).alias("_a"), F.sqrt(F.sum(c * c)).alias("_b")),
    }
    scaled = -F.coalesce(F.try_divide(c - F.col("_a"), F.col("_b")), c * 0)
    if mode in aggs:
        return _stats(df, column, None, *aggs[mode]).withColumn(into, scaled).drop("_a", "_b")
    if mode == "robust":
        from posemill.operators.quantiles import group_quantiles

        q = group_quantiles(df, [], column, {"_q1": 0.25, "_a": 0.5, "_q3": 0.75})
        return _beside(df, q).withColumn("_b", F.col("_q3") - F.col("_q1")).withColumn(into, scaled).drop("_q1", "_a", "_q3", "_b")
    if mode not in ("uniform", "normal"):
        raise ValueError(f"unknown mode {mode}")
    from posemill.operators.ranking import distinct_ranks

    ranked = distinct_ranks(df.where(c.isNotNull()), column)
    n = F.col("_total")
    share = F.when(n > 1, (F.col("_before") + (F.col("_ties") - 1) / 2) / (n - 1)).otherwise(0.0)
    if mode == "normal":
        share = _probit(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), share)))
    return df.join(ranked.select(column, (-share).alias(into)), column, "left")


def _probit(p: Column) -> Column:
    """Inverse of the normal distribution by the rational approximation of Abramowitz and Stegun 26.2.23 (error < 4.5e-4)."""
    t = F.sqrt(F.log(F.least(p, 1 - p)) * -2)
    # Coefficients of the formula.
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)
