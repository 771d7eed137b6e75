"""Per-residue energy tables: long rows (compound, residue, term, value) to fingerprints and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six terms of an energy decomposition, in file order.
TERMS = ("internal", "vdw", "electrostatic", "polar", "nonpolar", "total")


def residue_fingerprint(df: DataFrame, compound: str, residue: str, values: list[str], vocabulary: list | None = None) -> DataFrame:
    """compound, fingerprint: the values of every residue of the vocabulary in order, 0 where a compound lacks it.

    The vocabulary is the sorted set of residues of the table unless given (at most a few thousand per receptor; it is
    read to the driver). Several rows of one residue are averaged. Null residues are left out.
    """
    if vocabulary is None:
        vocabulary = sorted(r[0] for r in df.where(F.col(residue).isNotNull()).select(residue).distinct().collect())
    means = df.groupBy(compound, residue).agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(v) for v in values])
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(residue), F.array(*values))))
    table = means.where(F.col(residue).isNotNull()).groupBy(compound).agg(entries.alias("_m"))
    zero = F.array(*[F.lit(0.0)] * len(values))
    parts = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(r)), zero) for r in vocabulary]) if vocabulary else F.array().cast("array<array<double>>")
    return table.select(compound, F.flatten(parts).alias("fingerprint"))


STATISTICS = ("mean", "stdev", "stderr", "skewness")


def residue_statistics(df: DataFrame, compound: str, residue: str, term: str, value: str) -> DataFrame:
    """compound, residue, term, n and the STATISTICS of the values over all frames; a single frame has no error, a constant no skewness."""
    from posemill.operators.reduce import moments

    return moments(df.where(F.col(residue).isNotNull()), [compound, residue, term], value)


def statistics_fingerprint(
    stats: DataFrame, compound: str, residue: str, term: str, terms: tuple[str, ...] = TERMS, statistics: tuple[str, ...] = ("mean", "stdev"), vocabulary: list | None = None,
) -> DataFrame:
    """compound, fingerprint of residue_statistics: per residue of the vocabulary the chosen statistics of the chosen terms, term by term.

    Which terms and statistics are taken makes the variants: the mean of all six terms, mean and stdev of four or five of them
    with or without skewness, mean and stderr, the total alone, or everything. What is missing is 0.
    """
    names = [(t, s, f"{t}_{s}") for t in terms for s in statistics]
    wide = stats.groupBy(compound, residue).agg(*[F.coalesce(F.max(F.when(F.col(term) == t, F.col(s))), F.lit(0.0)).alias(n) for t, s, n in names])
    return residue_fingerprint(wide, compound, residue, [n for _, _, n in names], vocabulary)


def minmax_by_position(df: DataFrame, fingerprint: str, width: int) -> DataFrame:
    """Fingerprints whose entries repeat with a period of ``width``, each place of the period scaled by its own minimum and maximum over
    all fingerprints to 0..1; places of one value give 0."""
    from posemill.operators.joins import beside

    def of(j: int) -> Column:
        return F.filter(fingerprint, lambda x, i: i % width == j)  # noqa: ARG005

    lows = df.agg(F.array(*[F.min(F.array_min(of(j))) for j in range(width)]).alias("_lo"), F.array(*[F.max(F.array_max(of(j))) for j in range(width)]).alias("_hi"))
    part = lambda x, i: F.try_divide(x - F.get("_lo", i % width), F.get("_hi", i % width) - F.get("_lo", i % width))
    return beside(df, lows).withColumn(fingerprint, F.transform(fingerprint, lambda x, i: F.coalesce(part(x, i), F.lit(0.0)))).drop("_lo", "_hi")


def joint_minmax(df: DataFrame, fingerprint: str) -> DataFrame:
    """All fingerprints scaled by their joint minimum and maximum, then moved so that an original 0 stays 0."""
    from posemill.operators.joins import beside

    stats = df.select(F.array_min(fingerprint).alias("a"), F.array_max(fingerprint).alias("b")).agg(F.min("a").alias("_lo"), F.max("b").alias("_hi"))
    scaled = F.transform(fingerprint, lambda x: F.coalesce(F.try_divide(x, F.col("_hi") - F.col("_lo")), F.lit(0.0)))
    return beside(df, stats).withColumn(fingerprint, scaled).drop("_lo", "_hi")


def binned(df: DataFrame, fingerprint: str, deviation: str) -> DataFrame:
    """Fingerprint values as whole multiples (banker's rounding) of the fingerprint's largest deviation; 0 where that is 0."""
    most = F.array_max(deviation)
    return df.withColumn(fingerprint, F.transform(fingerprint, lambda x: F.coalesce(F.bround(F.try_divide(x, most)), F.lit(0.0)).cast("int")))


def complete_only(df: DataFrame, compound: str, residue: str, needed: int) -> DataFrame:
    """Rows of compounds that have at least ``needed`` distinct residues."""
    good = df.groupBy(compound).agg(F.count_distinct(residue).alias("n")).where(F.col("n") >= needed).select(compound)
    return df.join(good, compound, "left_semi")
