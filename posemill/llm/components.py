"""Connected components by hooking and shortcutting over a parent table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posemill.llm.hot import hot_limit, join_groups
from posemill.runtime import Scratch


def _looked_up(rows: DataFrame, key: str, table: DataFrame, limit: int) -> DataFrame:
    """Inner join of rows with a table that has one row per ``key``, keys of more than ``limit`` rows apart from the others."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= limit:
        return rows.join(table, key)
    return join_groups(rows, table.join(sizes, key), [key], "_n", limit).drop("_n")


def connected_components(links: DataFrame, a: str, b: str, hot_rows: int | None = None) -> DataFrame:
    """(node, root) for every name in ``links``; root is the smallest name of its component.

    Every round hooks each tree onto the smallest grandparent seen across a link (both the node and its parent take
    it) and halves the paths to the roots, all as joins on the parent table; rounds grow with the logarithm of the
    component size, not with its diameter. The table is written each round, so lineage stays flat, and only the count
    of rows that moved comes to the driver. Minima are aggregated map-side, and links of a hot name, like the names below a hot parent,
    meet it in a broadcast of the hot names alone (at most 1000), so neither a name with a third of all links nor a
    component with a third of all names is gathered in one task.

    Defined cases: links with a null end or to itself add no connection (a self link still lists its name); repeated
    and reversed links count once; an empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(links.sparkSession, "components")
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edges = scratch.cut(pairs.union(pairs.select("v", "u")).distinct())
    parents = scratch.cut(edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("p")))
    n_edges = edges.count()
    limit = hot_limit(n_edges) if hot_rows is None else hot_rows
    small = n_edges <= limit  # then nothing can be hot

    def looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
        return rows.join(table, key) if small else _looked_up(rows, key, table, limit)

    while True:
        up = looked_up(parents, "p", parents.select(F.col("n").alias("p"), F.col("p").alias("g"))).select("n", "p", "g")
        up = scratch.cut(up)
        seen = looked_up(edges, "v", up.select(F.col("n").alias("v"), "g")).groupBy("u").agg(F.min("g").alias("g"))
        near = scratch.cut(up.join(seen.select(F.col("u").alias("n"), F.col("g").alias("s")), "n").select("n", "p", F.least("g", "s").alias("s")))
        hooks = near.select("n", "s").union(near.select("p", "s")).groupBy("n").agg(F.min("s").alias("s"))
        after = scratch.cut(
            up.join(hooks, "n", "left").select("n", F.least("p", "g", "s").alias("q"), (F.least("p", "g", "s") != F.col("p")).alias("moved"))
        )
        moved = after.where("moved").limit(1).count()
        scratch.drop(parents, up, near)
        parents = after.select("n", F.col("q").alias("p"))
        parents._scratch = after._scratch
        if not moved:
            return parents.select(F.col("n").alias("node"), F.col("p").alias("root"))


def linked_groups(names: DataFrame, name: str, links: DataFrame, a: str, b: str) -> DataFrame:
    """Group of every distinct non-null name of ``names``: columns name, n_name (its records), group_name, n_records.

    Names are in one group if ``links`` joins them over any number of links, through names that no record carries
    too. group_name is the first of the group's names among those that records carry, n_records its records.
    """
    scratch = Scratch(names.sparkSession, "names")
    counts = scratch.cut(names.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n_name")))
    roots = counts.join(connected_components(links, a, b).withColumnRenamed("node", "name"), "name", "left")
    roots = scratch.cut(roots.withColumn("root", F.coalesce("root", "name")))
    groups = scratch.cut(roots.groupBy("root").agg(F.min("name").alias("group_name"), F.sum("n_name").alias("n_records"), F.count("*").alias("_names")))
    total, most = groups.agg(F.sum("_names"), F.max("_names")).first()
    hot = hot_limit(total or 0)
    return join_groups(roots, groups, ["root"], "_names", hot if (most or 0) > hot else None).select("name", "n_name", "group_name", "n_records")


def with_groups(rows: DataFrame, name: str, groups: DataFrame) -> DataFrame:
    """rows that have a name in linked_groups, with group_name and n_records; names with very many rows meet a broadcast."""
    total, most = groups.agg(F.sum("n_name"), F.max("n_name")).first()
    hot = hot_limit(total or 0)
    renamed = groups.withColumnRenamed("name", name)
    return join_groups(rows, renamed, [name], "n_name", hot if (most or 0) > hot else None).drop("n_name")
