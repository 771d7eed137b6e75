"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posemill.functions.keys import base_of, clean_name, clean_protein
from posemill.llm.components import linked_groups, with_groups
from posemill.llm.cutoffs import keep_fraction_cutoffs, kept_records
from posemill.llm.leaks import leaked_items
from posemill.llm.mixing import mix_sources, mixture_report
from posemill.llm.neighbours import copies_of, greedy_search, neighbour_graph, neighbour_list, similar_pairs
from posemill.llm.percentiles import log_sketch, merge_sketches, sketch_percentiles
from posemill.llm.screening import current_poses, keep_targets, scored_records
from posemill.llm.splits import assign_splits
from posemill.llm.stuffing import list_pages
from posemill.llm.topn import top_n_per_group
from posemill.runtime import Scratch, table

BY_SET = ["record_set", "protein"]
TOP = 5
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
ERROR = 0.01
VECTOR = [f"plec_ump{i}" for i in range(1, 41)]


def _daily_sketch(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "features_df").select(
        clean_protein("protein").alias("protein"), F.to_date("loaded_at").alias("day"), "nofusion_Eint"
    )
    return log_sketch(rows.where("protein is not null"), ["protein", "day"], "nofusion_Eint", ERROR)


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Per protein and day, and per protein (day null) merged from the days' sketches."""
    days = Scratch(spark, "sketch").cut(_daily_sketch(spark, folder))
    merged = merge_sketches(days, ["protein"]).withColumn("day", F.lit(None).cast("date"))
    out = sketch_percentiles(days.unionByName(merged), ["protein", "day"], PERCENTILES, ERROR)
    return out.select("protein", "day", "n_values", "share", F.round("estimate", 4).alias("estimate"))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    name = F.coalesce(clean_name("basemolname"), base_of(clean_name("structvar")))
    return table(spark, folder, "features_df").select("feature_id", name.alias("name"), "is_active")


def _groups(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    links = table(spark, folder, "mol_links").select(clean_name("name_a").alias("a"), clean_name("name_b").alias("b"))
    return linked_groups(names, "name", links, "a", "b")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    names = _names(spark, folder)
    return with_groups(names, "name", _groups(spark, folder, names)).where("n_records >= 2").select("feature_id", "group_name")


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    names = _names(spark, folder)
    named = with_groups(names.where("name is not null"), "name", _groups(spark, folder, names)).select("feature_id", "group_name", "is_active")
    nameless = names.where("name is null").select("feature_id", F.lit(None).cast("string").alias("group_name"), "is_active")
    grouped = Scratch(spark, "grouped").cut(named.unionByName(nameless))
    return grouped.join(assign_splits(grouped, "feature_id", "group_name", "is_active", SHARES), "feature_id")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records, groups and positive share of every split."""
    rows = p3_splits(spark, folder)
    n = F.sum(F.count("*")).over(Window.partitionBy())
    return rows.groupBy("split").agg(
        F.count("*").alias("n_records"), F.round(F.count("*") / n, 6).alias("share"), F.round(F.avg("is_active"), 6).alias("active_share")
    )


def _cutoffs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = Scratch(spark, "records").cut(scored_records(spark, folder))
    return records, keep_fraction_cutoffs(records, keep_targets(spark, folder), BY_SET, "score", "keep_permille")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    records, cutoffs = _cutoffs(spark, folder)
    return kept_records(records, cutoffs, BY_SET, "score").select("record_set", "protein", "record_key")


def p2_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return _cutoffs(spark, folder)[1].select("record_set", "protein", "n_records", "keep_permille", "cutoff", "n_kept")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "features_df").select("feature_id", clean_name("structvar").alias("variant"), *VECTOR)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    graph = neighbour_graph(rows, "feature_id", "variant", VECTOR)
    pairs = similar_pairs(rows, "feature_id", "variant", VECTOR, graph, 0.99)
    return pairs.select(F.col("id_a").alias("feature_id_a"), F.col("id_b").alias("feature_id_b"))


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest rows of other variants for one row of each class of exact copies; p5_copies has the classes."""
    graph = neighbour_graph(_vectors(spark, folder), "feature_id", "variant", VECTOR)
    return neighbour_list(graph, 10).withColumnsRenamed({"id": "feature_id", "neighbour": "neighbour_id"})


def p5_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest rows for the rows whose id is divisible by 100, by greedy search on the graph of all rows."""
    rows = _vectors(spark, folder)
    graph = neighbour_graph(rows, "feature_id", "variant", VECTOR)
    found = greedy_search(graph, rows.where("feature_id % 100 = 0"), "feature_id", "variant", VECTOR, 10)
    return found.withColumnsRenamed({"query": "feature_id", "neighbour": "neighbour_id"})


def p5_copies(spark: SparkSession, folder: str) -> DataFrame:
    return copies_of(_vectors(spark, folder), "feature_id", "variant", VECTOR)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    poses = current_poses(table(spark, folder, "scores_df")).select("structvar", "frame", "pose", "score")
    variants = Scratch(spark, "variants").cut(top_n_per_group(poses, ["structvar"], "score", ["pose", "frame"], TOP))
    # a molecule's best poses are among its variants' best: the order inside a variant is the same
    of_molecules = variants.withColumn("basemolname", base_of("structvar"))
    molecules = top_n_per_group(of_molecules, ["basemolname"], "score", ["structvar", "pose", "frame"], TOP)
    cols = ["structvar", "pose", "frame"]
    return variants.select(F.lit("structvar").alias("group_level"), F.col("structvar").alias("group_key"), *cols).unionByName(
        molecules.select(F.lit("basemolname").alias("group_level"), F.col("basemolname").alias("group_key"), *cols)
    )


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).where("edits = 0").select("doc_id", "item_id")


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").select("doc_id", "text", clean_name("source").alias("source"))
    targets = table(spark, folder, "mix_targets").select(clean_name("source").alias("source"), "target_permille", "max_repeats")
    return mix_sources(documents, targets, "doc_id", "text", "source", "target_permille", "max_repeats")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixture_report(*_mixture(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return list_pages(table(spark, folder, "documents"), "doc_id", "text").where("share > 0.5").select("doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return list_pages(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict:
    return {
        "p1_percentiles": p1_percentiles,
        "p2_found": p2_found,
        "p2_cutoffs": p2_cutoffs,
        "p3_found": p3_found,
        "p3_splits": p3_splits,
        "p3_report": p3_report,
        "p5_found": p5_found,
        "p5_neighbours": p5_neighbours,
        "p5_search": p5_search,
        "p5_copies": p5_copies,
        "p6_found": p6_found,
        "p7_found": p7_found,
        "p7_leaks": p7_leaks,
        "p8_mixture": p8_mixture,
        "p8_report": p8_report,
        "p9_found": p9_found,
        "p9_shares": p9_shares,
    }


_MISSING = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_CURRENT = f"""current AS (SELECT * FROM (SELECT lower(trim(structvar)) AS structvar, frame, pose, nullif(upper(trim(protein)), '') AS protein, {_MISSING.format("r_i_docking_score")} AS score,
 row_number() OVER (PARTITION BY lower(trim(structvar)), frame, pose ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn FROM scores_df) WHERE rn = 1)"""
_RECORDS = f"""{_CURRENT}, homes AS (SELECT lower(trim(structvar)) AS structvar, max(nullif(upper(trim(protein)), '')) AS protein FROM scores_df GROUP BY 1),
 records AS (SELECT 'scores_df' AS record_set, h.protein, c.structvar AS record_key, min(score) AS score FROM current c JOIN homes h USING (structvar) WHERE score IS NOT NULL AND h.protein IS NOT NULL GROUP BY 1, 2, 3
 UNION ALL SELECT 'hyper_opt_df', nullif(upper(trim(HYPER_PROTEIN)), ''), CAST(run_id AS VARCHAR), {_MISSING.format("r_i_docking_score")} FROM hyper_opt_df
 WHERE nullif(upper(trim(HYPER_PROTEIN)), '') IS NOT NULL AND r_i_docking_score IS NOT NULL AND NOT isnan(r_i_docking_score)),
 counted AS (SELECT *, count(*) OVER (PARTITION BY record_set, protein) AS n, count(*) OVER (PARTITION BY record_set, protein ORDER BY score) AS upto FROM records),
 cutoffs AS (SELECT c.record_set, c.protein, max(n) AS n_records, max(t.keep_permille) AS keep_permille, min(score) AS cutoff FROM counted c
 JOIN keep_targets t ON t.record_set = c.record_set AND upper(trim(t.protein)) = c.protein WHERE 1000 * upto >= keep_permille * n GROUP BY 1, 2)"""
_NAMES = """names AS (SELECT feature_id, is_active, coalesce(nullif(lower(trim(basemolname)), ''), nullif(regexp_extract(lower(trim(structvar)), '^(.+)_stereo[0-9]+_ion[0-9]+_tau[0-9]+$', 1), '')) AS name FROM features_df)"""
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def oracle_sql() -> dict[str, str]:
    gamma, percent = (1 + ERROR) / (1 - ERROR), ", ".join(f"({s})" for s in PERCENTILES)
    vector = ", ".join(f"CAST({v} AS DOUBLE)" for v in VECTOR)
    sums = " + ".join(f"coalesce(CAST({v} AS DOUBLE), 'nan'::DOUBLE)" for v in VECTOR)
    return {
        "p1_percentiles": f"""WITH v AS (SELECT nullif(upper(trim(protein)), '') AS protein, CAST(loaded_at AS DATE) AS day, nofusion_Eint AS x FROM features_df
 WHERE nofusion_Eint IS NOT NULL AND NOT isnan(nofusion_Eint) AND nullif(upper(trim(protein)), '') IS NOT NULL),
 r AS (SELECT protein, day, x FROM v UNION ALL SELECT protein, NULL, x FROM v),
 n AS (SELECT *, row_number() OVER (PARTITION BY protein, day ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY protein, day) AS n_values FROM r)
 SELECT protein, day, n_values, CAST(share AS DOUBLE) AS share, round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * pow({gamma!r}, ceil(ln(abs(x)) / ln({gamma!r}))) * 2 / ({gamma!r} + 1) END, 4) AS estimate
 FROM n, (VALUES {percent}) s(share) WHERE k = floor(CAST(share AS DOUBLE) * (n_values - 1))""",
        "p2_found": f"WITH {_RECORDS} SELECT r.record_set, r.protein, r.record_key FROM records r JOIN cutoffs c USING (record_set, protein) WHERE r.score <= c.cutoff",
        "p2_cutoffs": f"""WITH {_RECORDS} SELECT record_set, protein, n_records, keep_permille, cutoff, count(*) AS n_kept FROM cutoffs JOIN records USING (record_set, protein) WHERE score <= cutoff GROUP BY ALL""",
        "p3_found": f"""WITH RECURSIVE {_NAMES}, links AS (SELECT DISTINCT lower(trim(name_a)) AS a, lower(trim(name_b)) AS b FROM mol_links WHERE trim(name_a) <> '' AND trim(name_b) <> ''),
 edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT DISTINCT name AS s, name AS t FROM names WHERE name IS NOT NULL UNION SELECT s, b FROM reach JOIN edges ON t = a),
 roots AS (SELECT s, min(t) AS root FROM reach WHERE t IN (SELECT name FROM names) GROUP BY 1), sized AS (SELECT feature_id, root, count(*) OVER (PARTITION BY root) AS n FROM names JOIN roots ON name = s)
 SELECT feature_id, root AS group_name FROM sized WHERE n >= 2""",
        "p5_found": f"""WITH v AS (SELECT feature_id, lower(trim(structvar)) AS s, CAST([{vector}] AS DOUBLE[40]) AS x FROM features_df WHERE NOT isnan({sums})),
 w AS (SELECT * FROM v WHERE array_inner_product(x, x) > 0)
 SELECT a.feature_id AS feature_id_a, b.feature_id AS feature_id_b FROM w a JOIN w b ON a.feature_id < b.feature_id AND a.s <> b.s WHERE array_cosine_similarity(a.x, b.x) >= 0.99""",
        "p5_copies": f"""WITH v AS (SELECT feature_id, lower(trim(structvar)) AS s, {", ".join(f"CAST({v} AS DOUBLE) + 0.0 AS {v}" for v in VECTOR)} FROM features_df WHERE NOT isnan({sums})),
 w AS (SELECT feature_id AS member, min(feature_id) OVER (PARTITION BY s, {", ".join(VECTOR)}) AS representative, count(*) OVER (PARTITION BY s, {", ".join(VECTOR)}) AS n FROM v)
 SELECT representative, member FROM w WHERE n > 1""",
        "p6_found": f"""WITH {_CURRENT}, c AS (SELECT *, nullif(regexp_extract(structvar, '^(.+)_stereo[0-9]+_ion[0-9]+_tau[0-9]+$', 1), '') AS base FROM current WHERE score IS NOT NULL),
 l AS (SELECT 'structvar' AS group_level, structvar AS group_key, * FROM c UNION ALL SELECT 'basemolname', base, * FROM c WHERE base IS NOT NULL)
 SELECT group_level, group_key, structvar, pose, frame FROM (SELECT *, row_number() OVER (PARTITION BY group_level, group_key ORDER BY score, structvar, pose, frame) AS k FROM l) WHERE k <= {TOP}""",
        "p7_found": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 14], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 1))) AS k FROM i)),
 dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 14], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 13, 1))) AS k FROM d))
 SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (t)""",
    }
