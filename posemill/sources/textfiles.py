"""Text formats of screening runs: whitespace tables, SDF, MOL2, energy decompositions, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posemill.functions.names import make_structvar, pose_structvar, split_name
from posemill.operators.residues import TERMS

ENERGIES = ("Eint", "complexE", "ligandE_bound", "proteinE_bound")


def read_properties(spark: SparkSession, paths: str | list[str], columns: dict[str, str]) -> DataFrame:
    """CSV (gz) with a header: molname in lower case, its parts, and the given columns (name -> type).

    Names that do not hold their base name are impossible by construction; rows of other names have null parts.
    """
    head = spark.read.option("header", True).csv(paths)
    kept = head.select(F.lower("molname").alias("molname"), *[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns.items()])
    return kept.select("molname", *[c.alias(n) for n, c in split_name("molname").items()], *columns)


def _fields(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.text(paths).where(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(F.split(F.trim(F.regexp_replace(F.split("value", "#")[0], r"\s+", " ")), " ").alias("f"))


def read_activities(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whitespace table with # comments and no header: basemolname (lower case), is_active; short lines have a null label."""
    f = _fields(spark, paths)
    return f.select(F.lower(F.col("f")[0]).alias("basemolname"), F.get("f", F.lit(1)).try_cast("int").alias("is_active"))


def read_qm_scores(spark: SparkSession, paths: str | list[str], function: str, protein: str, header: bool = True) -> DataFrame:
    """Quantum-mechanical scores of one scoring function: CSV with a header, or whitespace text whose # line names the columns.

    Energies carry the function as a prefix; structvar is put together, protein is a literal.
    """
    if header:
        rows = spark.read.option("header", True).csv(paths).withColumnRenamed("molname", "basemolname")
    else:
        names = ["basemolname", "stereoisomer", "ionstate", "tautomer", "frame", "pose", *ENERGIES]
        f = _fields(spark, paths)
        rows = f.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    levels = ["stereoisomer", "ionstate", "tautomer", "frame", "pose"]
    base = F.lower("basemolname")
    return rows.select(
        F.lit(protein).alias("protein"), base.alias("basemolname"), *[F.col(c).try_cast("int").alias(c) for c in levels],
        make_structvar(base, *levels[:3]).alias("structvar"), *[F.col(e).try_cast("double").alias(f"{function}_{e}") for e in ENERGIES],
    )


def combine_scores(frames: list[DataFrame], how: str = "inner") -> DataFrame:
    """Scores of several functions side by side, natural inner or full join."""
    from posemill.operators.joins import natural_join

    return natural_join(*frames, how=how)


def read_net_charges(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """protein, structvar (lower case), net_charge from one CSV per protein whose header is replaced."""
    schema = T.StructType([T.StructField("structvar", T.StringType()), T.StructField("net_charge", T.IntegerType())])
    parts = [spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(p).select(F.lit(n).alias("protein"), F.lower("structvar").alias("structvar"), "net_charge") for n, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def read_entropies(spark: SparkSession, paths: str | list[str], value: str) -> DataFrame:
    head = spark.read.option("header", True).csv(paths)
    return head.select(F.lower("molname").alias("structvar"), F.col(value).try_cast("double").alias(value))


def free_ligand_minima(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """structvar, min_Energy, best_molname: column-wise minima per variant of a CSV with molname and Energy:."""
    head = spark.read.option("header", True).csv(paths).withColumn("molname", F.lower("molname"))
    rows = head.select("molname", pose_structvar("molname").alias("structvar"), F.col("`Energy:`").try_cast("double").alias("e"))
    return rows.where("structvar is not null").groupBy("structvar").agg(F.min("e").alias("min_Energy"), F.min("molname").alias("best_molname"))


def read_fingerprints(spark: SparkSession, paths: str | list[str], name: str, width: int) -> DataFrame:
    """A wide CSV of counts as name, fp ARRAY<SMALLINT>: one array column instead of thousands of columns."""
    schema = T.StructType([T.StructField(name, T.StringType())] + [T.StructField(f"c{i}", T.ShortType()) for i in range(width)])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("maxColumns", width + 64).csv(paths)
    return rows.dropna("any").select(F.lower(name).alias(name), F.array(*[f"c{i}" for i in range(width)]).alias("fp"))


def sdf_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """molname (first line) and text of the records of SDF files, which end in a line of four dollars."""
    text = spark.read.option("lineSep", "$$$$").text(paths)
    body = F.regexp_replace("value", r"^\r?\n", "")
    return text.select(body.alias("text")).where(~F.col("text").rlike(r"^\s*$")).select(F.trim(F.regexp_replace(F.split("text", "\n")[0], "\r", "")).alias("molname"), "text")


def sdf_properties(records: DataFrame, names: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """molname, property, value: a row per record and wanted property; the default (null without one) where it is absent."""
    def value(n: str) -> Column:
        pattern = rf"(?m)^> *<{n}>[^\n]*\n([^\r\n]*)"
        hit = F.when(F.col("text").rlike(pattern), F.trim(F.regexp_extract("text", pattern, 1)))
        return F.coalesce(hit, F.lit((defaults or {}).get(n)).cast("string"))

    pairs = F.array(*[F.struct(F.lit(n).alias("property"), value(n).alias("value")) for n in names])
    return records.select("molname", F.explode(pairs).alias("p")).select("molname", "p.property", "p.value")


def conformers(records: DataFrame, energy: str | None = None) -> DataFrame:
    """molname, n_conformers, energies in order, conf_energy: records of one name are conformers of one molecule.

    conf_energy holds them as ``id:value|id:value``, ids counted from 0 in the order of the energies.
    """
    value = sdf_properties(records, [energy]).select("molname", F.col("value").try_cast("double").alias("e")) if energy else records.select("molname", F.lit(None).cast("double").alias("e"))
    found = value.groupBy("molname").agg(F.count("*").alias("n_conformers"), F.array_sort(F.collect_list("e")).alias("energies"))
    return found.withColumn("conf_energy", F.concat_ws("|", F.transform("energies", lambda e, i: F.concat(i, F.lit(":"), e))))


def lowest_variants(parsed: DataFrame) -> DataFrame:
    """The parsed MOL2 records whose pose has the lowest energy of its variant (ties stay)."""
    from posemill.functions.names import structvar_of
    from posemill.operators.reduce import all_minima

    return all_minima(parsed.where("reason is null").withColumn("structvar", structvar_of("molname")), ["structvar"], "energy")


def mol2_to_sdf(parsed: DataFrame, into: str = "sdf") -> DataFrame:
    """id, molname and an SDF record (V2000) of every parsed MOL2 record without a reason; aromatic bonds are type 4, others of no number 1."""
    order = F.col
    atoms = F.transform("atoms", lambda a: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0  0  0  0", a["x"], a["y"], a["z"], F.regexp_extract(a["type"], "^([A-Za-z]+)", 1)))
    kind = lambda t: F.when(t == "ar", 4).when(t.rlike("^[123]$"), t.try_cast("int")).otherwise(1)
    bonds = F.transform("bonds", lambda b: F.format_string("%3d%3d%3d  0", b["a"], b["b"], kind(b["type"])))
    head = F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", F.size("atoms"), F.size("bonds"))
    lines = F.concat(F.array(order("molname"), F.lit("  posemill"), F.lit(""), head), atoms, bonds, F.array(F.lit("M  END")))
    energy = F.when(F.col("energy").isNotNull(), F.concat(F.lit("\n> <Energy>\n"), F.col("energy"), F.lit("\n"))).otherwise("")
    text = F.concat(F.array_join(lines, "\n"), energy, F.lit("\n$$$$\n"))
    return parsed.where("reason is null").select("id", "molname", text.alias(into))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of the files below a folder whose names match a glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def attach_conformer_property(conformer_rows: DataFrame, properties: DataFrame, name: str, pose: str) -> DataFrame:
    """Rows with the columns of properties, whose key ``molname`` is <name>_pose<pose>; rows without one get nulls."""
    keyed = conformer_rows.withColumn("molname", F.concat(F.col(name), F.lit("_pose"), F.col(pose)))
    return keyed.join(properties, "molname", "left")


def mol2_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """raw_text of the records of MOL2 files, each starting at its MOLECULE header."""
    text = spark.read.option("lineSep", "@<TRIPOS>MOLECULE").text(paths)
    return text.where(~F.col("value").rlike(r"^\s*$")).select(F.concat(F.lit("@<TRIPOS>MOLECULE"), "value").alias("raw_text"))


def lowest_energies(parsed: DataFrame) -> DataFrame:
    """molname, n_records, min_energy over the records of posemill.sources.rejects.parse_mol2 without a reason."""
    return parsed.where("reason is null").groupBy("molname").agg(F.count("*").alias("n_records"), F.min("energy").alias("min_energy"))


def smiles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """smiles, molname of .smi files; unnamed rows are called unk<i>, counted through from 1 in the order of files and lines.

    Rows are numbered by their place in a partition and the counts of the partitions before it, which come to the driver.
    """
    f = _fields(spark, paths).select(F.col("f")[0].alias("smiles"), F.get("f", F.lit(1)).alias("molname"))
    named = f.where("molname is not null")
    unnamed = f.where("molname is null").select("smiles", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"))
    before, offsets = 0, {-1: 0}
    for r in sorted(unnamed.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        offsets[r["_p"]], before = before, before + r["n"]
    start = F.try_element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), "_p")
    number = start + F.col("_i").bitwiseAND((1 << 33) - 1) + 1
    return named.unionByName(unnamed.select("smiles", F.concat(F.lit("unk"), number.cast("string")).alias("molname")))


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the file's ending: sdf, mol2, smi or ism (each also gz)."""
    ending = path.removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if ending == "sdf":
        return sdf_records(spark, path)
    if ending == "mol2":
        return mol2_records(spark, path)
    if ending in ("smi", "ism"):
        return smiles(spark, path)
    raise ValueError(f"unknown structure format {ending}")


def collect_runs(spark: SparkSession, folder: str, pattern: str = "comb*") -> DataFrame:
    """The rows of all <run>/<protein>_evaluation.csv[.gz] beside the parameters of <run>/hyper_parameters.list, with HYPER_PROTEIN.

    A list has one header line and then ``name<tab>value`` lines; its names, few, become text columns. Runs without either file give no rows.
    """
    run = F.regexp_extract("file", "([^/]+)/[^/]+$", 1)
    lists = spark.read.text(f"{folder}/{pattern}/hyper_parameters.list", wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("l"))
    lines = lists.select(run.alias("_run"), F.explode(F.expr("slice(l, 2, size(l))")).alias("x")).select("_run", F.split("x", "\t").alias("x")).where("size(x) > 1")
    params = lines.select("_run", F.col("x")[0].alias("param"), F.trim(F.col("x")[1]).alias("value")).groupBy("_run").pivot("param").agg(F.first("value"))
    found = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{pattern}/*_evaluation.csv*").select("*", F.input_file_name().alias("file"))
    protein = F.regexp_extract("file", "([^/_]+)_[^/]*$", 1)
    return found.select("*", run.alias("_run"), protein.alias("HYPER_PROTEIN")).drop("file").join(params, "_run").drop("_run")


def gather_csv(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, failed): all rows of CSV files with a header but for files that have a null anywhere, which are listed (file)."""
    rows = spark.read.schema(schema).option("header", True).csv(paths).select("*", F.input_file_name().alias("file"))
    names = [c for c in rows.columns if c != "file"]
    hole = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in names])
    failed = rows.where(hole).select("file").distinct()
    return rows.join(failed, "file", "left_anti").select(*names), failed


def missing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths at which there is nothing."""
    def there(p: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    return [p for p in paths if not there(p)]


def missing_names(wanted: DataFrame, loaded: DataFrame, name: str) -> DataFrame:
    """Names that were asked for but not loaded."""
    return wanted.select(name).distinct().join(loaded.select(name).distinct(), name, "left_anti")


def read_decomposition(spark: SparkSession, paths: str | list[str], ligand: str = "LIG") -> DataFrame:
    """Averaged energy decompositions: file, section, residue, term, mean, stdev, stderr of rows that pair a residue with the ligand.

    Section headers are lines without commas that end in a colon; rows have 20 comma fields. Only the second partner may be
    the ligand. Fields that are no numbers are null.
    """
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    up = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(r"^[^,]+:\s*$"), F.trim(F.regexp_replace("line", r":\s*$", "")))
    rows = whole.withColumn("section", F.last(head, ignorenulls=True).over(up)).withColumn("f", F.split("line", ","))
    rows = rows.where((F.size("f") == 20) & F.trim(F.col("f")[1]).startswith(ligand))
    terms = F.array(*[F.struct(F.lit(t).alias("term"), *[F.col("f")[2 + 3 * i + j].try_cast("double").alias(n) for j, n in enumerate(("mean", "stdev", "stderr"))]) for i, t in enumerate(TERMS)])
    return rows.select("file", "section", F.trim(F.col("f")[0]).alias("residue"), F.explode(terms).alias("t")).select("file", "section", "residue", "t.*")


def read_frame_decomposition(spark: SparkSession, paths: str | list[str], ligand: str = "LIG") -> DataFrame:
    """Per-frame decompositions: file, section, frame, residue, term, value of rows whose first residue is not the ligand."""
    whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    up = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(r"^[^,]+:\s*$"), F.trim(F.regexp_replace("line", r":\s*$", "")))
    rows = whole.withColumn("section", F.last(head, ignorenulls=True).over(up)).withColumn("f", F.split("line", ","))
    rows = rows.where((F.size("f") == 9) & F.trim(F.col("f")[2]).startswith(ligand) & F.col("f")[0].try_cast("int").isNotNull())
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.col("f")[3 + i].try_cast("double").alias("value")) for i, t in enumerate(TERMS)])
    return rows.select("file", "section", F.col("f")[0].cast("int").alias("frame"), F.trim(F.col("f")[1]).alias("residue"), F.explode(terms).alias("t")).select("file", "section", "frame", "residue", "t.*")


def scrape_metrics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row per log file with a column for every ``AUC-ROC = 0.91`` like line (the last of a name counts)."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("file"), "value")
    pattern = r"(AUC-[A-Z]+|DOR|MK)\s*[=:]\s*([-+0-9.eE]+)"
    hits = lines.where(F.col("value").rlike(pattern)).select("file", F.regexp_extract("value", pattern, 1).alias("metric"), F.regexp_extract("value", pattern, 2).try_cast("double").alias("x"))
    return hits.groupBy("file").pivot("metric", ["AUC-ROC", "AUC-CROC", "AUC-BEDROC", "DOR", "MK"]).agg(F.last("x"))


def incomplete_files(spark: SparkSession, paths: str | list[str], least: int = 5) -> DataFrame:
    """file, n_lines of files with fewer than ``least`` lines."""
    return spark.read.text(paths).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n_lines")).where(F.col("n_lines") < least)


def pdb_parts(spark: SparkSession, paths: str | list[str], ligand: str) -> DataFrame:
    """Atom lines of PDB files with the part (ligand or receptor) by the residue name in columns 18-20."""
    lines = spark.read.text(paths).where(F.col("value").rlike("^(ATOM|HETATM)"))
    part = F.when(F.trim(F.substring("value", 18, 3)) == ligand, "ligand").otherwise("receptor")
    return lines.select(F.input_file_name().alias("file"), part.alias("part"), F.col("value").alias("line"))
