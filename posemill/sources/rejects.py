"""Loading of raw fingerprint lines and MOL2 records that keeps broken rows apart, with the first reason that applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = 128
_VARIANT = r"_stereo[0-9]+_ion[0-9]+_tau[0-9]+_pose[0-9]+"
_COMPLEX = rf"(?i)^[^\s]+{_VARIANT}_frm[0-9]+$"
_POSE = rf"(?i)^[^\s]+{_VARIANT}$"
# A field in double quotes with inner quotes doubled; possessive, so the matcher needs no stack on long lines.
_QUOTED = r'"(?:[^"]++|"")*+"'
_FIELDS = rf'^(?:{_QUOTED}|[^",]*+)(?:,(?:{_QUOTED}|[^",]*+))*+$'
_COUNT = r"^\s*0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\s*$"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def fingerprint_schema(counts: int = COUNTS) -> T.StructType:
    """complex_name, the counts as SMALLINT, and the raw text of a line the reader could not fit."""
    fields = [T.StructField("complex_name", T.StringType())] + [T.StructField(f"c{i}", T.ShortType()) for i in range(counts)]
    return T.StructType([*fields, T.StructField("_corrupt", T.StringType())])


def read_fingerprint_lines(lines: DataFrame, line_id: str, raw: str, counts: int = COUNTS) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected) of CSV lines ``complex_name,c0..``.

    loaded: line_id, complex_name (lower case), counts ARRAY<SMALLINT>; rejected: line_id, reason, raw text. Lines are
    read permissively under fingerprint_schema; what the reader set aside as corrupt, and what it took in although the
    format may forbid it (signs, blanks, missing values, values over 255), is classified again by these checks in order:
    quoting, column_count, bad_name, bad_value; what passes them all is loaded. One pass of column expressions, no shuffle.

    Defined cases: null, blank and header lines (first field ``complex_name`` in any case) are neither loaded nor rejected;
    repeated lines each count; a null id is kept; an empty table gives two empty results. Other columns are ignored.
    """
    text = F.regexp_replace(F.col(raw), r"[\r\n]+$", "")
    rows = lines.select(F.col(line_id).alias("id"), text.alias("line")).where(
        "line is not null and trim(line) <> ''"
    ).where(~F.col("line").rlike(r'(?is)^\s*"?complex_name"?\s*(,.*)?$'))
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"', "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true", "maxCharsPerColumn": "-1", "maxColumns": "1000000",
    }
    schema = fingerprint_schema(counts)
    # the reader sees only lines whose quotes pair up: others would run on over the end of the record
    paired = F.col("line").rlike(_FIELDS)
    bare = F.regexp_replace("line", _QUOTED, "q")
    first = F.regexp_extract("line", rf'^({_QUOTED}|[^",]*+)', 1)
    name = F.when(first.startswith('"'), F.regexp_replace(F.regexp_replace(first, '^"|"$', ""), '""', '"')).otherwise(first)
    rest = F.expr("substring(line, length(_first) + 2)")
    values = F.transform(F.split(rest, ","), lambda v: F.regexp_replace(v, r'^"([^"]*)"$', "$1"))
    parsed = F.from_csv(F.col("line"), schema.simpleString()[7:-1].replace(":", " "), options)
    checked = (
        rows.withColumn("_first", first)
        .withColumn("name", name)
        .withColumn("width", F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1)
        .withColumn("p", F.explode(F.array(F.when(paired, parsed))))  # a row of its own, so a line is parsed only once
    )
    strict = F.forall(values, lambda v: v.rlike(_COUNT))
    typed = F.array(*[F.col(f"p.c{i}") for i in range(counts)])
    # what the reader fitted is clean if it is plain digits in range; all else is looked at again
    clean = (
        paired & F.col("p._corrupt").isNull() & F.col("name").rlike(_COMPLEX) & rest.rlike("^[0-9,]*$")
        & F.forall(typed, lambda v: F.coalesce((v >= 0) & (v <= 255), F.lit(False)))
    )
    reason = (
        F.when(clean, F.lit(None).cast("string"))
        .when(~paired, "quoting")
        .when(F.col("width") != counts + 1, "column_count")
        .when(~F.col("name").rlike(_COMPLEX), "bad_name")
        .when(~strict, "bad_value")
    )
    judged = checked.withColumn("reason", reason)
    recast = F.transform(values, lambda v: F.trim(v).try_cast("smallint"))
    loaded = judged.where("reason is null").select(
        F.col("id").alias(line_id), F.lower("name").alias("complex_name"), F.when(F.col("p._corrupt").isNull(), typed).otherwise(recast).alias("counts")
    )
    return loaded, judged.where("reason is not null").select(F.col("id").alias(line_id), "reason", F.col("line").alias("raw"))


ATOM_LINE = "number double, name string, x double, y double, z double, type string, residue_id string, residue string, charge double"
BOND_LINE = "number double, a double, b double, type string"
_ANY = "[^ ]+"
_REAL = _NUMBER[1:-1]
_STRICT = {ATOM_LINE: f"^{_REAL} {_ANY} {_REAL} {_REAL} {_REAL} {_ANY} {_ANY} {_ANY} {_REAL}$", BOND_LINE: f"^{_REAL} {_REAL} {_REAL} {_ANY}$"}


def _finite(c: Column) -> Column:
    """Whether a text is a finite number; null counts as none."""
    value = c.try_cast("double")
    return F.coalesce(c.rlike(_NUMBER) & (F.abs(value) < float("inf")), F.lit(False))


def _whole(c: Column) -> Column:
    """Whether a text is a finite number without a fraction."""
    return _finite(c) & F.coalesce(c.try_cast("double") == F.rint(c.try_cast("double")), F.lit(False))


def _read_lines(lines: Column, schema: str) -> Column:
    """Every line of a block as a struct of its schema, with ``fault``: null, column_count or bad_value.

    Lines, their fields parted by single blanks, are read permissively; ``_corrupt`` keeps the raw text of those the reader could
    not fit, and only these and what it took in too leniently are classified again, by the number of fields and then by casts.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "sep": " ", "quote": "", "comment": "", "maxCharsPerColumn": "-1"}
    fields = [f.split()[0] for f in schema.split(", ")]
    numbers = [f.split()[0] for f in schema.split(", ") if f.endswith(" double")]
    read = F.transform(lines, lambda x: F.struct(x.alias("line"), F.from_csv(x, f"{schema}, _corrupt string", options).alias("p")))

    def judged(x: Column) -> Column:
        finite = F.lit(True)
        for n in numbers:
            finite = finite & (F.abs(x["p"][n]) < float("inf"))
        clean = x["p"]["_corrupt"].isNull() & F.coalesce(finite, F.lit(False)) & x["line"].rlike(_STRICT[schema])
        fault = F.when(clean, F.lit(None).cast("string")).when(F.size(F.split(x["line"], " ")) != len(fields), "column_count").otherwise("bad_value")
        return F.struct(*[x["p"][f].alias(f) for f in fields], fault.alias("fault"))

    return F.transform(read, judged)


def parse_mol2(records: DataFrame, record_id: str, raw: str) -> DataFrame:
    """Every record with its parts and the first reason why it is broken (null: none).

    Columns: id, molname (lower case), energy, atoms ARRAY<STRUCT<number, name, x, y, z, type, charge>>, bonds
    ARRAY<STRUCT<number, a, b, type>>, reason, raw. Reasons in order: missing_section, bad_name, column_count, bad_value,
    count_mismatch. Atom and bond lines are read permissively under ATOM_LINE and BOND_LINE, see _read_lines. Lines end in
    LF or CR LF, fields are parted by blanks or tabs, blank lines and lines starting with ``#`` are skipped inside the
    blocks; other sections are passed over. The two counts number lines, so a fraction in one is a bad value. A null record
    misses its sections.
    """
    lines = F.transform(F.split(F.coalesce(F.col(raw), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  # keeps a derived column from being computed at every use
    rows = records.select(F.col(record_id).alias("id"), F.col(raw).alias("raw"), once(lines).alias("lines"))
    heads = F.transform("lines", lambda x: F.when(x.rlike(r"^\s*@<TRIPOS>"), F.upper(F.regexp_extract(x, r"^\s*@<TRIPOS>(\S*)", 1))))
    rows = rows.withColumn("heads", once(heads))

    def start(section: str) -> Column:
        return F.array_position("heads", F.lit(section)).cast("int")

    def block(section: str) -> Column:
        """Lines between a section's header and the next one, their fields parted by single blanks."""
        after = F.col(f"at_{section}")
        tail = F.slice("heads", after + 1, F.greatest(F.lit(0), F.size("heads") - after))
        length = F.array_position(F.transform(tail, lambda h: h.isNotNull()), F.lit(True)).cast("int") - 1
        inner = F.slice("lines", after + 1, F.when(length < 0, F.greatest(F.lit(0), F.size("lines") - after)).otherwise(length))
        tidy = F.transform(F.filter(inner, lambda x: ~x.startswith("#")), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
        return F.when(after > 0, F.filter(tidy, lambda x: x != "")).otherwise(F.array().cast("array<string>"))

    for s in ("MOLECULE", "ATOM", "BOND"):
        rows = rows.withColumn(f"at_{s}", start(s))
    rows = rows.withColumn("blocks", once(F.struct(block("ATOM").alias("ATOM"), block("BOND").alias("BOND"))))
    read = F.struct(_read_lines(F.col("blocks.ATOM"), ATOM_LINE).alias("ATOM"), _read_lines(F.col("blocks.BOND"), BOND_LINE).alias("BOND"))
    rows = rows.withColumn("read", once(read)).withColumn("ATOM", F.col("read.ATOM")).withColumn("BOND", F.col("read.BOND"))
    name = F.regexp_replace(F.coalesce(F.get("lines", F.col("at_MOLECULE")), F.lit("")), r"^[ \t]+|[ \t]+$", "")
    counts = F.split(F.trim(F.translate(F.coalesce(F.get("lines", F.col("at_MOLECULE") + 1), F.lit("")), "\t", " ")), " +")
    energy = F.get(F.filter("lines", lambda x: x.rlike(r"(?i)^\s*energy:")), F.lit(0))
    energy = F.nullif(F.regexp_replace(energy, r"(?i)^\s*energy:\s*|\s+$", ""), F.lit(""))
    rows = rows.withColumn("name", name).withColumn("n_atoms", F.get(counts, F.lit(0))).withColumn("n_bonds", F.get(counts, F.lit(1))).withColumn("energy_text", energy)
    n_atoms, n_bonds = F.col("n_atoms").try_cast("double"), F.col("n_bonds").try_cast("double")
    has = lambda fault: F.exists("ATOM", lambda x: x["fault"].eqNullSafe(fault)) | F.exists("BOND", lambda x: x["fault"].eqNullSafe(fault))
    inside = lambda end: F.coalesce((end >= 1) & (end <= n_atoms), F.lit(False))
    ends_ok = F.forall("BOND", lambda x: inside(x["a"]) & inside(x["b"]))
    energy_ok = F.col("energy_text").isNull() | (F.lower("energy_text") == "nan") | _finite(F.col("energy_text"))
    reason = (
        F.when((F.col("at_MOLECULE") == 0) | (F.col("at_ATOM") == 0) | (F.col("at_BOND") == 0), "missing_section")
        .when(~F.col("name").rlike(_POSE), "bad_name")
        .when(has("column_count"), "column_count")
        .when(~(_whole(F.col("n_atoms")) & _whole(F.col("n_bonds")) & ~has("bad_value") & ends_ok & energy_ok), "bad_value")
        .when((F.size("ATOM") != n_atoms) | (F.size("BOND") != n_bonds), "count_mismatch")
    )
    whole = lambda c: c.try_cast("int")
    atoms = F.transform("ATOM", lambda f: F.struct(whole(f["number"]).alias("number"), f["name"].alias("name"), *[f[c].alias(c) for c in ("x", "y", "z", "type", "charge")]))
    bonds = F.transform("BOND", lambda f: F.struct(whole(f["number"]).alias("number"), whole(f["a"]).alias("a"), whole(f["b"]).alias("b"), f["type"].alias("type")))
    return rows.select(
        "id", F.lower("name").alias("molname"), F.when(F.lower("energy_text") != "nan", F.col("energy_text").try_cast("double")).alias("energy"),
        atoms.alias("atoms"), bonds.alias("bonds"), reason.alias("reason"), "raw",
    )


def read_mol2_records(records: DataFrame, record_id: str, raw: str) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected) of MOL2 records; see parse_mol2.

    Defined cases: null and empty records are rejected for their missing sections; repeated records each count; an empty
    table gives two empty results. Other columns are ignored.
    """
    parsed = parse_mol2(records, record_id, raw)
    loaded = parsed.where("reason is null").select(F.col("id").alias(record_id), "molname", "energy", "atoms", "bonds")
    return loaded, parsed.where("reason is not null").select(F.col("id").alias(record_id), "reason", "raw")
