"""Queries of rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.runtime import table
from posemill.sources.rejects import read_fingerprint_lines, read_mol2_records


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_fingerprint_lines(table(spark, folder, "plec_raw"), "line_id", "raw_line")[1]
    records = read_mol2_records(table(spark, folder, "mol2_raw"), "record_id", "raw_text")[1]
    return lines.select(F.lit("plec_raw").alias("record_set"), F.col("line_id").alias("record_id"), "reason").unionByName(
        records.select(F.lit("mol2_raw").alias("record_set"), "record_id", "reason")
    )


def p4_loaded_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    loaded = read_fingerprint_lines(table(spark, folder, "plec_raw"), "line_id", "raw_line")[0]
    return loaded.select("line_id", "complex_name", F.concat_ws(",", F.transform("counts", lambda x: x.cast("string"))).alias("counts"))


def p4_loaded_molecules(spark: SparkSession, folder: str) -> DataFrame:
    loaded = read_mol2_records(table(spark, folder, "mol2_raw"), "record_id", "raw_text")[0]
    return loaded.select("record_id", "molname", "energy", F.size("atoms").alias("n_atoms"), F.size("bonds").alias("n_bonds"))


QUERIES = {"p4_found": p4_found, "p4_loaded_fingerprints": p4_loaded_fingerprints, "p4_loaded_molecules": p4_loaded_molecules}


# ---- the same in SQL --------------------------------------------------------------------------------------------------

_VARIANT = "_stereo[0-9]+_ion[0-9]+_tau[0-9]+_pose[0-9]+"
_QUOTED = '"(?:[^"]|"")*"'
_FIELD = f'(?:{_QUOTED}|[^",]*)'
_REAL = "[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?"


def _finite(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '{_REAL}') AND isfinite(TRY_CAST({x} AS DOUBLE)), false)"


def _whole(x: str) -> str:
    return f"({_finite(x)} AND coalesce(TRY_CAST({x} AS DOUBLE) = round(TRY_CAST({x} AS DOUBLE)), false))"


_PLEC = rf"""lines AS (SELECT line_id, regexp_replace(raw_line, '[\r\n]+$', '') AS line FROM plec_raw WHERE trim(raw_line) <> '' AND NOT regexp_matches(raw_line, '^\s*"?complex_name"?\s*(,|\s*$)', 'i')),
 cut AS (SELECT *, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') AS paired, regexp_extract(line, '^{_FIELD}') AS first, regexp_replace(line, '{_QUOTED}', 'q', 'g') AS bare FROM lines WHERE regexp_matches(line, '\S')),
 named AS (SELECT *, CASE WHEN starts_with(first, '"') THEN replace(regexp_replace(first, '^"|"$', '', 'g'), '""', '"') ELSE first END AS name,
 list_transform(string_split(substr(line, length(first) + 2), ','), lambda v: trim(regexp_replace(v, '^"([^"]*)"$', '\1'), ' \t')) AS c FROM cut),
 plec AS (SELECT line_id, lower(name) AS complex_name, c, CASE WHEN NOT paired THEN 'quoting' WHEN length(bare) - length(replace(bare, ',', '')) <> 128 THEN 'column_count'
 WHEN NOT regexp_full_match(name, '(?i)\S+{_VARIANT}_frm[0-9]+') THEN 'bad_name'
 WHEN NOT coalesce(list_bool_and(list_transform(c, lambda v: regexp_full_match(v, '[0-9]+') AND coalesce(TRY_CAST(v AS INTEGER), 999) <= 255)), true) THEN 'bad_value' END AS reason FROM named)"""


def _block(section: str) -> str:
    return rf"""list_filter(list_transform(l[{section} + 1:{section} + coalesce(nullif(list_position(list_transform(h[{section} + 1:], lambda x: x IS NOT NULL), true), 0) - 1, len(l))],
 lambda x: CASE WHEN starts_with(x, '#') THEN '' ELSE trim(regexp_replace(x, '[ \t]+', ' ', 'g')) END), lambda x: x <> '')"""


_BAD_ATOM = " AND ".join(_finite(f"string_split(x, ' ')[{i}]") for i in (1, 3, 4, 5, 9))
_BAD_BOND = " AND ".join([*(_finite(f"string_split(x, ' ')[{i}]") for i in (1, 2, 3)), *(f"coalesce(TRY_CAST(string_split(x, ' ')[{i}] AS DOUBLE) BETWEEN 1 AND TRY_CAST(na AS DOUBLE), false)" for i in (2, 3))])
_MOL2 = rf"""split AS (SELECT record_id, list_transform(string_split(coalesce(raw_text, ''), chr(10)), lambda x: regexp_replace(x, '\r$', '')) AS l FROM mol2_raw),
 heads AS (SELECT *, list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^\s*@<TRIPOS>') THEN upper(regexp_extract(x, '^\s*@<TRIPOS>(\S*)', 1)) END) AS h FROM split),
 placed AS (SELECT *, coalesce(list_position(h, 'MOLECULE'), 0) AS m, coalesce(list_position(h, 'ATOM'), 0) AS a, coalesce(list_position(h, 'BOND'), 0) AS b FROM heads),
 blocks AS (SELECT *, trim(coalesce(l[m + 1], ''), E' \t') AS name, string_split(trim(regexp_replace(coalesce(l[m + 2], ''), '[ \t]+', ' ', 'g')), ' ') AS n, {_block("a")} AS atoms, {_block("b")} AS bonds,
 nullif(trim(regexp_replace(list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*energy:'))[1], '(?i)^\s*energy:', ''), E' \t\r'), '') AS e FROM placed),
 counted AS (SELECT *, n[1] AS na, n[2] AS nb FROM blocks),
 mol2 AS (SELECT *, CASE WHEN m = 0 OR a = 0 OR b = 0 THEN 'missing_section' WHEN NOT regexp_full_match(name, '(?i)\S+{_VARIANT}') THEN 'bad_name'
 WHEN len(list_filter(atoms, lambda x: len(string_split(x, ' ')) <> 9)) + len(list_filter(bonds, lambda x: len(string_split(x, ' ')) <> 4)) > 0 THEN 'column_count'
 WHEN NOT ({_whole("na")} AND {_whole("nb")} AND (e IS NULL OR lower(e) = 'nan' OR {_finite("e")}))
 OR len(list_filter(atoms, lambda x: NOT ({_BAD_ATOM}))) > 0 OR len(list_filter(bonds, lambda x: NOT ({_BAD_BOND}))) > 0 THEN 'bad_value'
 WHEN len(atoms) <> TRY_CAST(na AS DOUBLE) OR len(bonds) <> TRY_CAST(nb AS DOUBLE) THEN 'count_mismatch' END AS reason FROM counted)"""

SQL = {
    "p4_found": f"""WITH {_PLEC}, {_MOL2} SELECT 'plec_raw' AS record_set, line_id AS record_id, reason FROM plec WHERE reason IS NOT NULL
 UNION ALL SELECT 'mol2_raw', record_id, reason FROM mol2 WHERE reason IS NOT NULL""",
    "p4_loaded_fingerprints": f"WITH {_PLEC} SELECT line_id, complex_name, array_to_string(list_transform(c, lambda v: CAST(CAST(v AS INTEGER) AS VARCHAR)), ',') AS counts FROM plec WHERE reason IS NULL",
    "p4_loaded_molecules": f"""WITH {_MOL2} SELECT record_id, lower(name) AS molname, CASE WHEN lower(e) <> 'nan' THEN CAST(e AS DOUBLE) END AS energy, CAST(len(atoms) AS INTEGER) AS n_atoms,
 CAST(len(bonds) AS INTEGER) AS n_bonds FROM mol2 WHERE reason IS NULL""",
}
