"""Canonical spelling of names and proteins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(c: Column | str) -> Column:
    """Lower case without outer blanks; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def clean_protein(c: Column | str) -> Column:
    """Upper case without outer blanks; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def present(c: Column | str) -> Column:
    """The number itself, null where it is NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def base_of(structvar: Column | str) -> Column:
    """Molecule name inside a structural variant's name, null where the name has another shape."""
    c = F.col(structvar) if isinstance(structvar, str) else structvar
    return F.nullif(F.regexp_extract(c, r"(?i)^(.+)_stereo\d+_ion\d+_tau\d+$", 1), F.lit(""))
