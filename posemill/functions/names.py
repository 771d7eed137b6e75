"""Columns out of hierarchical names ``<base>_stereo<i>_ion<j>_tau<k>[_pose<p>][_frm<f>]``. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("stereoisomer", "ionstate", "tautomer", "pose")
_TAGS = {"stereoisomer": "stereo", "ionstate": "ion", "tautomer": "tau", "pose": "pose", "frame": "frm"}
_FULL = "^(.*)" + "".join(rf"_{_TAGS[x]}([0-9]+)" for x in LEVELS) + "$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of a pattern, null (not '') where it does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def split_name(name: Column | str) -> dict[str, Column]:
    """basemolname and the four numbers of a pose name; all null where the name is not complete."""
    c = _col(name)
    return {"basemolname": _found(c, _FULL)} | {x: _found(c, _FULL, i).cast("int") for i, x in enumerate(LEVELS, 2)}


def structvar_of(name: Column | str) -> Column:
    """The name without its pose and frame."""
    return F.regexp_replace(F.regexp_replace(_col(name), "_pose[0-9]+", ""), "_frm[0-9]+", "")


def basemolname_of(name: Column | str) -> Column:
    """The name without its variant, pose and frame, and without marks of isomers and of waters."""
    return substitute_any(name, ["_stereo[0-9]+_ion[0-9]+_tau[0-9]+", "_pose[0-9]+", "_frm[0-9]+", "_iso[0-9]+", "_noWAT", "_WAT"], "")


def level_of(name: Column | str, level: str) -> Column:
    """Number of the last tag of a level (``frame``: only at the end), null without one."""
    end = "$" if level == "frame" else ".*$"
    return _found(_col(name), f"^.*_{_TAGS[level]}([0-9]+){end}").cast("int")


def variant_suffix(name: Column | str) -> Column:
    """``stereo<i>_ion<j>_tau<k>`` as text, the last one if there are several, null without one."""
    return _found(_col(name), "^.*_(stereo[0-9]+_ion[0-9]+_tau[0-9]+)")


def variant_numbers(name: Column | str) -> Column:
    """The three numbers of the last variant as an array of texts, leading zeros kept; null without one."""
    c = _col(name)
    pattern = "^.*stereo([0-9]+)_ion([0-9]+)_tau([0-9]+)"
    return F.when(c.rlike(pattern), F.array(*[F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]))


def pose_structvar(name: Column | str) -> Column:
    """structvar of a name that must end in its pose, else null."""
    return _found(_col(name), "^(.*_stereo[0-9]+_ion[0-9]+_tau[0-9]+)_pose[0-9]+$")


def make_structvar(base: Column | str, stereo: Column | str, ion: Column | str, tau: Column | str) -> Column:
    return F.concat(_col(base), F.lit("_stereo"), _col(stereo), F.lit("_ion"), _col(ion), F.lit("_tau"), _col(tau))


def make_complex_name(structvar: Column | str, pose: Column | str, frame: Column | str) -> Column:
    return F.concat(_col(structvar), F.lit("_pose"), _col(pose), F.lit("_frm"), _col(frame))


def replace_any(c: Column | str, old: list[str], new: str) -> Column:
    """Every one of several literal strings replaced, one after the other."""
    c = _col(c)
    for o in old:
        c = F.replace(c, F.lit(o), F.lit(new))
    return c


def substitute_any(c: Column | str, patterns: list[str], new: str) -> Column:
    """Every one of several patterns replaced, one after the other."""
    c = _col(c)
    for p in patterns:
        c = F.regexp_replace(c, p, new)
    return c
