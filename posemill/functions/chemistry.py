"""Descriptors that need no chemistry toolkit, from the atoms and bonds of a structure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posemill.runtime import ship

ship(__name__)

# Standard atomic weights of the elements found in drug-like molecules.
WEIGHTS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904}
BOND_TYPES = ("1", "2", "3", "ar", "am")
# Names of bond types that feature tables have columns of, in order.
BOND_NAMES = (
    "UNSPECIFIED", "SINGLE", "DOUBLE", "TRIPLE", "QUADRUPLE", "QUINTUPLE", "HEXTUPLE", "ONEANDAHALF", "TWOANDAHALF", "THREEANDAHALF", "FOURANDAHALF",
    "FIVEANDAHALF", "AROMATIC", "IONIC", "HYDROGEN", "THREECENTER", "DATIVEONE", "DATIVE", "DATIVEL", "DATIVER", "OTHER", "ZERO",
)
_NAMED = {"SINGLE": ("1", "am"), "DOUBLE": ("2",), "TRIPLE": ("3",), "AROMATIC": ("ar",), "UNSPECIFIED": ("un", "nc", "du")}
SHAPE = ["pmi1", "pmi2", "pmi3", "npr1", "npr2", "rg", "asphericity", "eccentricity", "isf", "spherocity"]


def element(atom_type: Column) -> Column:
    """Element of a MOL2 atom type: the part before the dot."""
    return F.regexp_extract(atom_type, r"^([A-Za-z]+)", 1)


def molecular_weight(atoms: Column | str) -> Column:
    """Sum of atomic weights; atoms of unknown elements weigh nothing."""
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    a = F.col(atoms) if isinstance(atoms, str) else atoms
    return F.aggregate(F.transform(a, lambda x: F.coalesce(F.try_element_at(table, element(x["type"])), F.lit(0.0))), F.lit(0.0), lambda s, w: s + w)


def heavy_atoms(atoms: Column | str) -> Column:
    a = F.col(atoms) if isinstance(atoms, str) else atoms
    return F.size(F.filter(a, lambda x: element(x["type"]) != "H"))


def heteroatoms(atoms: Column | str) -> Column:
    a = F.col(atoms) if isinstance(atoms, str) else atoms
    return F.size(F.filter(a, lambda x: ~element(x["type"]).isin("H", "C")))


def bond_type_counts(bonds: Column | str, types: tuple[str, ...] = BOND_TYPES) -> dict[str, Column]:
    b = F.col(bonds) if isinstance(bonds, str) else bonds

    def count(kind: str) -> Column:
        return F.size(F.filter(b, lambda x: x["type"] == F.lit(kind)))

    return {f"bondType_{t}": count(t) for t in types}


def named_bond_counts(bonds: Column | str) -> dict[str, Column]:
    """A count for every name of BOND_NAMES, 0 for what MOL2 types never say; amide bonds are single."""
    b = F.col(bonds) if isinstance(bonds, str) else bonds

    def count(kinds: tuple[str, ...]) -> Column:
        return F.size(F.filter(b, lambda x: x["type"].isin(*kinds)))

    return {f"bondType_{n}": count(_NAMED[n]) if n in _NAMED else F.lit(0) for n in BOND_NAMES}


def ring_count(atoms: Column | str, bonds: Column | str) -> Column:
    """Independent rings of a connected structure: bonds - atoms + 1, at least 0."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (atoms, bonds))
    return F.greatest(F.lit(0), F.size(b) - F.size(a) + 1)


def shape_of(xyz: np.ndarray, weights: np.ndarray) -> list[float]:
    """The ten shape descriptors from the principal moments of inertia and of the gyration tensor."""
    x = xyz - np.average(xyz, axis=0, weights=weights)
    square = (x * x).sum(1)
    inertia = (weights[:, None, None] * (square[:, None, None] * np.eye(3) - x[:, :, None] * x[:, None, :])).sum(0)
    p1, p2, p3 = np.sort(np.linalg.eigvalsh(inertia))
    g1, g2, g3 = np.sort(np.linalg.eigvalsh((weights[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / weights.sum()))
    total, mixed = g1 + g2 + g3, g1 * g2 + g2 * g3 + g1 * g3
    safe = lambda a, b: float(a / b) if b > 0 else float("nan")
    return [
        float(p1), float(p2), float(p3), safe(p1, p3), safe(p2, p3), float(np.sqrt(max(total, 0))),
        1 - 3 * mixed / total**2 if total > 0 else float("nan"), float(np.sqrt(max(p3**2 - p1**2, 0)) / p3) if p3 > 0 else float("nan"),
        safe(p2, p1 * p3), safe(3 * g1, total),
    ]


def shape_descriptors(df: DataFrame, key: str, atoms: str) -> DataFrame:
    """key and the ten shape descriptors of every structure; null for structures without atoms or with degenerate moments."""
    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for a in b["atoms"]:
                ok = [(p["x"], p["y"], p["z"], WEIGHTS.get("".join(c for c in p["type"].split(".")[0] if c.isalpha()), 0.0) or 1e-9) for p in a] if a is not None and len(a) else []
                rows.append(shape_of(np.array([r[:3] for r in ok], float), np.array([r[3] for r in ok])) if ok else [float("nan")] * 10)
            yield pd.concat([b[["key"]].reset_index(drop=True), pd.DataFrame(rows, columns=SHAPE)], axis=1)

    source = df.select(F.col(key).alias("key"), F.col(atoms).alias("atoms"))
    out = source.mapInPandas(run, f"key {dict(source.dtypes)['key']}, " + ", ".join(f"{s} double" for s in SHAPE))
    return out.select(F.col("key").alias(key), *[F.nanvl(s, F.lit(None)).alias(s) for s in SHAPE])


def rotor_groups(df: DataFrame, key: str, atoms: str, bonds: str, longest: int = 50) -> DataFrame:
    """key, histogram: how many groups of i contiguous rotatable bonds (i = 1..longest, larger ones in the last) a structure has;
    entry 0 is 1 where it has none at all.

    Rotatable is a single bond outside rings whose ends both have another neighbour; bonds that share an atom are contiguous.
    """
    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for a, bs in zip(b["atoms"], b["bonds"], strict=True):
                edges = [(int(x["a"]), int(x["b"]), x["type"]) for x in bs] if bs is not None else []
                del a
                degree: dict[int, int] = {}
                for u, v, _ in edges:
                    degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
                bridges = _bridges([(u, v) for u, v, _ in edges])
                turning = [(u, v) for i, (u, v, t) in enumerate(edges) if t == "1" and i in bridges and degree[u] > 1 and degree[v] > 1]
                hist = [0] * (longest + 1)
                for size in _component_sizes(turning):
                    hist[min(size, longest)] += 1
                hist[0] = int(not turning)
                out.append(hist)
            yield pd.DataFrame({"key": b["key"], "histogram": out})

    source = df.select(F.col(key).alias("key"), F.col(atoms).alias("atoms"), F.col(bonds).alias("bonds"))
    return source.mapInPandas(run, f"key {dict(source.dtypes)['key']}, histogram array<int>").withColumnRenamed("key", key)


def _bridges(edges: list[tuple[int, int]]) -> set[int]:
    """Positions of the edges that lie on no ring."""
    near: dict[int, list[tuple[int, int]]] = {}
    for i, (u, v) in enumerate(edges):
        near.setdefault(u, []).append((v, i))
        near.setdefault(v, []).append((u, i))
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    found: set[int] = set()
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, -1, iter(near[root]))]
        while stack:
            node, via, rest = stack[-1]
            for other, i in rest:
                if i == via:
                    continue
                if other in order:
                    low[node] = min(low[node], order[other])
                else:
                    order[other] = low[other] = len(order)
                    stack.append((other, i, iter(near[other])))
                    break
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] > order[up]:
                        found.add(via)
    return found


def _component_sizes(edges: list[tuple[int, int]]) -> list[int]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    sizes: dict[int, int] = {}
    for u, _ in edges:
        sizes[find(u)] = sizes.get(find(u), 0) + 1
    return sorted(sizes.values())


def symmetric_rmsd(a: Column | str, b: Column | str, maps: Column | str) -> Column:
    """The lowest rmsd over maps, arrays that give for every atom of a the position (from 0) of its partner in b; null without a map."""
    y, m = (F.col(c) if isinstance(c, str) else c for c in (b, maps))
    return F.array_min(F.transform(m, lambda one: rmsd(a, F.transform(one, lambda i: F.get(y, i)))))


def rmsd(a: Column | str, b: Column | str) -> Column:
    """Root mean square distance of two arrays of atoms matched by position; null where their lengths differ or are 0."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    square = F.zip_with(x, y, lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) + (p["z"] - q["z"]) * (p["z"] - q["z"]))
    total = F.aggregate(square, F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), F.sqrt(total / F.size(x)))
