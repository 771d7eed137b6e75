"""SQL twins of queries that run through several operators."""

from __future__ import annotations

from posemill.functions.chemistry import _NAMED, BOND_NAMES, BOND_TYPES, WEIGHTS
from posemill.plans.parsing import _MOL2, _PLEC
from posemill.plans.readers import _LOWEST
from posemill.plans.registry import SQL
from posemill.plans.selection import _mad_sql
from posemill.plans.views import ENTROPIES, FEATURES, LABELS, POSES

_NEAR = """m AS (SELECT *, min(score) OVER (PARTITION BY protein, structvar) AS low FROM poses WHERE score IS NOT NULL),
 near AS (SELECT * EXCLUDE (low) FROM m WHERE score - low <= 1.0 QUALIFY rank() OVER (PARTITION BY protein, structvar ORDER BY score) <= 100)"""


def _best(rows: str) -> str:
    return f"""variants AS (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY protein, structvar ORDER BY complexE NULLS LAST, Eint NULLS LAST, pose, frame) = 1),
 best AS (SELECT * FROM variants QUALIFY row_number() OVER (PARTITION BY protein, basemolname ORDER BY Eint NULLS LAST, structvar) = 1)"""


_ELEMENT = "regexp_extract(string_split(x, ' ')[6], '^([A-Za-z]+)', 1)"
_WEIGHT = f"CASE {_ELEMENT} {' '.join(f"WHEN '{e}' THEN {w}" for e, w in WEIGHTS.items())} ELSE 0 END"

SQL.update(
    {
        "screening_report": f"""WITH {POSES}, {LABELS}, {_NEAR}, {_best("near")}, r AS (SELECT protein, Eint AS s, is_active FROM best JOIN labels USING (basemolname) WHERE Eint IS NOT NULL),
 k AS ({SQL["curve_areas"].split(" k AS (", 1)[1]}""",
        "prepared_features": f"""WITH {POSES}, {LABELS}, {ENTROPIES}, {_NEAR}, t AS (SELECT protein, structvar, count(Eint) / count(*) AS ratio FROM near GROUP BY 1, 2),
 good AS (SELECT near.* FROM near JOIN t ON near.protein IS NOT DISTINCT FROM t.protein AND near.structvar = t.structvar WHERE Eint IS NOT NULL AND ratio > 0.8), {_mad_sql("protein, structvar, frame", "complexE", 3.5, "good", "w")},
 e AS (SELECT protein, structvar, min(complexE) AS c, min(ligandE_bound) AS l FROM wk GROUP BY 1, 2), p AS (SELECT protein, min(proteinE_bound) AS p FROM wk GROUP BY 1), {_best("wk")},
 f AS (SELECT protein, avg(s) AS spread FROM (SELECT protein, structvar, stddev_samp(proteinE_bound) AS s FROM wk GROUP BY 1, 2) GROUP BY 1)
 SELECT best.protein, best.basemolname, best.structvar, pose, frame, Eint, is_active, round(c - p.p - l, 4) AS "DeltaH", round(c - p.p - l + coalesce(confS, 0), 4) AS score_with_entropy, round(spread, 3) AS protein_fluctuation FROM best
 JOIN e ON e.protein IS NOT DISTINCT FROM best.protein AND e.structvar = best.structvar JOIN p ON p.protein IS NOT DISTINCT FROM best.protein LEFT JOIN f ON f.protein IS NOT DISTINCT FROM best.protein
 LEFT JOIN entropies ON entropies.structvar = best.structvar LEFT JOIN labels ON labels.basemolname = best.basemolname""",
        "discretize_auto": f"""WITH {FEATURES}, s AS (SELECT count(nofusion_Eint) AS n, min(nofusion_Eint) AS lo, max(nofusion_Eint) AS hi, quantile_cont(nofusion_Eint, 0.75) - quantile_cont(nofusion_Eint, 0.25) AS iqr FROM features),
 b AS (SELECT lo, hi, CAST(ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1.0 / 3))) AS INTEGER) AS bins FROM s),
 e AS (SELECT list_transform(range(0, bins + 1), lambda i: lo + (hi - lo) * i / bins) AS edges FROM b)
 SELECT feature_id, CASE WHEN nofusion_Eint IS NOT NULL THEN CAST(len(list_filter(edges, lambda x: x <= nofusion_Eint)) AS INTEGER) END AS bin FROM features, e""",
        "mol2_lowest_energy": _LOWEST,
        "atom_descriptors": f"""WITH {_MOL2} SELECT record_id, CAST(len(atoms) AS INTEGER) AS n_atoms, CAST(len(list_filter(atoms, lambda x: {_ELEMENT} <> 'H')) AS INTEGER) AS n_heavy,
 CAST(len(list_filter(atoms, lambda x: {_ELEMENT} NOT IN ('H', 'C'))) AS INTEGER) AS n_hetero, round(coalesce(list_sum(list_transform(atoms, lambda x: CAST({_WEIGHT} AS DOUBLE))), 0), 3) AS mw,
 {", ".join(f"CAST(len(list_filter(bonds, lambda x: string_split(x, ' ')[4] = '{t}')) AS INTEGER) AS bondType_{t}" for t in BOND_TYPES)},
 {", ".join(f"CAST(len(list_filter(bonds, lambda x: string_split(x, ' ')[4] IN ({', '.join(repr(t) for t in _NAMED.get(n, ('none',)))}))) AS INTEGER) AS bondType_{n}" for n in BOND_NAMES)},
 CAST(greatest(0, len(bonds) - len(atoms) + 1) AS INTEGER) AS n_rings FROM mol2 WHERE reason IS NULL""",
        "fingerprint_features": f"""WITH {FEATURES}, {_PLEC} SELECT feature_id, line_id, complex_name, CAST(list_sum(list_transform(c, lambda v: CAST(v AS INTEGER))) AS BIGINT) AS contacts,
 CAST(len(list_filter(c, lambda v: CAST(v AS INTEGER) > 0)) AS INTEGER) AS n_bits FROM features JOIN plec ON complex_name = structvar || '_pose' || pose || '_frm' || frame WHERE reason IS NULL""",
    }
)
