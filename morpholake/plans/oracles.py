"""DuckDB SQL for the library's own queries."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np

from morpholake.functions.geometry import Geometry, num
from morpholake.operators.features import families
from morpholake.operators.phenotypes import USED
from morpholake.plans.fixtures import DEPTH, MATRICES, XS, YS, jitter
from morpholake.schema import POINTS


class DuckGeometry(Geometry):
    """The few expressions that DuckDB writes in another way."""

    def ratio(self, top: str, below: str) -> str:
        return f"(({top}) / nullif({below}, 0))"

    def points(self, which: Sequence[int]) -> str:
        return "[" + ", ".join(f"{{'i': {n}, 'x': x{i}, 'y': y{i}}}" for n, i in enumerate(which)) + "]"

    def star(self, pts: str) -> str:
        centre = "(SELECT v, list_avg(list_transform(v, lambda p: p.x)) AS cx, list_avg(list_transform(v, lambda p: p.y)) AS cy FROM (SELECT PTS AS v))".replace("PTS", pts)
        around = f"(SELECT list_sort(list_transform(v, lambda p, i: {{'a': atan2(p.y - cy, p.x - cx), 'i': i, 'x': p.x, 'y': p.y}})) AS s FROM {centre})"
        turns = "list_sum(list_transform(range(1, len(s) + 1), lambda k: s[k].x * s[k % len(s) + 1].y - s[k % len(s) + 1].x * s[k].y))"
        return f"(SELECT CASE WHEN s IS NULL THEN NULL WHEN len(s) < 3 THEN 0.0::DOUBLE ELSE 0.5 * abs({turns}) END FROM {around})"

    def by_x(self, which: Sequence[int], place: int, axis: str) -> str:
        return f"(list_sort([{', '.join(f'{{{chr(39)}x{chr(39)}: x{i}, {chr(39)}y{chr(39)}: y{i}}}' for i in which)}])[{place}].{axis})"

    def nearest(self, which: Sequence[int], side: int, to: int, count: int) -> str:
        kept = f"list_filter({self.points(which)}, lambda p: sign(p.x) = {side})"
        return f"(list_sort(list_transform({kept}, lambda p: {{'k': abs(p.y - y{to}), 'i': p.i, 'x': p.x, 'y': p.y}}))[1:{count}])"

    def edge_x(self, two: str, to: int) -> str:
        between = f"t[1].x + (y{to} - t[1].y) * (t[2].x - t[1].x) / (t[2].y - t[1].y)"
        return f"(SELECT CASE WHEN len(t) < 2 THEN NULL WHEN abs(t[1].y - t[2].y) < 1e-6 THEN (t[1].x + t[2].x) / 2 ELSE {between} END FROM (SELECT {two} AS t))"

    def and_point(self, pts: str, which: int) -> str:
        return f"(SELECT CASE WHEN len(t) >= 2 THEN list_concat(list_transform(t, lambda p: {{'x': p.x, 'y': p.y}}), [{{'x': x{which}, 'y': y{which}}}]) END FROM (SELECT {pts} AS t))"


def rounded(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0 AS {name}"


_MATRIX = "CASE vec_id % 4 " + " ".join(f"WHEN {k} THEN {[[float(x) for x in row] for row in m]}::DOUBLE[][]" for k, m in MATRICES.items()) + " ELSE NULL END"
_X = f"((({XS}::BIGINT[])[i + 1] * 100 + {jitter('i', 'vec_id', 7919, 104729)}) / 100000.0::DOUBLE) * 1000.0::DOUBLE"
_Y = f"((({YS}::BIGINT[])[i + 1] * 100 + {jitter('i', 'vec_id', 6101, 15485863)}) / 100000.0::DOUBLE) * 1000.0::DOUBLE"
LANDMARKS = f"""lm AS MATERIALIZED (
  SELECT vec_id, label::VARCHAR AS disease, {_MATRIX} AS m, list_transform(range({POINTS}), lambda i: {{'x': {_X}, 'y': {_Y}}}) AS pts FROM embeddings)"""

#: Canonical points without de-rotation.
FLAT = """o AS MATERIALIZED (
  SELECT *, (pts[134].x + pts[363].x) / 2 AS ox, (pts[134].y + pts[363].y) / 2 AS oy,
    -atan2(pts[363].y - pts[134].y, pts[363].x - pts[134].x) AS t FROM lm),
flat AS MATERIALIZED (
  SELECT *, list_transform(pts, lambda p: {'x': cos(t) * (p.x - ox) - sin(t) * (p.y - oy), 'y': sin(t) * (p.x - ox) + cos(t) * (p.y - oy)}) AS canon FROM o)"""

#: Canonical points with it, where there is a matrix; the fixture's matrices are rotations already.
TURNED = f"""n AS MATERIALIZED (
  SELECT *, m[1][1] * m[2][2] - m[1][2] * m[2][1] AS det, list_avg(list_transform(pts, lambda p: p.x)) AS mx, list_avg(list_transform(pts, lambda p: p.y)) AS my,
    sqrt(pow(pts[235].x - pts[455].x, 2) + pow(pts[235].y - pts[455].y, 2)) AS w, {DEPTH}::DOUBLE[] AS z FROM flat),
s AS MATERIALIZED (
  SELECT *, list_transform(pts, lambda p, i: {{'x': p.x - mx - z[i] * w * m[1][3], 'y': p.y - my - z[i] * w * m[2][3]}}) AS shifted FROM n),
h AS MATERIALIZED (
  SELECT *, list_transform(shifted, lambda p: {{'x': (m[2][2] * p.x - m[1][2] * p.y) / det, 'y': (m[1][1] * p.y - m[2][1] * p.x) / det}}) AS head FROM s),
turned AS MATERIALIZED (
  SELECT vec_id, disease, m, m IS NOT NULL AND abs(det) > 1e-6 AS derotated,
    CASE WHEN m IS NOT NULL AND abs(det) > 1e-6 THEN list_transform(head, lambda p: {{'x': p.x - (head[134].x + head[363].x) / 2, 'y': p.y - (head[134].y + head[363].y) / 2}}) ELSE canon END AS canon
  FROM h)"""


def _points(source: str) -> str:
    far = lambda a, b: f"sqrt((canon[{a + 1}].x - canon[{b + 1}].x) * (canon[{a + 1}].x - canon[{b + 1}].x) + (canon[{a + 1}].y - canon[{b + 1}].y) * (canon[{a + 1}].y - canon[{b + 1}].y))"
    cols = ", ".join(f"canon[{i + 1}].{a} AS {a}{i}" for i in USED for a in "xy")
    return f"""pt AS MATERIALIZED (
  SELECT *, {far(234, 454)} AS bizyg, abs(canon[11].y - canon[153].y) AS face_h, abs(canon[169].y - canon[3].y) AS midface_h, {far(61, 291)} AS mouth_w, {cols} FROM {source})"""


def features(names: Sequence[str], turned: bool = False) -> str:
    """The measurements of these families for each vec_id."""
    chosen = [f for k, f in families(DuckGeometry()).items() if k in names]
    measured = ", ".join(f"{e} AS {n}" for f in chosen for n, e in f.measured.items())
    shown = ", ".join(rounded(f.derived.get(n, n), n) for f in chosen for n in f.order)
    return f"WITH {LANDMARKS}, {FLAT}{', ' + TURNED if turned else ''}, {_points('turned' if turned else 'flat')}, me AS MATERIALIZED (SELECT vec_id, bizyg, face_h, midface_h, {measured} FROM pt) SELECT vec_id, {shown} FROM me"


def scales() -> str:
    return f"WITH {LANDMARKS}, {FLAT}, {_points('flat')} SELECT vec_id, {', '.join(rounded(s, s) for s in ('bizyg', 'face_h', 'midface_h', 'mouth_w'))} FROM pt"


def canonical(turned: bool) -> str:
    source = f"{LANDMARKS}, {FLAT}" + (f", {TURNED}" if turned else "")
    shown = "vec_id, derotated" if turned else "vec_id"
    return f"WITH {source} SELECT {shown}, i::INTEGER AS point, {rounded('canon[i + 1].x', 'x')}, {rounded('canon[i + 1].y', 'y')} FROM {'turned' if turned else 'flat'}, range({POINTS}) r(i)"


_POSE = f"""pose AS (
  SELECT vec_id, disease, m, sqrt(m[1][1] * m[1][1] + m[2][1] * m[2][1]) AS sy FROM (SELECT vec_id, label::VARCHAR AS disease, {_MATRIX} AS m FROM embeddings)),
angles AS (
  SELECT vec_id, disease, degrees(atan2(-m[3][1], sy)) AS pose_yaw,
    degrees(CASE WHEN sy > 1e-6 THEN atan2(m[3][2], m[3][3]) ELSE atan2(-m[2][3], m[2][2]) END) AS pose_pitch,
    degrees(CASE WHEN sy > 1e-6 THEN atan2(m[2][1], m[1][1]) WHEN sy IS NOT NULL THEN 0.0 END) AS pose_roll FROM pose),
gated AS (
  SELECT *, abs(pose_yaw) <= 15 AND abs(pose_pitch) <= 15 AND abs(pose_roll) <= 10 AS frontal_ok FROM angles)"""

_ANGLES = ", ".join(rounded(a, a) for a in ("pose_yaw", "pose_pitch", "pose_roll"))

_EMB = """e AS (
  SELECT vec_id AS id, label::VARCHAR AS cohort, ['train', 'heldout', 'synthetic'][1 + vec_id % 3] AS split, embedding::DOUBLE[] AS v FROM embeddings),
f AS (
  SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
u AS (
  SELECT id, cohort, split, norm, list_transform(v, lambda x: x / norm) AS q FROM f WHERE norm > 0.1)"""
_DIST = "1 - list_sum(list_transform(range(1, len(a.q) + 1), lambda k: a.q[k] * b.q[k]))"
_NEAR = f"{_EMB}, near AS (SELECT a.split, a.id, min({_DIST}) AS dist FROM u a JOIN u b ON a.cohort = b.cohort WHERE a.split <> 'train' AND b.split = 'train' GROUP BY a.split, a.id)"


def _aa(a: str, b: str) -> str:
    """Common tables for the accuracy of two splits, named by them."""
    pair = lambda x, y, self_: f"(SELECT a.id, min({_DIST}) AS d FROM u a JOIN u b ON a.split = '{x}' AND b.split = '{y}'{' AND a.id <> b.id' if self_ else ''} GROUP BY a.id)"
    side = lambda x, y: f"(SELECT avg((c.d > w.d)::INTEGER) AS s FROM {pair(x, y, False)} c JOIN {pair(x, x, True)} w USING (id))"
    return f"aa_{a} AS (SELECT (l.s + r.s) / 2 AS aa FROM {side(a, b)} l, {side(b, a)} r)"


_PERCENT = "(VALUES (1), (2), (5), (10), (20)) p(percentile)"
_CUTS = "cuts AS (SELECT unnest([1, 2, 5, 10, 20]) AS percentile, unnest(quantile_cont(dist, [0.01, 0.02, 0.05, 0.1, 0.2])) AS threshold FROM near WHERE split = 'heldout')"

_WIDE = """w AS (
  SELECT l_returnflag AS disease, l_orderkey || '-' || l_linenumber AS image_id, CASE WHEN l_linenumber <> 7 THEN l_linestatus = 'O' END AS frontal_ok,
    l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"""
_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_REF = "r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS sd, count({c}) AS n FROM w WHERE frontal_ok" for c in _FOUR) + ")"

# Names and rows that the mapping and ontology queries share; plans.queries makes the same tables in Spark.
COLUMNS = [n for f in families().values() for n in f.order]
GROUPS = [("eyes", "eye_area_mean"), ("eyes", "eye_fissure_length_r"), ("gaze", "gaze_asym_x"), ("nose", "nose_length"), ("lips", "upper_lip_eversion"), ("lips", "mouth_width"), ("brows", "eb_thickness_mean"), ("brows", "NOT_APPLICABLE"), ("", "chin_width")]
MAPPING = [
    ("R", "feature_groups", "eyes"), ("R", "extra_columns", "chin_width"), ("N", "feature_groups", "nose"), ("N", "feature_groups", "unheard"),
    ("N", "extra_columns", "l_tax"), ("A", "extra_columns", "l_quantity"), ("A", "extra_columns", "l_discount"), ("N", "feature_groups", "lips"),
]


def _values(rows: Sequence[Sequence[str | None]], name: str, columns: str) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({columns}))"


_SUFFIX = "(?:_mean|_asym|_r|_l|_x|_y)$"
_SELECTION = ", ".join([
    _values([(c,) for c in [*COLUMNS, *_FOUR]], "col", "csv_column"), _values(GROUPS, "grp0", "feature_group, csv_column"), _values(MAPPING, "map", "cohort, kind, item"),
    "grp AS (SELECT DISTINCT trim(feature_group) AS feature_group, trim(csv_column) AS csv_column FROM grp0 WHERE trim(feature_group) <> '' AND csv_column <> 'NOT_APPLICABLE')",
    f"gc AS (SELECT DISTINCT feature_group, col.csv_column FROM grp JOIN col ON regexp_replace(grp.csv_column, '{_SUFFIX}', '') = regexp_replace(col.csv_column, '{_SUFFIX}', ''))",
    "sel AS (SELECT cohort, csv_column FROM map JOIN gc ON kind = 'feature_groups' AND item = feature_group UNION SELECT cohort, item FROM map WHERE kind = 'extra_columns')",
])

TERMS = [("T:0001", "Cold Widget"), ("T:0002", "large bolt"), ("T:0003", "Large Bolt"), ("T:0004", "marfan syndrome"), ("T:0005", "noonan syndrome"), ("T:0006", "small ring part")]
SYNONYMS = [("T:0004", "Marfan"), ("T:0005", "Turner-like syndrome"), ("T:0001", "chilly widget"), ("T:0007", "green plate")]
XREFS = [("T:0004", "OMIM:154700"), ("T:0004", "UMLS:C1"), ("T:0005", "OMIM:163950"), ("T:0005", "OMIM:605275")]
NAMES = ["Marfan syndrome", "MARFAN", "Noonan syndrome 1", "noonan  syndrome type 2", "turner-like syndrome", "Large bolt", "unheard of", "widget 4", "Marfan, 1", " chilly widget "]
CACHE = [("Marfan syndrome", "T:0099", "by hand", "", "exact", "true"), ("old name", "T:0002", "large bolt", "", "exact", "false"), ("MARFAN", "T:0004", "marfan syndrome", "OMIM:154700", "synonym", "false")]
_TRAIL = r"\s*(?:[-,]\s*\d+|\btype\s+\d+|\d+)\s*$"
_FORMS = f"""base AS (SELECT DISTINCT name AS query_name, trim(name) AS b FROM nm),
st AS (SELECT *, lower(b) AS low, trim(regexp_replace(lower(b), '{_TRAIL}', '')) AS stripped FROM base),
fv AS (SELECT query_name, b, low, CASE WHEN stripped <> '' AND stripped <> low THEN stripped END AS third,
  trim(regexp_replace(coalesce(CASE WHEN stripped <> '' THEN stripped END, low), '\\s+', ' ', 'g')) AS fourth FROM st),
four AS (SELECT query_name, list_filter([b, low, third, CASE WHEN fourth <> '' THEN fourth END], lambda x: x IS NOT NULL) AS l FROM fv),
forms AS (SELECT query_name, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS variants FROM four)"""
_ONTO = ", ".join([
    _values(TERMS, "term", "curie, label"), _values(SYNONYMS, "syn", "curie, synonym"), _values(XREFS, "xref", "curie, xref"),
    "nm AS (SELECT name FROM (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ") t(name) UNION SELECT DISTINCT p_name FROM part)", _FORMS,
    "li AS (SELECT lower(trim(label)) AS key, min(curie) AS curie FROM term GROUP BY 1)", "si AS (SELECT lower(trim(synonym)) AS key, min(curie) AS curie FROM syn GROUP BY 1)",
    "lad AS (SELECT query_name, unnest(variants) AS v, unnest(range(len(variants))) AS form FROM forms)",
    "hit AS (SELECT query_name, form * 2 AS rung, curie FROM lad JOIN li ON li.key = lower(trim(v)) UNION ALL SELECT query_name, form * 2 + 1, curie FROM lad JOIN si ON si.key = lower(trim(v)))",
    "best AS (SELECT query_name, min((rung, curie)) AS h FROM hit GROUP BY 1)",
    "om AS (SELECT curie, string_agg(DISTINCT xref, ';' ORDER BY xref) AS omim_xrefs FROM xref WHERE starts_with(xref, 'OMIM:') GROUP BY 1)",
    """found AS (SELECT query_name, h[2] AS mondo_id, label AS mondo_name, coalesce(omim_xrefs, '') AS omim_xrefs,
      CASE h[1] WHEN 0 THEN 'exact' WHEN 1 THEN 'synonym' ELSE 'fuzzy' END AS matched_via, 'false' AS manual_override
      FROM best LEFT JOIN term ON term.curie = h[2] LEFT JOIN om ON om.curie = h[2])""",
])
_CACHED = _values(CACHE, "cache", "query_name, mondo_id, mondo_name, omim_xrefs, matched_via, manual_override")

_EDGES = [float(x) for x in np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])]
_WEIGHT = " + ".join(f"(u >= {e!r}::DOUBLE)::INTEGER" for e in _EDGES)



def extraction(cohort: str, keeps: dict[str, str]) -> str:
    """vec_id, disease and some measurements by cohort: name to the condition under which a row keeps it."""
    chosen = list(families(DuckGeometry()).values())
    measured = ", ".join(f"{e} AS {n}" for f in chosen for n, e in f.measured.items())
    formulas = {n: f.derived.get(n, n) for f in chosen for n in f.order} | {"face_span": "span"}
    shown = ", ".join(rounded(f"CASE WHEN {when} THEN {formulas[n]} END", n) for n, when in keeps.items())
    return f"""WITH {LANDMARKS}, {FLAT}, {TURNED}, {_points('turned')},
me AS MATERIALIZED (SELECT vec_id, disease, bizyg, face_h, midface_h, (canon[455].x - canon[235].x) / bizyg AS span, {measured} FROM pt)
SELECT vec_id, {cohort} AS disease, {shown} FROM me"""


def _report(column: str, rows: str, columns: dict[str, Sequence[str]]) -> str:
    """Reports of selections: rows gives cohort_name and a key; columns: key to what it selects."""
    pairs = ", ".join(f"({key}, '{c}')" for key, names in columns.items() for c in names)
    return f"SELECT cohort_name, {column}count(DISTINCT c) AS n_columns_selected, coalesce(string_agg(DISTINCT c, ';' ORDER BY c), '') AS columns_selected FROM ({rows}) r JOIN (VALUES {pairs}) v(k, c) ON v.k = r.k GROUP BY ALL"


def _like(*names: str) -> list[str]:
    """Measurements of the families that these belong to."""
    stem = lambda c: re.sub(_SUFFIX, "", c)
    return [c for c in COLUMNS if stem(c) in {stem(n) for n in names}]


_EYES, _LIPS = _like("eye_area_mean", "eye_fissure_length_r"), _like("upper_lip_eversion", "mouth_width")
_LABELS = "SELECT DISTINCT label::VARCHAR AS cohort_name, unnest(CASE WHEN label % 3 = 0 THEN [label % 2, 2] ELSE [label % 2] END) AS k FROM embeddings WHERE label IS NOT NULL"
_SPELT = "CASE WHEN vec_id % 2 = 0 THEN 'Noonan syndrome 1' ELSE 'MARFAN' END"

ORACLE_SQL: dict[str, str] = {
    "custom_extraction": extraction("coalesce(disease, '')", {n: f"disease IS NULL OR disease::BIGINT {rule}" for n, rule in (("eye_area_mean", "% 2 = 0"), ("eye_fissure_length_r", "% 2 = 0"), ("mouth_width", "IS NULL"), ("chin_width", "% 2 = 1"), ("face_span", "% 3 = 0"))}),
    "custom_extraction_report": _report("", _LABELS, {"0": _EYES, "1": ["chin_width"], "2": ["face_span"]}),
    "disease_extraction": extraction(_SPELT, {"eye_area_mean": "vec_id % 2 = 1", "eye_fissure_length_r": "vec_id % 2 = 1", "mouth_width": "vec_id % 2 = 0", "chin_width": "FALSE"}),
    "disease_extraction_report": _report("mondo_id, json_disease_key, ", f"SELECT DISTINCT {_SPELT} AS cohort_name, vec_id % 2 AS k, ['T:0005', 'T:0004'][1 + vec_id % 2] AS mondo_id, ['noonan  syndrome type 2', 'marfan syndrome'][1 + vec_id % 2] AS json_disease_key FROM embeddings", {"0": _LIPS, "1": _EYES}),
    "flagging_table": f"""WITH {_NEAR}, {_CUTS}
SELECT percentile::INTEGER AS percentile, {rounded('threshold', 'threshold')}, count(*) FILTER (split = 'synthetic' AND dist < threshold) AS synthetic_below,
  count(*) FILTER (split = 'synthetic') AS synthetic_total, round(100.0 * count(*) FILTER (split = 'synthetic' AND dist < threshold) / count(*) FILTER (split = 'synthetic'), 2) AS synthetic_pct,
  count(*) FILTER (split = 'heldout' AND dist < threshold) AS heldout_below, count(*) FILTER (split = 'heldout') AS heldout_total,
  round(100.0 * count(*) FILTER (split = 'heldout' AND dist < threshold) / count(*) FILTER (split = 'heldout'), 2) AS heldout_pct
FROM near, cuts GROUP BY percentile, threshold""",
    "nearest_train_distance": f"WITH {_NEAR} SELECT split, id, {rounded('dist', 'dist')} FROM near",
    "heldout_thresholds": f"WITH {_NEAR}, {_CUTS} SELECT percentile::INTEGER AS percentile, {rounded('threshold', 'threshold')} FROM cuts",
    "no_face_counts": f"WITH {_EMB} SELECT cohort, split, count(*) FILTER (norm <= 0.1) AS no_face, count(*) AS total FROM f GROUP BY cohort, split",
    "embedding_norms": f"WITH {_EMB} SELECT id, {rounded('norm', 'norm')} FROM f",
    "cohort_coverage": f"""WITH {_EMB}, k AS (SELECT cohort, max((split = 'train')::INTEGER) AS in_train, max((split = 'heldout')::INTEGER) AS in_heldout, max((split = 'synthetic')::INTEGER) AS in_synthetic FROM e GROUP BY cohort)
SELECT *, in_train + in_heldout + in_synthetic AS n_splits, in_train + in_heldout + in_synthetic = 3 AS in_all FROM k""",
    "aa_point_train_syn": f"WITH {_EMB}, {_aa('train', 'synthetic')} SELECT {rounded('aa', 'aa')} FROM aa_train",
    "aa_point_heldout_syn": f"WITH {_EMB}, {_aa('heldout', 'synthetic')} SELECT {rounded('aa', 'aa')} FROM aa_heldout",
    "privacy_loss_point": f"""WITH {_EMB}, {_aa('train', 'synthetic')}, {_aa('heldout', 'synthetic')}
SELECT {rounded('t.aa', 'aa_train_synth')}, {rounded('h.aa', 'aa_heldout_synth')}, {rounded('h.aa - t.aa', 'privacy_loss')} FROM aa_train t, aa_heldout h""",
    "aa_from_min_dists": """WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS side, l_tax AS cross_, l_discount AS within FROM lineitem)
SELECT round((avg((cross_ > within)::INTEGER) FILTER (side = 'a') + avg((cross_ > within)::INTEGER) FILTER (side = 'b')) / 2, 6) + 0 AS aa FROM d""",
    "bootstrap_summary": f"""WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS side, l_tax > l_discount AS far, draw FROM lineitem, range(20) r(draw)),
x AS (SELECT *, ((l_orderkey * 7919 + l_linenumber * 104729 + draw * 1299709 + l_orderkey * draw * 613) % 10007) / 10007.0::DOUBLE AS u FROM d),
w AS (SELECT *, {_WEIGHT} AS w FROM x),
aa AS (SELECT draw, (sum(CASE WHEN side = 'a' AND far THEN w ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN side = 'a' THEN w ELSE 0 END), 0)
  + sum(CASE WHEN side = 'b' AND far THEN w ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN side = 'b' THEN w ELSE 0 END), 0)) / 2 AS aa FROM w GROUP BY draw)
SELECT {rounded('avg(aa)', 'mean')}, {rounded('quantile_cont(aa, 0.5)', 'median')}, {rounded('stddev_pop(aa)', 'std')}, {rounded('quantile_cont(aa, 0.025)', 'ci_lower')}, {rounded('quantile_cont(aa, 0.975)', 'ci_upper')} FROM aa""",
    "pose_angles": f"WITH {_POSE} SELECT vec_id, {_ANGLES} FROM gated",
    "frontal_gate": f"WITH {_POSE} SELECT vec_id, frontal_ok FROM gated",
    "frontal_counts_by_cohort": f"WITH {_POSE} SELECT disease, count(*) FILTER (frontal_ok) AS frontal, count(*) FILTER (NOT frontal_ok) AS turned, count(*) FILTER (frontal_ok IS NULL) AS unknown FROM gated GROUP BY disease",
    "canonical_points_rollonly": canonical(False),
    "canonical_points_derotated": canonical(True),
    "landmark_scales": scales(),
    "face_short_side": f"WITH {LANDMARKS}, b AS (SELECT vec_id, list_max(list_transform(pts, lambda p: p.x)) - list_min(list_transform(pts, lambda p: p.x)) AS w, list_max(list_transform(pts, lambda p: p.y)) - list_min(list_transform(pts, lambda p: p.y)) AS h FROM lm) SELECT vec_id, trunc(least(w, h))::INTEGER AS face_px FROM b",
    "crop_box": f"""WITH {LANDMARKS}, b AS (SELECT vec_id, list_min(list_transform(pts, lambda p: p.x)) AS x0, list_max(list_transform(pts, lambda p: p.x)) AS x1, list_min(list_transform(pts, lambda p: p.y)) AS y0, list_max(list_transform(pts, lambda p: p.y)) AS y1 FROM lm),
s AS (SELECT *, greatest(round_even(greatest(x1 - x0, y1 - y0) * 1.6::DOUBLE, 0)::INTEGER, 1) AS side FROM b)
SELECT vec_id, round_even((x0 + x1) / 2 - side / 2.0::DOUBLE, 0)::INTEGER AS x0, round_even((y0 + y1) / 2 - side / 2.0::DOUBLE, 0)::INTEGER AS y0, side FROM s""",
    "average_landmarks": f"WITH {LANDMARKS} SELECT disease, i::INTEGER AS point, trunc(avg(pts[i + 1].x))::INTEGER AS x, trunc(avg(pts[i + 1].y))::INTEGER AS y FROM lm, range({POINTS}) r(i) GROUP BY disease, i",
    **{f"feat_{k}": features([k]) for k in families()},
    "features_all_120": features(list(families()), turned=True),
    "reference_from_controls": f"WITH {_WIDE}, {_REF} SELECT feature, {rounded('mean', 'mean')}, {rounded('sd', 'sd')}, n FROM r",
    "zscore_wide": f"WITH {_WIDE}, {_REF} SELECT disease, image_id, frontal_ok, " + ", ".join(rounded(f"({c} - (SELECT mean FROM r WHERE feature = '{c}')) / (SELECT sd FROM r WHERE feature = '{c}')", c) for c in _FOUR) + " FROM w",
    "zscore_long": f"WITH {_WIDE}, {_REF}, l AS (UNPIVOT w ON {', '.join(_FOUR)} INTO NAME feature VALUE value) SELECT disease, image_id, feature, value, {rounded('(value - mean) / sd', 'z')} FROM l LEFT JOIN r USING (feature)",
    "zscore_missing_reference": f"WITH {_WIDE}, {_REF} SELECT disease, image_id, frontal_ok, " + ", ".join(rounded(f"({c} - (SELECT mean FROM r WHERE feature = '{c}')) / (SELECT sd FROM r WHERE feature = '{c}')", c) for c in _FOUR[:2]) + ", NULL::DOUBLE AS l_discount, NULL::DOUBLE AS l_tax FROM w",
    "suffix_stems": f"WITH {_SELECTION} SELECT csv_column, regexp_replace(csv_column, '{_SUFFIX}', '') AS stem FROM col",
    "column_families": f"WITH {_SELECTION}, s AS (SELECT csv_column, regexp_replace(csv_column, '{_SUFFIX}', '') AS stem FROM col) SELECT csv_column, stem, string_agg(csv_column, ';' ORDER BY csv_column) OVER (PARTITION BY stem ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS family FROM s",
    "group_to_columns": f"WITH {_SELECTION} SELECT * FROM gc",
    "selected_columns_by_cohort": f"WITH {_SELECTION} SELECT * FROM sel",
    "selection_report": f"WITH {_SELECTION} SELECT cohort AS cohort_name, count(DISTINCT csv_column) AS n_columns_selected, string_agg(DISTINCT csv_column, ';' ORDER BY csv_column) AS columns_selected FROM sel GROUP BY cohort",
    "masked_phenotypes": f"WITH {_SELECTION}, {_WIDE} SELECT disease, image_id, frontal_ok, " + ", ".join(f"CASE WHEN disease NOT IN (SELECT cohort FROM sel) OR EXISTS (SELECT 1 FROM sel WHERE cohort = disease AND csv_column = '{c}') THEN {c} END AS {c}" for c in _FOUR) + " FROM w",
    "resolve_ladder": f"WITH {_ONTO} SELECT * FROM found",
    "fuzzy_variants": f"WITH {_ONTO} SELECT query_name, array_to_string(variants, '|') AS variants FROM forms",
    "suggest_neighbours": f"""WITH {_ONTO}, a AS (SELECT DISTINCT query_name, lower(trim(query_name)) AS w, trim(regexp_replace(lower(trim(query_name)), '{_TRAIL}', '')) AS b FROM base WHERE query_name NOT IN (SELECT query_name FROM found)),
k AS (SELECT query_name, key, row_number() OVER (PARTITION BY query_name ORDER BY curie, key) AS position FROM a JOIN li ON (b <> '' AND contains(key, b)) OR (w <> '' AND contains(key, w)))
SELECT query_name, position::INTEGER AS position, key AS suggestion FROM k WHERE position <= 3""",
    "cache_upsert": f"WITH {_ONTO}, {_CACHED} SELECT * FROM cache UNION ALL SELECT * FROM found WHERE query_name NOT IN (SELECT query_name FROM cache)",
    "resolve_with_cache": f"WITH {_ONTO}, {_CACHED} SELECT query_name, mondo_id, mondo_name, omim_xrefs, CASE WHEN lower(manual_override) = 'true' THEN 'manual' ELSE matched_via END AS matched_via, manual_override FROM cache WHERE query_name IN (SELECT name FROM nm) UNION ALL SELECT * FROM found WHERE query_name NOT IN (SELECT query_name FROM cache)",
    "mapping_join_failures": f"""WITH {_ONTO}, ck AS (SELECT name AS cohort, mondo_id FROM (SELECT DISTINCT name FROM nm) LEFT JOIN found ON name = query_name),
kk AS (SELECT json_key, mondo_id FROM (VALUES ('MARFAN'), ('Large bolt'), ('widget 4'), ('Marfan syndrome')) t(json_key) LEFT JOIN found ON json_key = query_name),
fk AS (SELECT mondo_id, min(json_key) AS json_key FROM kk WHERE mondo_id IS NOT NULL GROUP BY 1)
SELECT cohort AS name, 'cohort_unresolved' AS problem FROM ck WHERE mondo_id IS NULL UNION ALL SELECT json_key, 'key_unresolved' FROM kk WHERE mondo_id IS NULL
UNION ALL SELECT cohort, 'not_mapped' FROM ck LEFT JOIN fk USING (mondo_id) WHERE mondo_id IS NOT NULL AND json_key IS NULL""",
    "parse_props": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE json_valid(props)",
    "jsonl_validation_report": """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'no image_id' WHEN 2 THEN 'ragged landmarks' WHEN 3 THEN 'image_size is not two numbers' ELSE 'not JSON of the right types' END AS reason FROM events WHERE json_valid(props))
SELECT reason, count(*) AS n FROM t GROUP BY reason""",
    "enhance_decisions": """WITH i AS (SELECT p_brand AS cohort, 'image' || p_partkey AS image, p_size <> 13 AS readable, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 3 END AS channels, (p_partkey % 50)::DOUBLE AS mean_saturation, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 37 % 600)::INTEGER END AS face_px FROM part),
g AS (SELECT *, channels = 1 OR mean_saturation / 255 < 0.03 AS gray FROM i)
SELECT cohort, image, CASE WHEN readable THEN gray END AS grayscale, CASE WHEN readable THEN face_px END AS face_px, readable AND gray AS colorized, readable AND coalesce(face_px < 256, FALSE) AS restored, CASE WHEN readable THEN 'ok' ELSE 'unreadable' END AS status FROM g""",
    "pack_log_summary": "SELECT p_brand AS cohort, count(*) AS total, count(*) FILTER (p_size <> 13 AND p_partkey % 3 > 0) AS ok FROM part GROUP BY 1",
    "seed_ranges": "SELECT n_nationkey, unnest(list_concat([n_nationkey::INTEGER], range(n_nationkey::INTEGER + 10, n_nationkey::INTEGER + 13))) AS seed FROM nation",
}
