"""120 scale-free measurements of a face from its canonical landmarks.

Each family is two layers of expressions: measurements of the points, and figures derived from those (means of both
sides, asymmetries, ratios). Families not asked for are not computed, and Catalyst drops what is not selected.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from morpholake.functions.geometry import EPS, Geometry, num

# Landmark numbers of the public 478-point face mesh.
BROW_UPPER = {"r": (70, 63, 105, 66, 107), "l": (300, 293, 334, 296, 336)}
BROW_LOWER = {"r": (46, 53, 52, 65, 55), "l": (276, 283, 282, 295, 285)}
EYE = {"r": {"outer": 33, "inner": 133, "top": 159, "bottom": 145, "iris": 468}, "l": {"outer": 263, "inner": 362, "top": 386, "bottom": 374, "iris": 473}}
EYE_RING = {
    "r": (33, 7, 163, 144, 145, 153, 154, 155, 133, 173, 157, 158, 159, 160, 161, 246),
    "l": (263, 249, 390, 373, 374, 380, 381, 382, 362, 398, 384, 385, 386, 387, 388, 466),
}
INNER_LIDS = {"r": (173, 155), "l": (398, 382)}
ALA, ALA_CREST = {"r": 98, "l": 327}, {"r": 49, "l": 279}
UPPER_LIP_OUTER = (185, 40, 39, 37, 0, 267, 269, 270, 409)
UPPER_LIP_INNER = (191, 80, 81, 82, 13, 312, 311, 310, 415)
LOWER_LIP_OUTER = (146, 91, 181, 84, 17, 314, 405, 321, 375)
LOWER_LIP_INNER = (95, 88, 178, 87, 14, 317, 402, 318, 324)
LIP_MIDLINE = (0, 13, 14, 17)
CHEEK = {"r": 116, "l": 345}
OVAL = (
    10, 338, 297, 332, 284, 251, 389, 356, 454, 323, 361, 288, 397, 365, 379, 378, 400, 377,
    152, 148, 176, 149, 150, 136, 172, 58, 132, 93, 234, 127, 162, 21, 54, 103, 67, 109,
)
MIRRORED = ((33, 263), (133, 362), (159, 386), (145, 374), (98, 327), (49, 279), (61, 291), (234, 454), (172, 397), (103, 332), (176, 400), (116, 345), (205, 425))
SIDES = (("r", -1), ("l", 1))


class Family(NamedTuple):
    measured: dict[str, str]
    derived: dict[str, str]
    order: list[str]


class _Builder:
    def __init__(self, g: Geometry):
        self.g, self.measured, self.derived, self.order = g, {}, {}, []

    def put(self, **exprs: str) -> None:
        self.measured |= exprs
        self.order += exprs

    def derive(self, **exprs: str) -> None:
        self.derived |= exprs
        self.order += exprs

    def mean(self, name: str) -> None:
        self.derive(**{f"{name}_mean": f"({name}_r + {name}_l) / {num(2.0)}"})

    def asym(self, name: str, absolute: bool = False) -> None:
        """Difference of the sides relative to their mean (its amount, if absolute)."""
        mean = f"(({name}_r + {name}_l) / {num(2.0)})"
        self.derive(**{f"{name}_asym": self.g.ratio(f"abs({name}_r - {name}_l)", f"({'abs' * absolute}{mean} + {EPS})")})

    def both(self, name: str, exprs: dict[str, str], absolute: bool = False) -> None:
        self.put(**{f"{name}_{side}": exprs[side] for side in "rl"})
        self.mean(name)
        self.asym(name, absolute)

    def done(self) -> Family:
        return Family(self.measured, self.derived, self.order)


def _per_width(g: Geometry, top: str, power: int = 1) -> str:
    return g.ratio(f"({top})", " * ".join(["bizyg"] * power) if power == 1 else f"({' * '.join(['bizyg'] * power)})")


def _eyebrow(g: Geometry) -> Family:
    b = _Builder(g)
    b.both("eb_thickness", {s: _per_width(g, g.star(g.points((*BROW_UPPER[s], *BROW_LOWER[s]))), 2) for s in "rl"})
    right = [g.by_x((*BROW_UPPER["r"], *BROW_LOWER["r"]), -1, a) for a in "xy"]
    left = [g.by_x((*BROW_UPPER["l"], *BROW_LOWER["l"]), 1, a) for a in "xy"]
    b.put(eb_inter_distance=_per_width(g, f"sqrt(pow({right[0]} - {left[0]}, 2) + pow({right[1]} - {left[1]}, 2))"))
    arch = {}
    for s in "rl":
        first, last = [g.by_x(BROW_UPPER[s], 1, a) for a in "xy"], [g.by_x(BROW_UPPER[s], -1, a) for a in "xy"]
        top = f"least({', '.join(f'y{i}' for i in BROW_UPPER[s])})"
        span = f"sqrt(pow({first[0]} - {last[0]}, 2) + pow({first[1]} - {last[1]}, 2))"
        arch[s] = g.ratio(f"(({first[1]} + {last[1]}) / {num(2.0)} - {top})", f"({span} + {EPS})")
    b.both("eb_arch", arch, absolute=True)
    b.both("eb_position", {s: g.ratio(f"abs({g.mean([f'y{i}' for i in BROW_LOWER[s]])} - y{EYE[s]['top']})", f"(midface_h + {EPS})") for s in "rl"})
    flare = {}
    for s, sign, a, z in (("r", "-", 3, 5), ("l", "", 1, 3)):
        rise = f"({g.by_x(BROW_UPPER[s], z, 'y')} - {g.by_x(BROW_UPPER[s], a, 'y')})"
        flare[s] = f"({sign}{g.ratio(rise, f'({g.by_x(BROW_UPPER[s], z, "x")} - {g.by_x(BROW_UPPER[s], a, "x")} + {EPS})')})"
    b.put(**{f"eb_medial_flare_{s}": flare[s] for s in "rl"})
    b.put(**{f"eb_lateral_thickness_{s}": _per_width(g, f"abs(y{BROW_UPPER[s][0]} - y{BROW_LOWER[s][0]})") for s in "rl"})
    b.mean("eb_medial_flare")
    b.mean("eb_lateral_thickness")
    b.asym("eb_lateral_thickness")
    return b.done()


def _eye(g: Geometry) -> Family:
    b = _Builder(g)
    for s in "rl":
        e = EYE[s]
        b.put(**{f"eye_fissure_length_{s}": _per_width(g, g.dist(e["outer"], e["inner"])), f"eye_fissure_height_{s}": _per_width(g, g.dist(e["top"], e["bottom"]))})
    for name in ("eye_fissure_length", "eye_fissure_height"):
        b.mean(name)
    for name in ("eye_fissure_length", "eye_fissure_height"):
        b.asym(name)
    b.put(**{f"eye_fissure_slant_{s}": f"degrees(atan2(-(y{EYE[s]['outer']} - y{EYE[s]['inner']}), abs(x{EYE[s]['outer']} - x{EYE[s]['inner']})))" for s in "rl"})
    b.mean("eye_fissure_slant")
    b.derive(eye_fissure_slant_asym="abs(eye_fissure_slant_r - eye_fissure_slant_l)")
    aspect = {s: g.ratio(f"eye_fissure_height_{s}", f"(eye_fissure_length_{s} + {EPS})") for s in "rl"}
    b.derive(**{f"eye_fissure_aspect_{s}": aspect[s] for s in "rl"}, eye_fissure_aspect_mean=f"({aspect['r']} + {aspect['l']}) / {num(2.0)}")
    b.put(inter_canthal_distance=_per_width(g, g.dist(133, 362)), inter_pupillary_distance=_per_width(g, g.dist(468, 473)), outer_canthal_distance=_per_width(g, g.dist(33, 263)))
    b.derive(canthal_to_pupillary_ratio=g.ratio("inter_canthal_distance", f"(inter_pupillary_distance + {EPS})"))
    b.both("eye_epicanthus_angle", {s: g.angle(EYE[s]["inner"], *INNER_LIDS[s]) for s in "rl"})
    for s in "rl":
        e = EYE[s]
        b.put(**{f"eye_upper_lid_to_iris_{s}": _per_width(g, f"y{e['iris']} - y{e['top']}"), f"eye_lower_lid_to_iris_{s}": _per_width(g, f"y{e['bottom']} - y{e['iris']}")})
    for name in ("eye_upper_lid_to_iris", "eye_lower_lid_to_iris"):
        b.mean(name)
        b.asym(name)
    b.both("eye_area", {s: _per_width(g, g.area(EYE_RING[s]), 2) for s in "rl"})
    length = "(eye_fissure_length_{0} * bizyg)"
    fill = {s: g.ratio(f"(eye_area_{s} * bizyg * bizyg)", f"({length.format(s)} * {length.format(s)} + {EPS})") for s in "rl"}
    b.derive(**{f"eye_fissure_fill_{s}": fill[s] for s in "rl"}, eye_fissure_fill_mean=f"({fill['r']} + {fill['l']}) / {num(2.0)}")
    for s in "rl":
        e = EYE[s]
        b.put(**{f"iris_offset_{a}_{s}": g.ratio(f"({a}{e['iris']} - {g.middle(a, e['outer'], e['inner'])})", f"({g.dist(e['outer'], e['inner'])} + {EPS})") for a in "xy"})
    gaze = {a: f"(iris_offset_{a}_r - iris_offset_{a}_l)" for a in "xy"}
    b.derive(gaze_asym_x=gaze["x"], gaze_asym_y=gaze["y"], gaze_asym_norm=f"sqrt({gaze['x']} * {gaze['x']} + {gaze['y']} * {gaze['y']})")
    return b.done()


def _nose(g: Geometry) -> Family:
    b = _Builder(g)
    midface = f"(midface_h + {EPS})"
    b.put(nose_length=_per_width(g, g.dist(168, 2)), nose_bridge_length=g.ratio(g.dist(168, 1), midface))
    b.put(nose_bridge_width=_per_width(g, g.dist(196, 419)), nose_tip_width=_per_width(g, g.dist(45, 275)), nose_base_width=_per_width(g, g.dist(98, 327)))
    b.derive(nose_tip_to_bridge_ratio=g.ratio("nose_tip_width", f"(nose_bridge_width + {EPS})"))
    b.put(nose_tip_midline_dent=_per_width(g, f"y1 - {g.middle('y', 45, 275)}"))
    b.both("nose_ala_height", {s: _per_width(g, f"abs(y{ALA_CREST[s]} - y{ALA[s]})") for s in "rl"})
    b.put(nasolabial_angle=g.angle(2, 1, 0), nose_tip_elevation=_per_width(g, "y2 - y1"), ala_flare_angle=g.angle(2, 98, 327))
    b.put(columella_length=g.ratio("abs(y2 - y1)", midface), columella_hang_below_ala=g.ratio(f"(y2 - {g.middle('y', 98, 327)})", midface))
    b.put(nose_to_face_area_ratio=g.ratio(g.star(g.points((168, 98, 1, 327))), f"({g.area(OVAL)} + {EPS})"))
    return b.done()


def _philtrum(g: Geometry) -> Family:
    b = _Builder(g)
    b.put(philtrum_length=g.ratio(g.dist(2, 0), "midface_h"), philtrum_width=_per_width(g, g.dist(37, 267)))
    return b.done()


def _mouth(g: Geometry) -> Family:
    b = _Builder(g)
    corners, peaks = g.middle("y", 61, 291), g.middle("y", 37, 267)
    level = lambda which: g.mean([f"y{i}" for i in which])
    b.put(mouth_width=_per_width(g, g.dist(61, 291)), mouth_opening=_per_width(g, g.dist(13, 14)))
    b.put(upper_vermilion_height=_per_width(g, "abs(y13 - y0)"), lower_vermilion_height=_per_width(g, "abs(y17 - y14)"), vermilion_total=_per_width(g, "abs(y13 - y0) + abs(y17 - y14)"))
    b.put(cupid_bow_drop=_per_width(g, f"y0 - {peaks}"), mouth_corner_drop=_per_width(g, f"{corners} - y0"))
    b.put(mouth_triangularity=_per_width(g, f"{corners} - {peaks}"), mouth_tenting=g.ratio(f"({corners} - {peaks})", f"({g.dist(37, 267)} + {EPS})"))
    b.put(mouth_upper_curvature_c2=f"{g.curvature(UPPER_LIP_OUTER)} * bizyg")
    b.put(upper_lip_eversion=_per_width(g, f"{level(UPPER_LIP_INNER)} - {level(UPPER_LIP_OUTER)}"), lower_lip_eversion=_per_width(g, f"{level(LOWER_LIP_OUTER)} - {level(LOWER_LIP_INNER)}"))
    mid = g.mean([f"x{i}" for i in LIP_MIDLINE])
    b.put(lip_midline_x_std=_per_width(g, f"sqrt({g.mean([f'(x{i} - {mid}) * (x{i} - {mid})' for i in LIP_MIDLINE])})"))
    return b.done()


def _chin(g: Geometry) -> Family:
    b = _Builder(g)
    b.put(chin_height=_per_width(g, "abs(y152 - y18)"), chin_width=_per_width(g, g.dist(176, 400)), chin_pointedness_angle=g.angle(152, 176, 400), jaw_bigonial_width=_per_width(g, g.dist(172, 397)))
    return b.done()


def _forehead(g: Geometry) -> Family:
    b = _Builder(g)
    b.put(forehead_height=_per_width(g, "abs(y10 - y9)"), forehead_width_upper=_per_width(g, g.dist(103, 332)), forehead_width_mid=_per_width(g, g.dist(54, 284)))
    b.derive(forehead_taper_ratio=g.ratio("forehead_width_upper", f"(forehead_width_mid + {EPS})"))
    return b.done()


def _face(g: Geometry) -> Family:
    b = _Builder(g)
    jaw, forehead, chin, around = g.dist(172, 397), g.dist(54, 284), g.dist(176, 400), g.perimeter(OVAL)
    b.put(face_aspect_ratio=g.ratio("bizyg", f"(face_h + {EPS})"), face_roundness=g.ratio(f"({num(4.0)} * pi() * {g.area(OVAL)})", f"({around} * {around} + {EPS})"))
    b.put(face_width_uniformity=g.ratio(f"(({jaw} + {forehead}) / {num(2.0)})", f"(bizyg + {EPS})"), jaw_to_forehead_ratio=g.ratio(jaw, f"({forehead} + {EPS})"))
    b.put(face_triangularity=g.ratio(f"({forehead} - {chin})", f"({forehead} + {EPS})"))
    apart = [f"sqrt((x{r} + x{l}) * (x{r} + x{l}) + (y{r} - y{l}) * (y{r} - y{l}))" for r, l in MIRRORED]
    b.put(face_asymmetry=_per_width(g, g.mean(apart)))
    return b.done()


def _midface(g: Geometry) -> Family:
    b = _Builder(g)
    b.put(midface_width=_per_width(g, g.dist(205, 425)))
    b.both("malar_bulge", {s: _per_width(g, f"{sign} * ({g.edge_x(g.nearest(OVAL, sign, CHEEK[s], 2), CHEEK[s])} - x{CHEEK[s]})") for s, sign in SIDES}, absolute=True)
    b.both("cheek_area", {s: _per_width(g, g.star(g.and_point(g.nearest(OVAL, sign, CHEEK[s], 4), CHEEK[s])), 2) for s, sign in SIDES})
    return b.done()


_FAMILIES = {"eyebrow": _eyebrow, "eye": _eye, "nose": _nose, "philtrum": _philtrum, "mouth": _mouth, "chin": _chin, "forehead": _forehead, "face": _face, "midface": _midface}


def families(g: Geometry | None = None) -> dict[str, Family]:
    """All families, in the order of their output."""
    return {name: build(g or Geometry()) for name, build in _FAMILIES.items()}


@lru_cache(maxsize=1)
def _spark_families() -> dict[str, Family]:
    return families()


#: The 120 measurements in the order of the output.
FEATURES: list[str] = [name for family in families().values() for name in family.order]


def with_features(df: DataFrame, names: Iterable[str] | None = None, skip: str | None = None) -> DataFrame:
    """df's columns but its points, with the measurements named (all by default), in order.

    df: point columns x0, y0, .. and the scales bizyg, face_h and midface_h, as points.canonical gives them. skip: a
    boolean expression; rows where it is true get NULLs. Only the families that names need are built.
    """
    wanted = FEATURES if names is None else [f for f in FEATURES if f in set(names)]
    if names is not None and (unknown := set(names) - set(FEATURES)):
        raise ValueError(f"no such measurements: {sorted(unknown)}")
    used = {k: f for k, f in _spark_families().items() if set(f.order) & set(wanted)}
    measured = {n: e for f in used.values() for n, e in f.measured.items()}
    derived = {n: e for f in used.values() for n, e in f.derived.items()}
    other = [c for c in df.columns if not (c[0] in "xy" and c[1:].isdigit())]
    kept = [f"`{c}`" for c in other]
    first = df.selectExpr(*kept, *[f"{e} AS {n}" for n, e in measured.items()])
    gate = (lambda e: f"CASE WHEN NOT coalesce({skip}, false) THEN {e} END") if skip else (lambda e: e)
    return first.selectExpr(*kept, *[f"{gate(derived.get(n, n))} AS {n}" for n in wanted])
