"""All 120 measurements, their order, and the nearest rotation, by formulas and landmark numbers written here alone."""

from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from morpholake.operators import features, phenotypes, pose
from morpholake.plans import fixtures
from morpholake.schema import LANDMARKS, POINTS

# Landmark numbers of the public face mesh, right then left.
BROW_TOP = ((70, 63, 105, 66, 107), (300, 293, 334, 296, 336))
BROW_LOW = ((46, 53, 52, 65, 55), (276, 283, 282, 295, 285))
OUTER, INNER, TOP, BOTTOM, IRIS = (33, 263), (133, 362), (159, 386), (145, 374), (468, 473)
RING = (
    (33, 7, 163, 144, 145, 153, 154, 155, 133, 173, 157, 158, 159, 160, 161, 246),
    (263, 249, 390, 373, 374, 380, 381, 382, 362, 398, 384, 385, 386, 387, 388, 466),
)
OVAL = [
    10, 338, 297, 332, 284, 251, 389, 356, 454, 323, 361, 288, 397, 365, 379, 378, 400, 377,
    152, 148, 176, 149, 150, 136, 172, 58, 132, 93, 234, 127, 162, 21, 54, 103, 67, 109,
]
UPPER_OUT, UPPER_IN = (185, 40, 39, 37, 0, 267, 269, 270, 409), (191, 80, 81, 82, 13, 312, 311, 310, 415)
LOWER_OUT, LOWER_IN = (146, 91, 181, 84, 17, 314, 405, 321, 375), (95, 88, 178, 87, 14, 317, 402, 318, 324)
PAIRS = [(33, 263), (133, 362), (159, 386), (145, 374), (98, 327), (49, 279), (61, 291), (234, 454), (172, 397), (103, 332), (176, 400), (116, 345), (205, 425)]
TINY = 1e-12


def shoelace(z):
    """Area of a ring of complex points in their order."""
    return abs(sum((a.conjugate() * b).imag for a, b in pairwise([*z, z[0]]))) / 2


def star(z):
    """Area of complex points ordered by their angle about their mean."""
    return shoelace(sorted(z, key=lambda p: np.angle(p - np.mean(z))))


def measured(z):
    """The measurements in order; z: canonical points as complex numbers."""
    x, y = z.real, z.imag
    far = lambda a, b: abs(z[a] - z[b])
    level = lambda *which: np.mean(y[list(which)])
    corner = lambda at, a, b: np.degrees(np.arccos(np.clip(((z[a] - z[at]) * (z[b] - z[at]).conjugate()).real / (far(a, at) * far(b, at) + TINY), -1, 1)))
    width, middle, out = far(234, 454), abs(y[168] - y[2]), {}
    mean = lambda name: out.update({f"{name}_mean": (out[f"{name}_r"] + out[f"{name}_l"]) / 2})

    def asym(name, absolute=False):
        base = out[f"{name}_mean"]
        out[f"{name}_asym"] = abs(out[f"{name}_r"] - out[f"{name}_l"]) / ((abs(base) if absolute else base) + TINY)

    def sides(name, value):
        out[f"{name}_r"], out[f"{name}_l"] = value(0), value(1)

    def four(name, value, absolute=False):
        sides(name, value)
        mean(name)
        asym(name, absolute)

    by_x = lambda which: sorted(z[list(which)], key=lambda p: p.real)
    slope = lambda a, b: (b.imag - a.imag) / (b.real - a.real + TINY)
    brow = [by_x((*BROW_TOP[s], *BROW_LOW[s])) for s in (0, 1)]
    top = [by_x(BROW_TOP[s]) for s in (0, 1)]
    four("eb_thickness", lambda s: star(brow[s]) / width**2)
    out["eb_inter_distance"] = abs(brow[0][-1] - brow[1][0]) / width
    four("eb_arch", lambda s: ((top[s][0].imag + top[s][4].imag) / 2 - min(p.imag for p in top[s])) / (abs(top[s][4] - top[s][0]) + TINY), absolute=True)
    four("eb_position", lambda s: abs(level(*BROW_LOW[s]) - y[TOP[s]]) / (middle + TINY))
    sides("eb_medial_flare", lambda s: slope(top[1][0], top[1][2]) if s else -slope(top[0][2], top[0][4]))
    sides("eb_lateral_thickness", lambda s: abs(y[BROW_TOP[s][0]] - y[BROW_LOW[s][0]]) / width)
    mean("eb_medial_flare")
    mean("eb_lateral_thickness")
    asym("eb_lateral_thickness")

    for s, side in enumerate("rl"):
        out[f"eye_fissure_length_{side}"] = far(OUTER[s], INNER[s]) / width
        out[f"eye_fissure_height_{side}"] = far(TOP[s], BOTTOM[s]) / width
    for step in (mean, asym):
        for name in ("eye_fissure_length", "eye_fissure_height"):
            step(name)
    sides("eye_fissure_slant", lambda s: np.degrees(np.arctan2(y[INNER[s]] - y[OUTER[s]], abs(x[OUTER[s]] - x[INNER[s]]))))
    mean("eye_fissure_slant")
    out["eye_fissure_slant_asym"] = abs(out["eye_fissure_slant_r"] - out["eye_fissure_slant_l"])
    sides("eye_fissure_aspect", lambda s: out["eye_fissure_height_" + "rl"[s]] / (out["eye_fissure_length_" + "rl"[s]] + TINY))
    mean("eye_fissure_aspect")
    for name, pair in (("inter_canthal_distance", INNER), ("inter_pupillary_distance", IRIS), ("outer_canthal_distance", OUTER)):
        out[name] = far(*pair) / width
    out["canthal_to_pupillary_ratio"] = out["inter_canthal_distance"] / (out["inter_pupillary_distance"] + TINY)
    four("eye_epicanthus_angle", lambda s: corner(INNER[s], *((173, 155), (398, 382))[s]))
    for s, side in enumerate("rl"):
        out[f"eye_upper_lid_to_iris_{side}"] = (y[IRIS[s]] - y[TOP[s]]) / width
        out[f"eye_lower_lid_to_iris_{side}"] = (y[BOTTOM[s]] - y[IRIS[s]]) / width
    for name in ("eye_upper_lid_to_iris", "eye_lower_lid_to_iris"):
        mean(name)
        asym(name)
    four("eye_area", lambda s: shoelace(z[list(RING[s])]) / width**2)
    sides("eye_fissure_fill", lambda s: shoelace(z[list(RING[s])]) / (far(OUTER[s], INNER[s]) ** 2 + TINY))
    mean("eye_fissure_fill")
    away = [(z[IRIS[s]] - (z[OUTER[s]] + z[INNER[s]]) / 2) / (far(OUTER[s], INNER[s]) + TINY) for s in (0, 1)]
    for s, side in enumerate("rl"):
        out[f"iris_offset_x_{side}"], out[f"iris_offset_y_{side}"] = away[s].real, away[s].imag
    gaze = away[0] - away[1]
    out |= {"gaze_asym_x": gaze.real, "gaze_asym_y": gaze.imag, "gaze_asym_norm": abs(gaze)}

    out |= {"nose_length": far(168, 2) / width, "nose_bridge_length": far(168, 1) / (middle + TINY)}
    out |= {"nose_bridge_width": far(196, 419) / width, "nose_tip_width": far(45, 275) / width, "nose_base_width": far(98, 327) / width}
    out |= {"nose_tip_to_bridge_ratio": far(45, 275) / far(196, 419), "nose_tip_midline_dent": (y[1] - level(45, 275)) / width}
    four("nose_ala_height", lambda s: abs(y[(49, 279)[s]] - y[(98, 327)[s]]) / width)
    out |= {"nasolabial_angle": corner(2, 1, 0), "nose_tip_elevation": (y[2] - y[1]) / width, "ala_flare_angle": corner(2, 98, 327)}
    out |= {"columella_length": abs(y[2] - y[1]) / (middle + TINY), "columella_hang_below_ala": (y[2] - level(98, 327)) / (middle + TINY)}
    out["nose_to_face_area_ratio"] = star(z[[168, 98, 1, 327]]) / (shoelace(z[OVAL]) + TINY)

    out |= {"philtrum_length": far(2, 0) / middle, "philtrum_width": far(37, 267) / width}

    rise = level(61, 291) - level(37, 267)
    upper, lower = abs(y[13] - y[0]), abs(y[17] - y[14])
    out |= {"mouth_width": far(61, 291) / width, "mouth_opening": far(13, 14) / width}
    out |= {"upper_vermilion_height": upper / width, "lower_vermilion_height": lower / width, "vermilion_total": (upper + lower) / width}
    out |= {"cupid_bow_drop": (y[0] - level(37, 267)) / width, "mouth_corner_drop": (level(61, 291) - y[0]) / width}
    out |= {"mouth_triangularity": rise / width, "mouth_tenting": rise / (far(37, 267) + TINY)}
    out["mouth_upper_curvature_c2"] = np.polyfit(x[list(UPPER_OUT)], y[list(UPPER_OUT)], 2)[0] * width
    out |= {"upper_lip_eversion": (level(*UPPER_IN) - level(*UPPER_OUT)) / width, "lower_lip_eversion": (level(*LOWER_OUT) - level(*LOWER_IN)) / width}
    out["lip_midline_x_std"] = np.std(x[[0, 13, 14, 17]]) / width

    out |= {"chin_height": abs(y[152] - y[18]) / width, "chin_width": far(176, 400) / width, "chin_pointedness_angle": corner(152, 176, 400), "jaw_bigonial_width": far(172, 397) / width}

    out |= {"forehead_height": abs(y[10] - y[9]) / width, "forehead_width_upper": far(103, 332) / width, "forehead_width_mid": far(54, 284) / width, "forehead_taper_ratio": far(103, 332) / far(54, 284)}

    ring, jaw, brow_width = z[OVAL], far(172, 397), far(54, 284)
    out |= {"face_aspect_ratio": width / (abs(y[10] - y[152]) + TINY), "face_roundness": 4 * np.pi * shoelace(ring) / (abs(ring - np.roll(ring, 1)).sum() ** 2 + TINY)}
    out |= {"face_width_uniformity": (jaw + brow_width) / 2 / (width + TINY), "jaw_to_forehead_ratio": jaw / (brow_width + TINY), "face_triangularity": (brow_width - far(176, 400)) / (brow_width + TINY)}
    out["face_asymmetry"] = np.mean([abs(z[r] + z[l].conjugate()) for r, l in PAIRS]) / width

    out["midface_width"] = far(205, 425) / width
    cheek, sign = (116, 345), (-1, 1)

    def closest(s, n):
        return sorted((p for p in ring if np.sign(p.real) == sign[s]), key=lambda p: abs(p.imag - y[cheek[s]]))[:n]

    def edge(s):
        a, b = closest(s, 2)
        return (a.real + b.real) / 2 if abs(a.imag - b.imag) < 1e-6 else a.real + (y[cheek[s]] - a.imag) * (b.real - a.real) / (b.imag - a.imag)

    four("malar_bulge", lambda s: sign[s] * (edge(s) - x[cheek[s]]) / width, absolute=True)
    four("cheek_area", lambda s: star([*closest(s, 4), z[cheek[s]]]) / width**2)
    return out


def record(name, points, matrix=None):
    """A landmark record of points in pixels of a 1000 x 800 image."""
    m = None
    if matrix is not None:
        m = np.eye(4)
        m[:3, :3] = matrix
        m = m.tolist()
    return (name, "d", (np.column_stack((points, np.zeros(POINTS))) / [1000, 800, 1]).tolist(), [1000.0, 800.0], m, None)


def faces(n):
    rng = np.random.default_rng(11)
    return [np.column_stack((fixtures.XS, fixtures.YS)) + rng.uniform(-9, 9, (POINTS, 2)) for _ in range(n)]


def level_eyes(p):
    z = p[:, 0] + 1j * p[:, 1]
    across = z[362] - z[133]
    return (z - (z[133] + z[362]) / 2) * abs(across) / across


def test_every_measurement_in_its_order(spark):
    every = faces(6)
    df = spark.createDataFrame([record(str(i), p) for i, p in enumerate(every)], LANDMARKS)
    got = {r["image_id"]: r.asDict() for r in phenotypes.extract_features(df).collect()}
    for i, p in enumerate(every):
        expected = measured(level_eyes(p))
        assert list(expected) == features.FEATURES and len(expected) == 120
        assert [c for c in got[str(i)] if c in expected] == list(expected)
        for name, value in expected.items():
            assert got[str(i)][name] == pytest.approx(value, rel=1e-9, abs=1e-9), name


def test_nearest_rotation_of_any_matrix(spark):
    """Scaled, sheared, mirrored and noisy matrices: no other rotation is nearer, and de-rotation uses that one."""
    rng = np.random.default_rng(12)
    made = [np.eye(3) * 2.5, np.array([[1, 0.3, 0], [0, 1, 0.2], [0, 0, 1.0]]), np.diag([1.0, 0.9, -1.1]), *(np.linalg.qr(rng.normal(size=(3, 3)))[0] + rng.normal(size=(3, 3)) * 0.2 for _ in range(9))]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(made)] + [(99, None)], "id long, transformation_matrix array<array<double>>")
    got = {r["id"]: r["rotation"] for r in pose.with_rotation(df).collect()}
    assert got.pop(99) is None
    for i, m in enumerate(made):
        two = np.array(list(got[i])).reshape(2, 3)
        r = np.vstack((two, np.cross(*two)))
        assert r @ r.T == pytest.approx(np.eye(3), abs=1e-9)
        # The nearest rotation R maximises trace(R' M): R' M is symmetric, and no small turn of R gains.
        assert r.T @ m == pytest.approx((r.T @ m).T, abs=1e-9)
        q = np.linalg.qr(rng.normal(size=(400, 3, 3)))[0]
        q[np.linalg.det(q) < 0, :, 0] *= -1
        assert (np.einsum("nij,ij->n", q, m) <= np.trace(r.T @ m) + 1e-9).all()


def test_derotation_by_a_matrix_that_is_no_rotation(spark):
    p, m = faces(1)[0], np.array([[1.9, 0.2, 0.5], [0.1, 2.1, -0.3], [-0.4, 0.35, 1.8]])
    df = spark.createDataFrame([record("f", p, m)], LANDMARKS).withColumn("points", pose.pixels())
    canon = np.array([[q["x"], q["y"]] for q in pose.canonical(pose.with_rotation(df), fixtures.DEPTH).select(F.explode_outer("canon").alias("q")).select("q.*").collect()])
    r = m.copy()
    for _ in range(60):  # the polar factor by Newton's iteration
        r = (r + np.linalg.inv(r).T) / 2
    q = p - p.mean(axis=0)
    q = (q - np.outer(fixtures.DEPTH, r[:2, 2]) * np.hypot(*(q[234] - q[454]))) @ np.linalg.inv(r[:2, :2]).T
    assert canon == pytest.approx(q - (q[133] + q[362]) / 2, abs=1e-8)
