"""Pose, canonical points and measurements against NumPy, and their invariants."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from morpholake.operators import features as ft
from morpholake.operators import phenotypes, pose
from morpholake.operators.plugins import Registry, with_plugins
from morpholake.plans import fixtures
from morpholake.schema import LANDMARKS, POINTS
from morpholake.sources import landmarks


def turn(yaw, pitch):
    y, p = np.radians(yaw), np.radians(pitch)
    ry = np.array([[np.cos(y), 0, np.sin(y)], [0, 1, 0], [-np.sin(y), 0, np.cos(y)]])
    rx = np.array([[1, 0, 0], [0, np.cos(p), -np.sin(p)], [0, np.sin(p), np.cos(p)]])
    return ry @ rx


DEPTH = [0.0 if i in (234, 454) else z for i, z in enumerate(fixtures.DEPTH)]


def head(seed=0):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-100, 100, (POINTS, 2))
    z = np.array(DEPTH) * 200
    xy[234], xy[454], xy[133], xy[362] = (-100, 0), (100, 0), (-20, -30), (20, -30)
    return np.column_stack((xy, z))


def record(name, points, matrix=None, size=(1000.0, 1000.0), disease="d"):
    m = None
    if matrix is not None:
        m = np.eye(4)
        m[:3, :3] = matrix
        m = m.tolist()
    pts = np.asarray(points, dtype=float) / [*size, 1.0][: np.shape(points)[1]]
    return (name, disease, pts.tolist(), list(size), m, None)


def extract(spark, records, **options):
    df = spark.createDataFrame(records, LANDMARKS)
    return {r["image_id"]: r.asDict() for r in phenotypes.extract_features(df, **options).collect()}


def test_pose_is_recovered(spark):
    h = head()
    cases = {"a": (15, 0), "b": (0, 20), "c": (20, 20)}
    seen = [record(k, np.column_stack(((h @ turn(*v).T)[:, :2] + 500, h[:, 2])), turn(*v)) for k, v in cases.items()]
    # The depths are in cheekbone widths of the observed face, which is foreshortened by a few percent.
    got = extract(spark, [*seen, record("flat", np.column_stack((h[:, :2] + 500, h[:, 2])), np.eye(3))], depth=DEPTH, features=["face_aspect_ratio", "mouth_width"])
    for k in cases:
        assert got[k]["derotated"] and abs(got[k]["mouth_width"] - got["flat"]["mouth_width"]) < 0.05
        assert got[k]["pose_yaw"] == pytest.approx(cases[k][0], abs=1e-9) or cases[k][1]
    assert got["a"]["frontal_ok"] and not got["c"]["frontal_ok"]


def test_depth_of_points_does_not_matter_and_roll_is_undone(spark):
    rng = np.random.default_rng(1)
    flat = np.column_stack((rng.uniform(0, 224, (POINTS, 2)), np.zeros(POINTS)))
    noisy = flat.copy()
    noisy[:, 2] = rng.normal(0, 50, POINTS)
    a = np.radians(25)
    rolled = flat.copy()
    rolled[:, :2] = flat[:, :2] @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
    got = extract(spark, [record("flat", flat), record("noisy", noisy), record("rolled", rolled)], features=["nasolabial_angle", "eye_area_mean", "eb_arch_r"])
    for name in ("nasolabial_angle", "eye_area_mean", "eb_arch_r"):
        assert got["flat"][name] == pytest.approx(got["noisy"][name], abs=1e-12)
        assert got["flat"][name] == pytest.approx(got["rolled"][name], rel=1e-9, abs=1e-9)
    assert got["flat"]["derotated"] is False and got["flat"]["frontal_ok"] is None


def canon_numpy(p):
    r, l = p[133], p[362]
    t = np.arctan2(*(l - r)[::-1])
    c, s = np.cos(-t), np.sin(-t)
    return (p - (r + l) / 2) @ np.array([[c, -s], [s, c]]).T


def star_numpy(p):
    q = p - p.mean(axis=0)
    q = p[np.argsort(np.arctan2(q[:, 1], q[:, 0]))]
    return 0.5 * abs(np.dot(q[:, 0], np.roll(q[:, 1], -1)) - np.dot(q[:, 1], np.roll(q[:, 0], -1)))


@pytest.mark.parametrize("seed", [0, 3])
def test_measurements_against_numpy(spark, seed):
    xs, ys = np.array(fixtures.XS, float), np.array(fixtures.YS, float)
    p = np.column_stack((xs, ys)) + np.random.default_rng(seed).uniform(-8, 8, (POINTS, 2))
    got = extract(spark, [record("f", np.column_stack((p, np.zeros(POINTS))))])["f"]
    c = canon_numpy(p)
    d = lambda a, b: float(np.hypot(*(c[a] - c[b])))
    w, m = d(234, 454), abs(c[168, 1] - c[2, 1])
    brows = [*ft.BROW_UPPER["r"], *ft.BROW_LOWER["r"]]
    left = [*ft.BROW_UPPER["l"], *ft.BROW_LOWER["l"]]
    up = np.array(sorted(c[list(ft.BROW_UPPER["r"])].tolist()))
    lip = list(ft.UPPER_LIP_OUTER)
    oval = c[list(ft.OVAL)]
    right = oval[oval[:, 0] < 0]
    two = right[np.argsort(abs(right[:, 1] - c[116, 1]), kind="stable")[:2]]
    edge = two[0, 0] + (c[116, 1] - two[0, 1]) * (two[1, 0] - two[0, 0]) / (two[1, 1] - two[0, 1])
    four = right[np.argsort(abs(right[:, 1] - c[116, 1]), kind="stable")[:4]]
    ring = np.vstack((oval, oval[:1]))
    expected = {
        "eb_thickness_r": star_numpy(c[brows]) / w**2,
        "eb_inter_distance": np.hypot(*(max(c[brows].tolist()) - np.array(min(c[left].tolist())))) / w,
        "eb_arch_r": ((up[0, 1] + up[-1, 1]) / 2 - up[:, 1].min()) / np.hypot(*(up[0] - up[-1])),
        "eb_medial_flare_r": -(up[4, 1] - up[2, 1]) / (up[4, 0] - up[2, 0]),
        "eye_fissure_length_r": d(33, 133) / w,
        "eye_fissure_slant_l": np.degrees(np.arctan2(-(c[263, 1] - c[362, 1]), abs(c[263, 0] - c[362, 0]))),
        "nose_bridge_length": d(168, 1) / m,
        "nose_to_face_area_ratio": star_numpy(c[[168, 98, 1, 327]]) / (0.5 * abs(np.dot(oval[:, 0], np.roll(oval[:, 1], -1)) - np.dot(oval[:, 1], np.roll(oval[:, 0], -1)))),
        "philtrum_length": d(2, 0) / m,
        "mouth_upper_curvature_c2": np.polyfit(c[lip, 0], c[lip, 1], 2)[0] * w,
        "lip_midline_x_std": c[[0, 13, 14, 17], 0].std() / w,
        "face_roundness": 4 * np.pi * 0.5 * abs(np.dot(oval[:, 0], np.roll(oval[:, 1], -1)) - np.dot(oval[:, 1], np.roll(oval[:, 0], -1))) / np.hypot(*np.diff(ring, axis=0).T).sum() ** 2,
        "malar_bulge_r": -(edge - c[116, 0]) / w,
        "cheek_area_r": star_numpy(np.vstack((four, c[116]))) / w**2,
        "face_asymmetry": np.mean([np.hypot(c[a, 0] + c[b, 0], c[a, 1] - c[b, 1]) for a, b in ft.MIRRORED]) / w,
    }
    for name, value in expected.items():
        assert got[name] == pytest.approx(value, rel=1e-8, abs=1e-9), name
    assert len(ft.FEATURES) == len(set(ft.FEATURES)) == 120


def test_gate_and_contracts(spark):
    p = np.column_stack((fixtures.XS, fixtures.YS, np.zeros(POINTS)))
    both = [record("front", p, np.eye(3)), record("side", p, turn(30, 0))]
    got = extract(spark, both, frontal_check=True, features=["mouth_width"])
    assert got["front"]["mouth_width"] is not None and got["side"]["mouth_width"] is None and got["side"]["derotated"] is None
    assert extract(spark, both, features=["mouth_width"])["side"]["mouth_width"] is not None
    with pytest.raises(Exception, match="transformation matrix"):
        extract(spark, [record("none", p)], frontal_check=True)
    with pytest.raises(Exception, match="478 points"):
        extract(spark, [record("few", p[:10])])
    plan = phenotypes.extract_features(spark.createDataFrame(both, LANDMARKS), features=["mouth_width"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_bad_lines(spark, tmp_path):
    point = [[0.1, 0.2, 0.3]] * POINTS
    good = {"image_id": "a", "landmarks_3d": point, "image_size": [10, 20]}
    lines = [json.dumps(good), "", "{not json", json.dumps({k: v for k, v in good.items() if k != "image_id"}), json.dumps({**good, "landmarks_3d": None}), json.dumps({**good, "landmarks_3d": [[1, 2], [3]]}), json.dumps({**good, "image_size": [1, 2, 3]}), json.dumps({**good, "image_size": ["x", "y"]})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    records, rejects = landmarks.read_landmarks(spark, str(tmp_path))
    assert [r["image_id"] for r in records.collect()] == ["a"] and rejects.count() == 6
    assert not landmarks.has_any_matrix(records) and landmarks.cohorts(records).count() == 0


def test_plugins(spark):
    reg = Registry(groups=["taken"])

    @reg.register(group="own", columns=["own_width"], native=True)
    def own(p, scales):
        return {"own_width": (p(454, "x") - p(234, "x")) / scales["bizyg"]}

    @reg.register(group="np", columns=["np_a", "np_b"])
    def by_numpy(points, scales):
        return {"np_a": float(points[:, 0].max() / scales["bizyg"]), "other": 1.0}

    @reg.register(group="broken", columns=["np_c"])
    def broken(points, scales):
        raise RuntimeError

    for bad in ({"group": "own", "columns": ["x"]}, {"group": "z", "columns": ["own_width"]}, {"group": "z", "columns": ["mouth_width"]}, {"group": "taken", "columns": ["x"]}, {"group": "", "columns": ["x"]}, {"group": "z", "columns": "x"}):
        with pytest.raises(ValueError):
            reg.register(**bad)(lambda p, s: {})
    points = [{"x": float(x), "y": float(y)} for x, y in zip(fixtures.XS, fixtures.YS, strict=True)]
    df = spark.createDataFrame([("a", points)], "id string, canon array<struct<x:double,y:double>>")
    row = with_plugins(pose.with_scales(df), reg).first()
    assert row["own_width"] == pytest.approx(1.0, rel=0.1) and row["np_a"] > 0 and row["np_b"] is None and row["np_c"] is None
    with pytest.raises(RuntimeError):
        reg.register(group="late", columns=["late"])(lambda p, s: {})
    assert reg.freeze() == ["own_width", "np_a", "np_b", "np_c"]


def test_streaming(spark, tmp_path):
    from morpholake.streaming.features import stream_landmarks, write_stream

    point = np.column_stack((fixtures.XS, fixtures.YS, np.zeros(POINTS))) / [1000, 1000, 1]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps({"image_id": "a", "landmarks_3d": point.tolist(), "image_size": [1000, 1000]}))
    records, _ = stream_landmarks(spark, str(tmp_path / "in"))
    found = phenotypes.extract_features(records, features=["mouth_width"])
    write_stream(found.select("image_id", F.col("mouth_width")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
