"""Extraction end to end with choices of columns, and nearest distances in blocks against brute force."""

import numpy as np
import pytest

from morpholake.operators import extraction, ontology, privacy
from morpholake.operators.plugins import Registry
from morpholake.plans import fixtures
from morpholake.schema import LANDMARKS, POINTS

RECORDS = [(f"i{k}", cohort, np.column_stack((np.array(fixtures.XS) / 1000, np.array(fixtures.YS) / 1000, np.zeros(POINTS))).tolist(), [1000.0, 1000.0], None, None) for k, cohort in enumerate(["a", "b", "b", "", None, "c"])]


def test_custom(spark):
    records = spark.createDataFrame(RECORDS, LANDMARKS)
    plugins = Registry(groups=["eyes"])
    plugins.register(group="mine", columns=["mine_x"])(lambda points, scales: {"mine_x": float(points[0, 0])})
    groups = spark.createDataFrame([("eyes", "eye_area_mean")], "feature_group string, csv_column string")
    kind = "cohort string, kind string, item string"
    rows = [("a", "feature_groups", "eyes"), ("b", "custom_features", "mine"), ("c", "feature_groups", "unheard"), ("z", "extra_columns", "no such column")]
    table, report = extraction.extract_custom(records, spark.createDataFrame(rows, kind), groups, plugins)
    got = {r["image_id"]: r for r in table.collect()}
    have = {k: {c for c in ("eye_area_r", "mouth_width", "mine_x") if r[c] is not None} for k, r in got.items()}
    every = {"eye_area_r", "mouth_width", "mine_x"}
    assert have == {"i0": {"eye_area_r"}, "i1": {"mine_x"}, "i2": {"mine_x"}, "i3": every, "i4": every, "i5": set()}
    assert {(r[0], r[1]) for r in report.collect()} == {("a", 4), ("b", 1), ("c", 0)}
    with pytest.raises(ValueError, match="without a mapping"):
        extraction.extract_custom(records, spark.createDataFrame(rows[:2], kind), groups, plugins)
    with pytest.raises(ValueError, match="table of groups"):
        extraction.extract_custom(records, spark.createDataFrame(rows, kind), None, plugins)


def test_diseases(spark):
    records = spark.createDataFrame([r for r in RECORDS if r[1] in ("a", "b", "")], LANDMARKS)
    onto = [spark.createDataFrame(rows, t) for rows, t in (([("T:1", "Alpha"), ("T:2", "beta")], ontology.TERM), ([("T:1", "a"), ("T:2", "b"), ("T:2", "b two")], ontology.SYNONYM), ([], ontology.XREF))]
    groups = spark.createDataFrame([("eyes", "eye_area_mean"), ("lips", "mouth_width")], "feature_group string, csv_column string")
    mapping = spark.createDataFrame([("ALPHA", "eyes"), ("B two", "lips"), ("B two", "unheard")], "json_key string, item string")
    table, report = extraction.extract_for_diseases(records, mapping, groups, *onto)
    have = {r["image_id"]: {c for c in ("eye_area_r", "mouth_width") if r[c] is not None} for r in table.collect()}
    assert have == {"i0": {"eye_area_r"}, "i1": {"mouth_width"}, "i2": {"mouth_width"}, "i3": {"eye_area_r", "mouth_width"}}
    assert {tuple(r)[:4] for r in report.collect()} == {("a", "T:1", "ALPHA", 4), ("b", "T:2", "B two", 1)}
    with pytest.raises(ValueError, match="not_mapped: b"):
        extraction.extract_for_diseases(records, mapping.where("json_key = 'ALPHA'"), groups, *onto)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_nearest_distance_in_blocks(spark, block_rows):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8))
    v[60] = v[3]
    cohort = [f"c{i % 3}" for i in range(120)]
    df = spark.createDataFrame([(f"n{i}", cohort[i], v[i].tolist()) for i in range(120)] + [("alone", "d", [1.0] * 8)], "id string, cohort string, embedding array<double>")
    df = privacy.prepared(df)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    d = 1 - unit @ unit.T
    d[np.array(cohort)[:, None] != np.array(cohort)[None, :]] = np.inf
    for self_, want in ((False, d), (True, d + np.diag(np.full(120, np.inf)))):
        got = {r["id"]: r["dist"] for r in privacy.nearest_distance(df, df, exclude_self=self_, block_rows=block_rows).collect()}
        assert got.pop("alone", None) == (None if self_ else pytest.approx(0, abs=1e-9))
        assert got == {f"n{i}": pytest.approx(x, abs=1e-9) for i, x in enumerate(want.min(axis=1))}
    empty = df.limit(0)
    assert privacy.nearest_distance(df, empty).count() == privacy.nearest_distance(empty, df).count() == 0
