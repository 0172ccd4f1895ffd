"""References, z-scores, selection, ontology, privacy, decisions and short lists on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from morpholake.operators import average, decisions, ontology, privacy, reference, selection
from morpholake.sources import hooks, sinks, tables

LEAD = "disease string, image_id string, frontal_ok boolean, derotated boolean, pose_yaw double, pose_pitch double, pose_roll double"


def wide(spark, rows):
    return spark.createDataFrame([("d", str(i), ok, None, None, None, None, a, b) for i, (ok, a, b) in enumerate(rows)], f"{LEAD}, feat_a double, feat_b double")


def test_reference_and_scores(spark):
    controls = wide(spark, [(True, 8.0, 1.0), (True, 10.0, float("nan")), (True, 12.0, None), (False, 100.0, 1.0), (None, -100.0, 1.0)])
    ref = {r["feature"]: r for r in reference.load_reference(controls).collect()}
    assert (ref["feat_a"]["mean"], ref["feat_a"]["sd"], ref["feat_a"]["n"]) == (10.0, 2.0, 3) and ref["feat_b"]["n"] == 1 and ref["feat_b"]["sd"] is None
    table = spark.createDataFrame([("feat_a", 10.0, 2.0, 3), ("feat_b", 1.0, 0.0, 3)], "feature string, mean double, sd double, n long")
    got = reference.zscore(wide(spark, [(True, 10.0, 5.0), (False, 12.0, 5.0), (None, 6.0, None)]), reference.load_reference(table)).orderBy("image_id").collect()
    assert [r["feat_a"] for r in got] == [0.0, 1.0, -2.0] and {r["feat_b"] for r in got} == {None}
    for bad in (spark.range(1), table.select("feature", "mean"), table.drop("n")):
        with pytest.raises(ValueError):
            reference.load_reference(bad)
    with pytest.raises(ValueError):
        reference.zscore(controls.select("disease", "frontal_ok"), table)


def test_selection_errors_and_mask(spark):
    columns = spark.createDataFrame([("a_r",), ("a_l",), ("b",)], "csv_column string")
    mapping = lambda rows: spark.createDataFrame(rows, "cohort string, kind string, item string")
    groups = spark.createDataFrame([("g", "a_mean"), ("h", "NOT_APPLICABLE")], "feature_group string, csv_column string")
    found = selection.selected_columns(mapping([("c", "feature_groups", "g"), ("c", "feature_groups", "none")]), tables.clean_groups(groups), columns)
    assert sorted(r["csv_column"] for r in found.collect()) == ["a_l", "a_r"]
    for rows, table in (([("c", "extra_columns", "zz")], groups), ([("c", "custom_features", "p")], groups), ([("c", "feature_groups", "g")], None)):
        with pytest.raises(ValueError):
            selection.selected_columns(mapping(rows), table, columns)
    df = spark.createDataFrame([("c", 1.0, 2.0), ("", 1.0, 2.0)], "disease string, a_r double, b double")
    rows = {r["disease"]: r for r in selection.mask(df, found).collect()}
    assert rows["c"]["b"] is None and rows["c"]["a_r"] == 1.0 and rows[""]["b"] == 2.0
    selection.check_cohorts(df, found)
    with pytest.raises(ValueError):
        selection.check_cohorts(df, found, strict=True)
    text = lambda s: tables.mapping_rows(spark.createDataFrame([(s,)], "value string"))
    got = text('{"by_disease": {"x": {"feature_groups": ["g"], "extra_columns": ["b"]}}}').collect()
    assert sorted((r["cohort"], r["kind"], r["item"]) for r in got) == [("x", "extra_columns", "b"), ("x", "feature_groups", "g")]
    for bad in ('{"by_disease": {"x": {"feature_groups": []}}}', "[1]", '{"other": 1}'):
        with pytest.raises(Exception, match="a mapping is|without any column"):
            text(bad).collect()


def test_obo(spark, tmp_path):
    (tmp_path / "x.obo").write_text('format-version: 1.2\n\n[Term]\nid: T:1\nname: Some Disease\nsynonym: "Other \\"name\\"" EXACT []\nxref: OMIM:1 {a="b"}\n\n[Term]\nid: T:2\nname: gone\nis_obsolete: true\n\n[Typedef]\nid: r\n')
    terms, synonyms, xrefs = tables.read_obo(spark, str(tmp_path / "x.obo"))
    assert [tuple(r) for r in terms.collect()] == [("T:1", "Some Disease")] and [r["xref"] for r in xrefs.collect()] == ["OMIM:1"] and synonyms.count() == 1
    names = spark.createDataFrame([("some disease 2",), ("nothing",), (None,)], "name string")
    resolved, unresolved, cache = ontology.resolve_with_cache(names, spark.createDataFrame([], ", ".join(f"{c} string" for c in ontology.CACHE.fieldNames())), terms, synonyms, xrefs)
    assert [(r["mondo_id"], r["matched_via"], r["omim_xrefs"]) for r in resolved.collect()] == [("T:1", "fuzzy", "OMIM:1")]
    assert [r[0] for r in unresolved.collect()] == ["nothing"] and cache.count() == 1


def test_privacy_statistics(spark):
    rng = np.random.default_rng(0)
    train, held = rng.normal(size=(50, 8)), rng.normal(size=(40, 8))
    fake = train[:20] + 1e-3 * rng.normal(size=(20, 8))
    rows = [(i, s, "c", v.tolist()) for i, (s, v) in enumerate([*[("train", v) for v in train], *[("heldout", v) for v in held], *[("synthetic", v) for v in fake]])]
    df = spark.createDataFrame([*rows, (999, "train", "c", [0.0] * 8)], "id long, split string, cohort string, embedding array<double>")
    audit = privacy.run_audit(df, percentiles=[5, 20, 5], draws=20)
    flags = audit["flagging"].orderBy("percentile").collect()
    assert [r["percentile"] for r in flags] == [5, 20] and flags[0]["synthetic_pct"] == 100.0 and flags[0]["heldout_total"] == 40
    nnaa = {r["quantity"]: r for r in audit["nnaa"].collect()}
    assert nnaa["aa_train_synth"]["ci_lower"] <= nnaa["aa_train_synth"]["median"] <= nnaa["aa_train_synth"]["ci_upper"]
    assert sinks.nnaa_rows(audit["nnaa"], {"train": 50, "heldout": 40, "synthetic": 20}, 20).first()["privacy_loss"][0] in "+-"
    assert "flagging" in sinks.results_json(audit["flagging"], audit["nnaa"]).first()["value"]
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    d = lambda a, b: 1 - unit(a) @ unit(b).T
    dd, hh = d(held, held), d(fake, fake)
    np.fill_diagonal(dd, np.inf)
    np.fill_diagonal(hh, np.inf)
    cross = d(held, fake)
    expected = 0.5 * (np.mean(cross.min(1) > dd.min(1)) + np.mean(cross.min(0) > hh.min(1)))
    faces = privacy.drop_no_face(df)
    aa = privacy.adversarial_accuracy(faces.where("split = 'heldout'"), faces.where("split = 'synthetic'")).first()["aa"]
    assert aa == pytest.approx(expected)
    assert privacy.adversarial_accuracy(faces.where("id = 0"), faces.where("split = 'synthetic'")).first()["aa"] is None
    spread = privacy.bootstrap_distances(privacy.min_distances(faces.where("split = 'heldout'"), faces.where("split = 'train'")), 30)
    assert 0.2 < privacy.summary(spread).first()["median"] < 0.8
    with pytest.raises(ValueError):
        privacy.bootstrap_rows(faces, faces, 0)
    with pytest.raises(ValueError):
        privacy.run_audit(df.where("split = 'train'"))


def test_decisions_and_boxes(spark):
    box = spark.createDataFrame([([(10.0, 20.0), (110.0, 60.0)],)], "p array<struct<x:double,y:double>>")
    for margin, expected in ((0.0, (10, -10, 100)), (0.3, (-20, -40, 160))):
        assert tuple(box.select(decisions.crop_box(F.col("p"), margin).alias("b")).first()["b"]) == expected
    assert box.select(decisions.face_short_side(F.col("p"))).first()[0] == 40
    assert [bool(r[0]) for r in spark.range(1, 6).select(decisions.is_power_of_two(F.col("id"))).collect()] == [True, True, False, True, False]
    assert len(box.select(average.boundary_points(F.col("p")).alias("b")).first()["b"]) == 2
    mixed = spark.createDataFrame([([(0.0, 0.0)], [(9.0, 5.0)])], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    assert tuple(mixed.select(average.weighted_points(F.col("a"), F.col("b"), 0.5).alias("m")).first()["m"][0]) == (4.0, 2.0)
    assert mixed.select(average.aligned(F.col("b"), 100, 100).alias("m")).first()["m"]["scale"] == 80.0


def test_lists(spark):
    lists = spark.createDataFrame([("0,3,10-12",)], "s string")
    assert lists.select(tables.seeds(F.col("s"))).first()[0] == [0, 3, 10, 11, 12]
    assert spark.createDataFrame([("10, 1,10",)], "s string").select(tables.percentiles(F.col("s"))).first()[0] == [1, 10]
    for bad in ("", "a", "1-"):
        with pytest.raises(Exception, match="not a list of seeds"):
            spark.createDataFrame([(bad,)], "s string").select(tables.seeds(F.col("s"))).collect()


def test_hooks(spark):
    images = spark.createDataFrame([("c", "a", bytearray(b"12")), ("c", "b", bytearray(b"")), ("c", "z", bytearray(b"9"))], "cohort string, image_id string, content binary")
    embed = lambda: lambda content: np.array([1.0 / len(content), 1.0])
    rows = {r["image"]: r["embedding"] for r in hooks.embed_images(images, embed, 2, "stub", "train").collect()}
    assert rows["a"] == [0.5, 1.0] and rows["b"] == [0.0, 0.0]
    detect = lambda: lambda content: {"landmarks_3d": [[0.0, 0.0, 0.0]], "image_size": [1.0, 1.0]} if content else None
    assert hooks.detect_landmarks(images, detect).count() == 2
    near = hooks.perceptual_nearest(images.select(F.col("image_id").alias("id"), "cohort", "content"), images.select(F.col("image_id").alias("id"), "cohort", "content"), lambda: lambda q, rs: np.array([abs(len(q) - len(r)) for r in rs]), exclude_self=True)
    assert {r["id"]: r["dist"] for r in near.collect()} == {"a": 1.0, "b": 1.0, "z": 1.0}
