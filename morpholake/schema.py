"""Types of the tables that the library reads and writes, and the names and order of its measurements."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _B, _L = T.DoubleType(), T.StringType(), T.BooleanType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LANDMARKS = _struct(
    image_id=_S,
    disease=_S,
    landmarks_3d=T.ArrayType(T.ArrayType(_D)),
    image_size=T.ArrayType(_D),
    transformation_matrix=T.ArrayType(T.ArrayType(_D)),
    blendshapes=T.ArrayType(_D),
)
POINTS = 478
POINT = _struct(x=_D, y=_D)
REFERENCE = _struct(feature=_S, mean=_D, sd=_D, n=_L)
GROUPS = _struct(feature_group=_S, csv_column=_S)
CACHE = _struct(query_name=_S, mondo_id=_S, mondo_name=_S, omim_xrefs=_S, matched_via=_S, manual_override=_S)
EMBEDDINGS = _struct(split=_S, cohort=_S, image=_S, backbone=_S, embedding=T.ArrayType(T.FloatType()))
LEADING = {"disease": _S, "image_id": _S, "frontal_ok": _B, "derotated": _B, "pose_yaw": _D, "pose_pitch": _D, "pose_roll": _D}


def phenotypes(features: list[str]) -> T.StructType:
    """Schema of a wide table of measurements: the leading columns, then features."""
    return _struct(**LEADING, **dict.fromkeys(features, _D))
