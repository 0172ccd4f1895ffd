"""The row-wise blocks over a stream of landmark records: the same functions, since they keep no state."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from morpholake.operators.phenotypes import extract_features
from morpholake.operators.reference import zscore
from morpholake.schema import LANDMARKS
from morpholake.sources.landmarks import split_records


def stream_landmarks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of the JSON Lines files that arrive in a folder."""
    schema = T.StructType([*LANDMARKS.fields, T.StructField("_corrupt_record", T.StringType())])
    return split_records(spark.readStream.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(folder))


def stream_scores(records: DataFrame, reference: DataFrame, depth: Sequence[float] | None = None, features: Iterable[str] | None = None) -> DataFrame:
    """z-scores of a stream of records against a static reference."""
    return zscore(extract_features(records, depth, features=features), reference)


def write_stream(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to Parquet files, all that is there now, once."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
