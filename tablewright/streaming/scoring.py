"""Cleaning and scoring on a stream: the same stateless transforms as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.cleaning import CleaningSpec, prepare
from tablewright.operators.scoring import Bundle, score


def clean_stream(stream: DataFrame, spec: CleaningSpec) -> DataFrame:
    """Row by row and without state, so any output mode and trigger will do."""
    return prepare(stream, spec)


def score_to_table(stream: DataFrame, bundle: Bundle, path: str, checkpoint: str) -> StreamingQuery:
    """Score arriving rows and append them as Parquet; the checkpoint makes restarts exactly-once."""
    return (
        score(stream, bundle).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
