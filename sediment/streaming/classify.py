"""Extension: classify a stream of records by the shapes of a corpus that is at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.shapes import classify


def classify_stream(stream: DataFrame, content: str, owner: DataFrame, empty_class: str | None = None) -> DataFrame:
    """A stream with shape and class; a stateless join with the broadcast owner table, so no watermark is needed."""
    return classify(stream, content, owner, empty_class)
