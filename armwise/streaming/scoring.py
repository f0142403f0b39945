"""Scoring of streams: the scorer keeps no state, so a streaming DataFrame takes the same plan as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from armwise.operators.scoring import score_arrow


def score_stream(stream: DataFrame, forest: list[dict], features: list[str], out: str = "scores") -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is asked for")
    return score_arrow(stream, forest, features, out)
