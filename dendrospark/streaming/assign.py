from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.centers import predict


def predict_stream(points: DataFrame, centers: DataFrame, ks: list[int], dim: int) -> DataFrame:
    """D6/D7 on a streaming ``(id, features)`` DataFrame against static
    centers ``(k, center, centroid)``.  ``ks`` and ``dim`` are given because a
    stream cannot be inspected up front; the centers table is bounded by K
    and size-checked by ``predict`` before it is broadcast."""
    if not points.isStreaming:
        raise ValueError("predict_stream expects a streaming DataFrame; use predict for batch")
    return predict(points, centers, ks=ks, dim=dim)
