"""Joins with a side whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(side: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if it has at most `max_rows` rows, otherwise as it is.

    For thin rows (ids, hashes) of a frame that was written before, so that counting it is cheap. Without the
    hint the join shuffles; its result is the same.
    """
    return F.broadcast(side) if side.limit(max_rows + 1).count() <= max_rows else side
