"""Scoring of arriving records: broken ones go to a quarantine table with the rule they break."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattframe.operators.validation import InputCheck


def score_stream(
    arriving: DataFrame,
    check: InputCheck,
    score: Callable[[DataFrame], DataFrame],
    good_path: str,
    bad_path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Writes each micro-batch to both tables under its batch number.

    A batch that is run again after a failure replaces its own files, so each record lands exactly once. No
    state is kept between batches. Nothing of a batch is kept for its two writes either: its checked records would
    take far more room than its files, in blocks that grow with it. Both writes read and check the batch, which a
    stream can always read again.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        checked = check.check(batch)
        score(check.good(checked)).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        broken = check.forget_numbers(checked.where(F.col("error").isNotNull()))
        broken.write.mode("overwrite").parquet(f"{bad_path}/batch={number}")

    writer = arriving.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
