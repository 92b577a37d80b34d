"""Fitted pipelines on disk, reused only while the data they were fitted on is unchanged."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from wattframe.sources.store import signature, write_table


@dataclass(frozen=True)
class StoredModel:
    model: PipelineModel
    reused: bool


def _stamp(data_signature: str, params: dict[str, Any]) -> tuple[str, str]:
    return data_signature, json.dumps(params, sort_keys=True)


def fit_or_load(
    spark: SparkSession,
    path: str,
    data: DataFrame,
    params: dict[str, Any],
    fit: Callable[[DataFrame], PipelineModel],
) -> StoredModel:
    """Load the model when its stamp matches the data and parameters; otherwise, or if unreadable, fit again.

    The stamp is written last: a job that dies while saving leaves a model that is fitted again.
    """
    stamp = _stamp(signature(data), params)
    try:
        stored = spark.read.parquet(f"{path}/stamp").first()
        if stored is not None and (stored["signature"], stored["params"]) == stamp:
            return StoredModel(PipelineModel.load(f"{path}/model"), True)
    except (PySparkException, Py4JJavaError, ValueError):
        pass
    model = fit(data)
    write_table(spark.createDataFrame([("", "")], "signature string, params string"), f"{path}/stamp")
    model.write().overwrite().save(f"{path}/model")
    write_table(spark.createDataFrame([stamp], "signature string, params string"), f"{path}/stamp")
    return StoredModel(model, False)
