"""A stored form for anything fitted: a folder with a version, parameters, and tables.

What was fitted is a set of named values: plain ones, tables, Spark ML pipelines, and other
fitted things, each in a folder of its own. The description is written last, so a folder that
has one is whole. A fitted class is a dataclass, or has ``state()`` (its values by name) and
``restored(values)``.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Mapping
from dataclasses import fields, is_dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
PACKAGE = __name__.split(".")[0]


def _described(value, path: str, mode: str) -> dict:
    """The description of a value; tables and models in it are written below ``path``."""
    if isinstance(value, DataFrame):
        value.write.mode(mode).parquet(path)
        return {"table": True}
    if isinstance(value, PipelineModel):
        writer = value.write()
        (writer.overwrite() if mode == "overwrite" else writer).save(path)
        return {"pipeline": True}
    if isinstance(value, Mapping):
        return {"map": {name: _described(v, f"{path}/{name}", mode) for name, v in value.items()}}
    if isinstance(value, (list, tuple)):
        return {"list": [_described(v, f"{path}/{i}", mode) for i, v in enumerate(value)]}
    if value is None or isinstance(value, (str, int, float, bool)):
        return {"value": value}
    kind = type(value)
    values = value.state() if hasattr(value, "state") else {f.name: getattr(value, f.name) for f in fields(value)}
    return {"fitted": f"{kind.__module__}:{kind.__qualname__}", "values": {n: _described(v, f"{path}/{n}", mode) for n, v in values.items()}}


def _rebuilt(spark: SparkSession, what: dict, path: str):
    if "table" in what:
        return spark.read.parquet(path)
    if "pipeline" in what:
        return PipelineModel.load(path)
    if "map" in what:
        return {name: _rebuilt(spark, v, f"{path}/{name}") for name, v in what["map"].items()}
    if "list" in what:
        return [_rebuilt(spark, v, f"{path}/{i}") for i, v in enumerate(what["list"])]
    if "value" in what:
        return what["value"]
    module, name = what["fitted"].split(":")
    if module.split(".")[0] != PACKAGE:
        raise ValueError(f"{module} is not part of {PACKAGE}")
    kind = getattr(importlib.import_module(module), name)
    values = {n: _rebuilt(spark, v, f"{path}/{n}") for n, v in what["values"].items()}
    return kind(**values) if is_dataclass(kind) else kind.restored(values)


def save_fitted(spark: SparkSession, fitted, path: str, overwrite: bool = False) -> None:
    """Write a cleaner, lumper, scaler, neighbour index, classifier or set of models."""
    mode = "overwrite" if overwrite else "error"
    what = {"format": FORMAT, "what": _described(fitted, f"{path}/parts", mode)}
    spark.createDataFrame([(json.dumps(what),)], "description string").coalesce(1).write.mode(mode).text(f"{path}/description")


def load_fitted(spark: SparkSession, path: str):
    """What ``save_fitted`` has written; its tables are read from ``path`` whenever it is used."""
    rows = spark.read.text(f"{path}/description").where(F.col("value") != "").collect()
    what = json.loads(rows[0][0])
    if what["format"] > FORMAT:
        raise ValueError(f"{path} has format {what['format']}, this version reads up to {FORMAT}")
    return _rebuilt(spark, what["what"], f"{path}/parts")
