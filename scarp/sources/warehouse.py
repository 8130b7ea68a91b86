"""The few tables worth materialising between steps: positions, features, labels, predictions.

They are written once per application below the shared folder (``spark.checkpoint.dir``) and read back column by
column, so lineage stays short, a lost executor costs nothing upstream, and later steps prune what they do not need.
"""
from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scarp.session import shared_dir

_DONE: dict[tuple[str, str, str], str] = {}


class Warehouse:
    def __init__(self, spark: SparkSession, source: str):
        self.spark, self.source = spark, source

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        app = self.spark.sparkContext.applicationId
        key = (app, self.source, name)
        if key not in _DONE:
            tag = hashlib.md5(self.source.encode()).hexdigest()[:8]
            path = os.path.join(shared_dir(self.spark), f"tables-{app}-{tag}", name)
            build().write.mode("overwrite").parquet(path)
            _DONE[key] = path
        return self.spark.read.parquet(_DONE[key])
