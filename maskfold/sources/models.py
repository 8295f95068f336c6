"""Fitted models as versioned tables (SRC-18).

A model is a set of named tables and a few parameters.  ``save`` writes the tables to a folder of the next version
and its parameters last; a version counts only once the parameters' ``_SUCCESS`` is there, so readers never see half a model.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import path_kind


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> dict[int, str]:
        """Complete versions and their folders."""
        if path_kind(self.spark, self.path) != "folder":
            return {}
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = {}
        for s in fs.listStatus(where):
            name = s.getPath().getName()
            if name.startswith("v") and path_kind(self.spark, f"{self.path}/{name}/parameters/_SUCCESS") == "file":
                found[int(name[1:].split("-")[0])] = f"{self.path}/{name}"
        return found

    def save(self, tables: dict[str, DataFrame], partition_by: tuple[str, ...] = (), **parameters) -> int:
        version = 1 + max(self.versions(), default=0)
        folder = f"{self.path}/v{version:06d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.partitionBy(*partition_by).parquet(f"{folder}/{name}")
        row = [(version, json.dumps(parameters, sort_keys=True), sorted(tables))]
        self.spark.createDataFrame(row, "version int, parameters string, tables array<string>").coalesce(1).write.parquet(f"{folder}/parameters")
        return version

    def load(self, version: int | None = None) -> tuple[dict, dict[str, DataFrame]]:
        """(parameters, tables) of a version, by default the latest."""
        found = self.versions()
        version = max(found, default=None) if version is None else version
        if version not in found:
            raise FileNotFoundError(f"no version {version} of a model in {self.path}")
        row = self.spark.read.parquet(f"{found[version]}/parameters").first()
        return json.loads(row.parameters), {name: self.spark.read.parquet(f"{found[version]}/{name}") for name in row.tables}
