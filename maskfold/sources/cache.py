"""Incremental caches of transformed rows (SRC-12, SRC-13): resumed after a crash, stopped once enough rows are there.

Rows belong to batches by their id (``id // batch_rows``), which are done in waves of 1, 2, 4, ... batches, one Spark
job each.  A wave first writes its rows to a folder of its own and then one row to the ledger (batch numbers, rows,
inliers, folder) as a folder whose ``_SUCCESS`` appears last.  Readers see only folders that the ledger names, so a
crash before the ledger's row loses nothing but that wave's work, and no row is there twice.  Rows that
arrive later in a finished batch are found by the batch's row count and added by an anti-join on the id.

One writer at a time; the folder lies where the caller says, on the cluster's shared storage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_kind

LEDGER = "wave long, folder string, batches array<long>, n_rows long, n_inliers long"


class RowCache:
    """``transform`` maps source rows (with ``key``) to as many cached rows (with ``key``); ``inlier`` is a condition on
    cached rows.  Rows without a key aren't cached."""

    def __init__(self, spark: SparkSession, path: str, key: str, transform: Callable[[DataFrame], DataFrame],
                 inlier: Column | None = None, batch_rows: int = 10_000):
        self.spark, self.path, self.key, self.transform = spark, path.rstrip("/"), key, transform
        self.inlier, self.batch_rows = F.lit(True) if inlier is None else inlier, batch_rows

    def ledger(self) -> list:
        """The committed waves; a few numbers each."""
        found = []
        if path_kind(self.spark, f"{self.path}/ledger") == "folder":
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
            fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for s in fs.listStatus(where):
                folder = s.getPath().toString()
                if path_kind(self.spark, f"{folder}/_SUCCESS") == "file":
                    found.append(folder)
        return sorted(self.spark.read.schema(LEDGER).parquet(*found).collect(), key=lambda r: r.wave) if found else []

    def stored(self) -> DataFrame | None:
        """The cached rows, or None before the first wave."""
        folders = [r.folder for r in self.ledger()]
        return self.spark.read.parquet(*folders) if folders else None

    def batch(self) -> Column:
        return F.floor(F.col(self.key) / self.batch_rows)

    def commit(self, wave: int, folder: str, batches: list[int], n_rows: int, n_inliers: int) -> None:
        row = self.spark.createDataFrame([(wave, folder, batches, n_rows, n_inliers)], LEDGER)
        row.coalesce(1).write.parquet(f"{self.path}/ledger/wave-{wave:06d}-{uuid.uuid4().hex[:8]}")

    def write(self, rows: DataFrame, batches: list[int], wave: int):
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        self.transform(rows).write.parquet(folder)
        done = self.spark.read.parquet(folder).agg(F.count("*"), F.sum(F.when(self.inlier, 1).otherwise(0))).first()
        self.commit(wave, folder, batches, done[0], done[1] or 0)
        return done[1] or 0

    def fill(self, source: DataFrame, wanted: int | None = None) -> DataFrame:
        """Cache rows of ``source`` until ``wanted`` inliers are stored (None: all rows); the cached rows, of which
        with ``wanted`` the inliers with the smallest ids."""
        ledger = self.ledger()
        have, wave = sum(r.n_inliers for r in ledger), 1 + max((r.wave for r in ledger), default=-1)
        # one row a batch reaches the driver
        there = {r.batch: r.n for r in source.groupBy(self.batch().alias("batch")).agg(F.count("*").alias("n")).collect()}
        finished = {b for r in ledger for b in r.batches}
        if finished:
            # batches that got more rows since
            kept = self.stored()
            known = {r.batch: r.n for r in kept.groupBy(self.batch().alias("batch")).agg(F.count("*").alias("n")).collect()}
            grown = sorted(b for b in finished if there.get(b, 0) > known.get(b, 0))
            if grown:
                new = source.where(self.batch().isin(grown)).join(kept.select(self.key), self.key, "left_anti")
                have += self.write(new, grown, wave)
                wave += 1
        left, size = sorted(b for b in there if b is not None and b not in finished), 1
        while left and (wanted is None or have < wanted):
            now, left = left[:size], left[size:]
            if wanted is None:
                now, left = now + left, []  # no stop to watch for: one job
            rows = source.where(self.batch().between(now[0], now[-1]) & ~self.batch().isin([b for b in finished if now[0] <= b <= now[-1]]))
            have += self.write(rows, now, wave)
            wave, size = wave + 1, 2 * size
        rows = self.stored()
        if rows is None:
            return self.transform(source.limit(0))
        return rows if wanted is None else rows.where(self.inlier).orderBy(self.key).limit(wanted)
