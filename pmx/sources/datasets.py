"""Sinks and the registry of derived datasets."""

from __future__ import annotations

import graphlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int = 0) -> int:
    """Write Parquet, replacing what was there; the rows written are counted in the same pass."""
    seen = Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return int(seen.get["rows"])


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table has not, once each; returns how many."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns)
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return int(seen.get["rows"])


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _path(spark, path)
    return store.exists(p)


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """The row of each key with the largest ``by``."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), by).alias("_r")).select("_r.*")


def in_batches(df: DataFrame | list[DataFrame], keys: list[str], work: Callable[[DataFrame], DataFrame], path: str, batches: int = 16) -> DataFrame:
    """The results of ``work`` over ``df``, done and kept a batch at a time under ``path``, so that work cut short goes on where it stopped.

    For work that is dear a row (calls to a service). A batch is the share of rows of one hash; its folder counts once Spark has marked it complete, so what
    a lost driver or executor left half written is done again. Rows whose keys are in a complete batch are not worked on a second time; later
    rows make batches of their own. ``work`` keeps the keys; ``path`` is in a store that all share. Each ``df`` of a list is a batch, so rows that are dear to make are made once and not kept.
    """
    parts = df if isinstance(df, list) else None
    spark = parts[0].sparkSession if parts else df.sparkSession

    def complete() -> list[str]:
        root, store = _path(spark, path)
        found = [x.getPath() for run in store.listStatus(root) for x in store.listStatus(run.getPath())] if store.exists(root) else []
        return sorted(f.toString() for f in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    ready = complete()
    known = spark.read.parquet(*ready).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct() if ready else None

    def new(df: DataFrame) -> DataFrame:
        if known is None:
            return df
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & df[k].eqNullSafe(known[f"_k{i}"])
        return df.join(known, same, "left_anti")

    run = 1 + max((int(f.split("/")[-2].removeprefix("run-")) for f in ready), default=0)
    if parts:
        todo = list(enumerate(new(x) for x in parts))
    else:
        rest, share = new(df), F.pmod(F.xxhash64(*keys), F.lit(batches))
        todo = [(r[0], rest.filter(share == r[0])) for r in rest.select(share.alias("b")).distinct().orderBy("b").collect()]  # ``batches`` numbers at most
    for b, part in todo:
        work(part).write.mode("overwrite").parquet(f"{path}/run-{run}/batch-{b:06d}")
    ready = complete()
    return spark.read.parquet(*ready) if ready else work(parts[0] if parts else df)


@dataclass
class Dataset:
    """A derived dataset: how to make it from others."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: list[str] = field(default_factory=list)


class Runner:
    """Makes datasets in order of their needs under one folder; one with a manifest is not made again unless forced."""

    def __init__(self, spark: SparkSession, folder: str, datasets: list[Dataset]):
        self.spark, self.folder, self.all = spark, folder.rstrip("/"), {x.name: x for x in datasets}

    def order(self, names: list[str] | None = None) -> list[str]:
        graph, todo = {}, list(names or self.all)
        while todo:
            n = todo.pop()
            if n not in graph:
                graph[n] = self.all[n].needs
                todo += graph[n]
        return list(graphlib.TopologicalSorter(graph).static_order())

    def manifest(self, name: str) -> dict | None:
        path = f"{self.folder}/{name}.manifest"
        if not exists(self.spark, path):
            return None
        return json.loads(self.spark.read.text(path, wholetext=True).first()["value"])

    def run(self, names: list[str] | None = None, force: bool = False) -> dict[str, int]:
        rows = {}
        for name in self.order(names):
            path, done = f"{self.folder}/{name}", self.manifest(name)
            if done and not force:
                rows[name] = done["rows"]
                continue
            inputs = {n: self.spark.read.parquet(f"{self.folder}/{n}") for n in self.all[name].needs}
            rows[name] = write_table(self.all[name].make(self.spark, inputs), path)
            self.spark.createDataFrame([(json.dumps({"name": name, "rows": rows[name]}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
        return rows
