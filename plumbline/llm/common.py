"""Small helpers of this package: written steps, whole key groups in Arrow batches, files."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import work_path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove one of this package's own work tables from the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remembered(key: tuple, make: Callable):
    """``make()`` once per Python process and ``key``.

    This package travels to workers by value, so its own globals are new in every task; a module of
    the process itself outlives them.
    """
    held = vars(sys.modules.setdefault("_plumbline_worker", ModuleType("_plumbline_worker")))
    if key not in held:
        held[key] = make()
    return held[key]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Written:
    """A step written to the shared folder (``spark.checkpoint.dir``) and read back.

    The files survive lost executors and cut the lineage; ``delete`` removes them once a
    later step no longer needs them.
    """

    def __init__(self, df: DataFrame, label: str, compression: str = "snappy", partition: list[str] | None = None) -> None:
        self.spark = df.sparkSession
        self.path = work_path(self.spark, label)
        df.write.parquet(self.path, compression=compression, partitionBy=partition)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def delete(self) -> None:
        delete_path(self.spark, self.path)


def draw(*keys) -> Column:
    """A number in [0, 1) from the hash of the keys, the same on any partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def smallest_draws(rows: DataFrame, group: str, key: str, most: int, sizes: dict) -> DataFrame:
    """Per ``group`` the ``most`` rows of smallest draw of ``key`` (unique within the group),
    with their place ``nth`` from 1.

    ``sizes`` has the rows per group, by which all but about twice as many rows go before
    they meet.
    """
    share = F.lit(1.0)
    for value, size in sizes.items():
        if size > 2 * most:
            share = F.when(F.col(group) == F.lit(value), 2.0 * most / size).otherwise(share)
    few = rows.withColumn("draw", draw(key)).where(F.col("draw") < share)
    order = Window.partitionBy(group).orderBy("draw", key)
    return few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for few but heavy rows that adaptive
    execution would put into one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that end between two keys; the input is sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        count = table.num_rows - cut
        rows = max(rows, 2 * count)  # a group longer than the target is not copied at every batch
    if held:
        yield pa.Table.from_batches(held)


def group_starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return first, np.diff(np.concatenate([first, [len(keys)]]))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of rows ``a`` and ``b`` in place; a class is labelled by its first row."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        label[:] = parent[label]


def files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path in the shared folder and the path within it; works alike
    on local, HDFS and object-store paths."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
