"""Session helpers: lineage cuts, shared scratch folder, order-stable group numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    Read from ``spark.checkpoint.dir``; only where that is unset a temporary folder is made and set for the rest
    of the session, in local mode. On a cluster no machine's own folder would do, so an unset one raises.
    """
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} has to name a folder all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set(_KEY, found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder as parquet and read it back.

    Cuts lineage like ``checkpoint()``, survives the loss of executors, is compressed and keeps
    column pruning. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_groups(files: list[str], most: int) -> Iterator[pa.Table]:
    """For Python workers: the rows of a materialised table's files, in tables of at most ``most`` rows."""
    import pyarrow.dataset as ds

    held, n = [], 0
    for f in files:
        fs, path = pa.fs.FileSystem.from_uri(f)
        for b in ds.dataset(path, filesystem=fs, format="parquet").to_batches():
            while len(b):
                part = b.slice(0, most - n)
                held, n, b = [*held, part], n + len(part), b.slice(len(part))
                if n == most:
                    full, held, n = [pa.Table.from_batches(held)], [], 0
                    yield full.pop()  # not kept here while it is worked on
    if held:
        yield pa.Table.from_batches(held)


def row_counts(files: list[str]) -> list[int]:
    """Rows of each of a materialised table's files, from their footers."""
    import pyarrow.parquet as pq

    counts = []
    for f in files:
        fs, path = pa.fs.FileSystem.from_uri(f)
        counts.append(pq.ParquetFile(path, filesystem=fs).metadata.num_rows)
    return counts


def rows_between(files: list[str], counts: list[int], start: int, stop: int) -> Iterator[pa.RecordBatch]:
    """For Python workers: rows ``start`` to ``stop`` of a materialised table, in the order of its files."""
    import pyarrow.dataset as ds

    at = 0
    for f, n in zip(files, counts):
        if at < stop and at + n > start:
            fs, path = pa.fs.FileSystem.from_uri(f)
            i = at
            for b in ds.dataset(path, filesystem=fs, format="parquet").to_batches():
                low, high = max(start - i, 0), min(stop - i, len(b))
                if low < high:
                    yield b.slice(low, high - low)
                i += len(b)
        at += n


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan; exact for materialised tables up to compression."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_below(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only where the estimated size is under ``limit`` bytes; beyond it the planner chooses."""
    return F.broadcast(df) if size_in_bytes(df) < limit else df


def running_total(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of the group up to and including this one in ``order``.

    Same result as a window over the whole group, but no group has to fit into one task: rows are
    range-partitioned by group and order, summed inside each partition, and shifted by the totals of the
    earlier partitions (one row per group and partition). ``order`` has to be total within the group.
    Adds nothing else; an empty input gives an empty output.
    """
    cols = df.columns
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(
        df.withColumn("_v", value)
        .repartitionByRange(n, *group, *order)
        .withColumn("_p", F.spark_partition_id())
    )
    inner = W.partitionBy(*group, "_p")
    local = cut.withColumn("_r", F.sum("_v").over(inner.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    part = cut.groupBy(*group, "_p").agg(F.sum("_v").alias("_t"))
    before = part.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_p").alias("_q"),
        F.coalesce(F.sum("_t").over(W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"),
    )
    on = F.col("_p") == F.col("_q")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(before, on).select(*cols, (F.col("_r") + F.col("_b")).alias(out))


def latest(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``by`` (nulls lowest), whole row kept. Null keys are dropped."""
    rest = [c for c in df.columns if c != key]
    rank = F.struct(*[F.col(c) for c in by])
    one = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_x"))
    return one.select(*[F.col(key) if c == key else F.col("_x")[c].alias(c) for c in df.columns])


def latest_lean(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``latest``, but only keys are shuffled, and whole rows of the keys that were delivered more than once."""
    df = df.filter(F.col(key).isNotNull())
    again = materialise(df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key))
    again = broadcast_below(again, 8 << 20)
    return df.join(again, key, "left_anti").select(*df.columns).unionByName(latest(df.join(again, key, "left_semi").select(*df.columns), key, by))
