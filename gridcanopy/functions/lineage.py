"""Tables cut from their lineage: written to the folder that all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none: a folder of our own if driver and executors are one process, else one
    in the warehouse, which they share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if house.startswith("file:") and not spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("the warehouse is a folder of one machine; name a shared one in spark.checkpoint.dir")
        return f"{house}/scratch"
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _own_root[app]


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or f"{shared_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete_path(df.sparkSession, path)


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there, in any store that Spark opens."""
    p, store = _store(spark, path)
    store.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file in any store that Spark opens, over one that is there."""
    p, store = _store(spark, path)
    out = store.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file or of a folder of text files; None if there is none."""
    p, store = _store(spark, path)
    if not store.exists(p):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def ranked(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Add the place of each row, from 1, in an order of the whole table, which no task sees as a whole.

    Rows are sorted by ranges; a row's place is that in its range after the sizes of the ranges before, of which
    there is one a partition.  Rows that tie in the order have some order.
    """
    placed = materialize(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return placed.withColumn("_own", own).join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_at", "_own", "_before")
