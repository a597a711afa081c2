"""Lineage cuts in a folder that all executors share.

A job that loses executors must not lose its intermediate results, so they are
written as Parquet tables under ``spark.checkpoint.dir``.  That setting belongs
to the cluster; a folder of our own is used only where it is unset, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application for intermediate tables; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
            base = "file://" + tempfile.mkdtemp(prefix="quill-")
            spark.sparkContext.setCheckpointDir(base)
        path = f"{base.rstrip('/')}/quill-{app}-{uuid.uuid4().hex[:8]}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop)
        fs.deleteOnExit(hadoop)
        _own[app] = path
    return _own[app]


def table_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Unlike a cached plan this survives lost executors, and unlike
    ``checkpoint()`` the columns stay compressed and prunable.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = path
    weakref.finalize(table, _paths.pop, id(table), None)
    return table


_paths: dict[int, str] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` returned and that nothing will read again."""
    for table in tables:
        path = _paths.pop(id(table), None)
        if path:
            drop_table(table.sparkSession, path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table written below the shared folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, sorted; none if it doesn't exist."""
    fs, path = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def ranges_in(spark: SparkSession, folder: str, column: str) -> list[tuple[str, int, int]]:
    """(path, least, greatest) of an integer column without NULLs in each Parquet file of a folder, from the files' footers; empty files are left out."""
    fs, path = _at(spark, folder)
    parquet, conf = spark._jvm.org.apache.parquet.hadoop, spark._jsc.hadoopConfiguration()
    found = []
    for status in fs.listStatus(path):
        if not status.getPath().getName().endswith(".parquet"):
            continue
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromStatus(status, conf))
        try:
            columns = [c for block in reader.getFooter().getBlocks() for c in block.getColumns() if c.getPath().toDotString() == column]
            bounds = [(c.getStatistics().genericGetMin(), c.getStatistics().genericGetMax()) for c in columns]
        finally:
            reader.close()
        if bounds:
            found.append((status.getPath().toString(), min(low for low, _ in bounds), max(high for _, high in bounds)))
    return sorted(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is there as a whole or not at all."""
    fs, target = _at(spark, path)
    _, part = _at(spark, f"{path}.part-{uuid.uuid4().hex[:8]}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(part, target)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value
