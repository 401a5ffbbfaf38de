"""Sinks. Replacing a partition is one write: readers never see it missing, a re-run gives the same table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _spread(df: DataFrame, files: int | None) -> DataFrame:
    """A fixed number of files, or, without one, as many as the measured size asks for."""
    return df.repartition(files) if files else df.hint("rebalance")


def write_parquet(
    df: DataFrame, path: str, parts: Sequence[str] = (), files: int | None = None, mode: str = "overwrite"
) -> None:
    """Parquet, optionally partitioned. Partitioned writes are rebalanced on the partition columns."""
    if parts and not files:
        shaped = df.hint("rebalance", *[F.col(p) for p in parts])
    else:
        shaped = _spread(df, files)
    shaped.write.mode(mode).partitionBy(*parts).parquet(path)


def write_partition(df: DataFrame, path: str, spec: Mapping[str, object], files: int | None = None) -> str:
    """Overwrite the one partition ``k=v/...`` of a folder; the frame loses its own partition columns."""
    target = "/".join([path.rstrip("/"), *[f"{k}={v}" for k, v in spec.items()]])
    _spread(df.drop(*spec), files).write.mode("overwrite").parquet(target)
    return target


def write_orc(df: DataFrame, path: str, files: int | None = 10) -> None:
    _spread(df, files).write.mode("overwrite").orc(path)


def _partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def _insert(df: DataFrame, table: str) -> None:
    """Overwrite the partitions the frame has rows of, with the rows of a partition in few files."""
    parts = _partition_columns(df.sparkSession, table)
    shaped = df.hint("rebalance", *[F.col(p) for p in parts]) if parts else _spread(df, None)
    shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(table)


def replace_partition(df: DataFrame, table: str, part: Mapping[str, object]) -> None:
    """Replace one partition of a table by the frame, also by an empty one; others stay as they are."""
    insert_overwrite_partition(df, table, part)


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def insert_overwrite_partition(df: DataFrame, table: str, part: Mapping[str, object]) -> None:
    """SQL form with a static partition; the partition is emptied even when the frame is empty."""
    spark = df.sparkSession
    cols = [c for c in spark.table(table).columns if c not in part]

    def text(value: object) -> str:
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    spec = ", ".join(f"{_name(k)} = {text(v)}" for k, v in part.items())
    rows = _spread(df.select(*cols), None)
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({spec}) SELECT {', '.join(map(_name, cols))} FROM {{rows}}", rows=rows)


def insert_aligned(
    df: DataFrame, table: str, parts: Sequence[str] = ("pt_date",), path: str | None = None
) -> list[str]:
    """Insert by name into a table whose column order may differ; create it when absent.

    A write that lacks target columns is refused rather than filled with guesses. Returns the
    columns of the frame that the target lacks, which are not written.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        writer = df.hint("rebalance", *map(F.col, parts)).write.mode("overwrite").partitionBy(*parts)
        (writer.option("path", path) if path else writer).saveAsTable(table)
        return []
    target = spark.table(table).columns
    missing = [c for c in target if c not in df.columns]
    if missing:
        raise ValueError(f"{table} has columns the data lacks: {', '.join(missing)}")
    _insert(df.select(*target), table)
    return [c for c in df.columns if c not in target]


def publish_table(
    spark: SparkSession, source: str, table: str, parts: Sequence[str] = (), path: str | None = None
) -> None:
    """Parquet folder -> table."""
    writer = spark.read.option("mergeSchema", "true").parquet(source).write.mode("overwrite").partitionBy(*parts)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def repair_table(spark: SparkSession, table: str) -> None:
    """Register partitions that were written next to the catalog."""
    spark.sql(f"MSCK REPAIR TABLE {table}")


def list_partitions(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {table}")
