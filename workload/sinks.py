"""IO10-IO16 queries: each writes, then returns what a reader finds."""

import uuid

from pyspark.sql import functions as F

from creditloom.session import scratch_path
from creditloom.sources.sinks import (
    drop_table,
    insert_aligned,
    insert_overwrite_partition,
    list_partitions,
    publish_table,
    repair_table,
    replace_partition,
    write_orc,
    write_parquet,
    write_partition,
)
from workload.base import query
from workload.standins import ev

_DAYS = "SELECT event_id, value, strftime(ts, '%Y-%m-%d') AS pt_date FROM events"


def days(spark, d):
    """Events by day, as a table with a date partition."""
    return ev(spark, d).select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("pt_date"))


def back(df):
    return df.select("event_id", "value", F.col("pt_date").cast("string").alias("pt_date"))


def new_table(spark, rows):
    """A partitioned table under a fresh name, stored below the shared folder."""
    name = f"t_{uuid.uuid4().hex[:12]}"
    rows.write.partitionBy("pt_date").option("path", scratch_path(spark, name)).saveAsTable(name)
    return name


@query("io10_write_parquet", _DAYS)
def io10(spark, d):
    path = scratch_path(spark, "io10")
    write_parquet(days(spark, d), path, ["pt_date"])
    return back(spark.read.parquet(path))


@query("io10_write_parquet_files", "SELECT 6 AS files, count(*) AS n FROM events")
def io10_files(spark, d):
    path = scratch_path(spark, "io10")
    write_parquet(days(spark, d), path, files=6)
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).agg(
        F.countDistinct("f").cast("int").alias("files"), F.count(F.lit(1)).alias("n")
    )


@query("io11_write_partition", f"""
SELECT event_id, CASE WHEN pt_date = '2024-01-05' THEN -value ELSE value END AS value, pt_date FROM ({_DAYS})""")
def io11(spark, d):
    path = scratch_path(spark, "io11")
    rows = days(spark, d)
    write_parquet(rows, path, ["pt_date"])
    new = rows.where(F.col("pt_date") == "2024-01-05").withColumn("value", -F.col("value"))
    write_partition(new, path, {"pt_date": "2024-01-05"}, 2)
    write_partition(new, path, {"pt_date": "2024-01-05"}, 2)
    return back(spark.read.parquet(path))


@query("io12_replace_partition", f"""
SELECT event_id, CASE WHEN pt_date = '2024-01-06' THEN 0.5::DOUBLE ELSE value END AS value, pt_date FROM ({_DAYS})""")
def io12(spark, d):
    rows = days(spark, d)
    name = new_table(spark, rows)
    new = rows.where(F.col("pt_date") == "2024-01-06").select("event_id", F.lit(0.5).alias("value"))
    replace_partition(new, name, {"pt_date": "2024-01-06"})
    return back(spark.table(name))


@query("io13_insert_aligned", f"""
SELECT event_id, CASE WHEN pt_date >= '2024-01-20' THEN value * 2 ELSE value END AS value, pt_date FROM ({_DAYS})""")
def io13(spark, d):
    """The first insert creates the table; the second has other column order and one column more."""
    name = f"t_{uuid.uuid4().hex[:12]}"
    rows = days(spark, d)
    insert_aligned(rows, name, ["pt_date"], scratch_path(spark, name))
    late = rows.where(F.col("pt_date") >= "2024-01-20")
    insert_aligned(late.select("pt_date", F.lit(1).alias("extra"), (F.col("value") * 2).alias("value"), "event_id"), name)
    return back(spark.table(name))


@query("io14_write_orc", _DAYS)
def io14(spark, d):
    path = scratch_path(spark, "io14")
    write_orc(days(spark, d), path, 10)
    return back(spark.read.orc(path))


@query("io15_insert_overwrite_partition", f"SELECT * FROM ({_DAYS}) WHERE pt_date <> '2024-01-07' OR value > 10")
def io15(spark, d):
    rows = days(spark, d)
    name = new_table(spark, rows)
    kept = rows.where((F.col("pt_date") == "2024-01-07") & (F.col("value") > 10))
    insert_overwrite_partition(kept, name, {"pt_date": "2024-01-07"})
    return back(spark.table(name))


@query("io16_publish_table", f"SELECT count(*) AS n, count(DISTINCT pt_date) AS partitions FROM ({_DAYS})")
def io16(spark, d):
    """Folder -> table, one day added next to the catalog and repaired in, partitions listed."""
    source, name = scratch_path(spark, "io16"), f"t_{uuid.uuid4().hex[:12]}"
    rows = days(spark, d)
    write_parquet(rows.where(F.col("pt_date") != "2024-01-09"), source, ["pt_date"])
    path = scratch_path(spark, name)
    publish_table(spark, source, name, ["pt_date"], path)
    write_partition(rows.where(F.col("pt_date") == "2024-01-09"), path, {"pt_date": "2024-01-09"})
    repair_table(spark, name)
    listed = list_partitions(spark, name).agg(F.count(F.lit(1)).alias("partitions"))
    counted = spark.table(name).agg(F.count(F.lit(1)).alias("n"))
    out = counted.crossJoin(F.broadcast(listed))
    drop_table(spark, f"gone_{name}")
    return out
