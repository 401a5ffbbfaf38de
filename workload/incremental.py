"""ST* queries."""

from pyspark.sql import functions as F

from creditloom.session import scratch_path
from creditloom.streaming.incremental import materialise_day, merge_latest, read_state, stream_latest
from workload.base import query
from workload.standins import app_log, ev


@query("st1_materialise_day", """
SELECT DISTINCT device_id, app_id, pt_date FROM app_all WHERE pt_date IN ('2024-03-10', '2024-03-11')""", ["app_all"])
def st1(spark, d):
    path = scratch_path(spark, "st1")
    log = app_log(spark, d)
    for day in ("2024-03-10", "2024-03-11", "2024-03-10"):
        materialise_day(log, day, path)
    return spark.read.parquet(path).withColumn("pt_date", F.col("pt_date").cast("string"))


_LATEST = """
SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""


def order():
    return [F.desc("ts"), F.desc("event_id")]


@query("st2_merge_latest", _LATEST)
def st2(spark, d):
    rows = ev(spark, d).select("user_id", "event_id", "value", "ts")
    early = F.to_date("ts") < F.lit("2024-01-15").cast("date")
    state = merge_latest(rows.where(early), rows.limit(0), ["user_id"], order())
    return merge_latest(state, rows.where(~early), ["user_id"], order()).drop("ts")


@query("st3_stream_latest", _LATEST)
def st3(spark, d):
    # Four files, a batch each; the events of all times are dealt over them, so most batches bring late ones.
    source = scratch_path(spark, "arrivals")
    rows = ev(spark, d).select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(4, F.pmod(F.xxhash64("event_id"), F.lit(64))).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    path, checkpoint = scratch_path(spark, "state"), scratch_path(spark, "stream")
    stream_latest(stream, ["user_id"], ["ts", "event_id"], path, checkpoint).awaitTermination()
    return read_state(spark, path, ["user_id"]).drop("ts")
