"""Daily and streaming forms that avoid reading the whole look-back again.

Every step is idempotent: a day or a micro-batch that is repeated after a failure gives the same
files and the same state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType, TimestampType

from creditloom.operators.windows import first_per_key
from creditloom.plans.apps import app_entries, parse_messages
from creditloom.sources.sinks import write_partition

#: A store that keeps state by key outside the heap, and logs what a batch changes.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def materialise_day(log: DataFrame, day: str, path: str) -> str:
    """Parse one day of the message log once and keep its distinct app entries as a partition."""
    entries = app_entries(parse_messages(log.where(F.col("pt_date") == day))).distinct()
    return write_partition(entries, path, {"pt_date": day})


def merge_latest(state: DataFrame, today: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest record per key from yesterday's state and today's rows."""
    return first_per_key(state.unionByName(today), keys, order)


def keep_latest(stream: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Each micro-batch's changes to the latest record per key of an event stream.

    The latest record has the greatest ``newest`` columns, compared in turn, a missing value being
    the smallest. It is kept per key in the state store: a batch reads and writes the keys it brings
    and no others, and a key comes out only when its latest record has changed. Late and repeated events
    need no watermark, because the order decides whatever the time of arrival. Rows whose key is
    missing are one key.
    """
    # Instants travel as microseconds, so that rows and state compare whatever a worker's time zone.
    instants = _instants(stream.schema)
    stream = stream.withColumns({c: F.unix_micros(c) for c in instants})
    schema, names = stream.schema, stream.columns
    at = [names.index(c) for c in newest]

    def age(row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) if row[i] is not None else (False,) for i in at)

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.latest = handle.getValueState("latest", schema)

        def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
            held = self.latest.get() if self.latest.exists() else None
            best = held
            for row in rows:
                row = tuple(row[c] for c in names)
                if best is None or age(row) > age(best):
                    best = row
            if best is not held:
                self.latest.update(best)
                yield Row(**dict(zip(names, best, strict=True)))

        def close(self) -> None:
            pass

    changed = stream.groupBy(*keys).transformWithState(Latest(), schema, "update", "none")
    return changed.withColumns({c: F.timestamp_micros(c) for c in instants})


def _instants(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, TimestampType)]


def stream_latest(
    stream: DataFrame, keys: Sequence[str], newest: Sequence[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Keep the latest record per key of an event stream: the changes of each batch go to ``path``.

    A batch's changes are a folder named after its batch id, so a repeated batch overwrites its own.
    The state store logs a batch's changes only; its older versions are removed by the store itself.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:  # a query takes the settings it was started with
        return (
            keep_latest(stream, keys, newest).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def read_state(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Latest record per key: the last of its changes."""
    return first_per_key(spark.read.parquet(path), keys, [F.desc("version")]).drop("version")


def stored_state(spark: SparkSession, checkpoint: str, schema: StructType) -> DataFrame:
    """The same from the state store's last version, for a stream of this schema that has stopped."""
    stored = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint).select("value.*")
    return stored.withColumns({c: F.timestamp_micros(c) for c in _instants(schema)})
