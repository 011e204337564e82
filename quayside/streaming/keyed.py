"""Streams whose state is kept per key, in a store on the executors.

The store is RocksDB with a change log: a batch reads and writes the state of
the keys it has rows or timers for, and what is checkpointed follows the batch,
not the number of keys. Old versions are removed by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def start(stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start appending ``stream`` to the table at ``out``; without a trigger it takes what has arrived and stops.

    A running stream has a session of its own, so the store is asked for only
    while it starts, and the caller's settings stay as they are.
    """
    conf = stream.sparkSession.conf
    before = {key: conf.get(key, None) for key in _STORE}
    for key, value in _STORE.items():
        conf.set(key, value)
    try:
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", out)
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def run_keyed(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Take everything that has arrived, then stop; call again to go on. The rows emitted so far."""
    start(stream, out, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
