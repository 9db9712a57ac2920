"""Streaming forms: resumable crawls and last-write-wins article stores."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from foliospark.operators.ids import latest
from foliospark.session import ship_package
from foliospark.streaming.upsert import STORE


_SEEN = StructType([StructField("seen", BooleanType())])


class _First(StatefulProcessor):
    """Lets the first record of a key out; the state of a key is that it was seen."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        row, known = next(iter(rows), None), self.seen.exists()
        if row is not None and not known:
            self.seen.update((True,))
            yield Row(**{n: row[n] for n in self.names})

    def close(self) -> None:
        pass


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str, once: bool = True, rows_a_file: int = 0) -> StreamingQuery:
    """Writes records whose key isn't in the table at path yet, one of each key, in files of at most rows_a_file if that isn't
    0. Keys of the table go into the stream's state when it first starts, and from then on the state knows them, so the
    table isn't read for each micro-batch. A batch that is replayed after a failure can only be the first one of a start;
    that one is compared with the table once more. Rows without a key are left out."""
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def table() -> DataFrame | None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        return spark.read.schema(stream.schema).parquet(path).select(key) if there else None

    keys = table()
    known = None if keys is None else keys.where(F.col(key).isNotNull()).distinct().groupBy(key)
    rows = stream.where(F.col(key).isNotNull())
    fresh = rows.groupBy(key).transformWithState(_First(stream.columns), stream.schema, "append", "none", initialState=known)
    first = [True]

    def write(batch: DataFrame, _: int) -> None:
        there = table() if first[0] else None
        first[0] = False
        if there is not None:
            batch = batch.join(there, key, "left_anti").select(*batch.columns)
        batch.write.mode("append").option("maxRecordsPerFile", rows_a_file).parquet(path)

    writer = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_versions(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends every record with its order; current() gives the last of each key."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(table: DataFrame, key: str, order: str = "ord") -> DataFrame:
    return latest(table, key, F.col(order))
