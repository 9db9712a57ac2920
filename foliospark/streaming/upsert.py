"""Upserts as a stream with state: of each key the last version is known, and only changed articles come out.

The state of a key is two numbers, the order of its last version and a hash of its content; the store holds as many
rows as there are keys, however many versions came. A version is emitted if its order is higher than the
known one and its content differs; replayed and out-of-order versions come to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from foliospark.session import ship_package

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KNOWN = StructType([StructField("ord", LongType()), StructField("content", LongType())])


class _Changed(StatefulProcessor):
    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", _KNOWN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = None
        for row in rows:  # one row is held, however many versions a batch has; of equal orders the greater content
            if last is None or (row["__order"], row["__content"]) > (last["__order"], last["__content"]):
                last = row
        known = self.known.get()
        if last is None or (known is not None and last["__order"] <= known[0]):
            return
        self.known.update((last["__order"], last["__content"]))
        if known is None or known[1] != last["__content"]:
            yield Row(**{n: last[n] for n in self.names})

    def close(self) -> None:
        pass


def changed(stream: DataFrame, key: str = "file_id", order: str = "ord") -> DataFrame:
    """The versions of a stream that change what is known of their key, the last one of each key and batch. Rows without
    a key or order are left out. The content is all columns but the order."""
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    names = stream.columns
    content = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names if c != order])))
    rows = stream.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumns({"__order": F.col(order).cast("long"), "__content": content})

    def lasts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # the last version of each key goes on, so a hot key sends a row a batch and not all its rows
            seen = pd.DataFrame({"key": b.column(key).to_pandas(), "order": b.column("__order").to_pandas(), "content": b.column("__content").to_pandas()})
            at = seen.sort_values(["order", "content"]).drop_duplicates("key", keep="last").index
            yield b.take(pa.array(at.sort_values(), pa.int64()))

    rows = rows.mapInArrow(lasts, rows.schema)
    return rows.groupBy(key).transformWithState(_Changed(names), stream.schema, "append", "none")


def upsert_to(stream: DataFrame, write, checkpoint: str, key: str = "file_id", order: str = "ord", once: bool = True):
    """A query that gives each micro-batch of changed versions to write(batch, number)."""
    writer = changed(stream, key, order).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
