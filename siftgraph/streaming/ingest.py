"""Incremental work as Structured Streaming: exports and signals that arrive in folders.

Each run takes what is new (Trigger.AvailableNow) and ends; the checkpoint remembers what was taken. A batch writes
under its number, and readers drop batches that a retry wrote twice.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgraph.operators import edges as edge_ops
from siftgraph.operators.windows import top_n
from siftgraph.sources import exports


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_exports(spark: SparkSession, landing: str, out: str, checkpoint: str) -> None:
    """New XML files of a folder become rows of out/files, out/elements, out/blocks and out/edges. A batch that is run again overwrites itself."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{dxl,xml,DXL,XML}").load(landing)

    def each(batch: DataFrame, n: int) -> None:
        texts = batch.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content").mapInArrow(exports._decoded, "source_file string, text string")
        exports.parsed(texts).write.mode("overwrite").parquet(f"{out}/files/batch={n}")
        parsed = spark.read.parquet(f"{out}/files/batch={n}")
        for name, df in (("elements", exports.elements(parsed)), ("blocks", exports.blocks(parsed)), ("edges", edge_ops.from_exports(parsed))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={n}")

    run_available(files, each, checkpoint)


def append_signals(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends a stream of signals to a table, exactly once (the file sink keeps a log of its files)."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_signals(signals: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    """What a bounded buffer of n signals per key holds now."""
    return top_n(signals, keys, n, *(F.desc(c) for c in order))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _buffer(schema: T.StructType, order: list[str], most: int, ttl_ms: int | None):  # noqa: ANN202
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    names = schema.names
    rank = [names.index(c) for c in order]

    class Buffer(StatefulProcessor):
        """The newest rows of a key, as a list in the state store."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getListState("kept", schema, ttl_ms)

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
            newest = lambda r: tuple((r[k] is not None, r[k] if r[k] is not None else 0) for k in rank)
            before = list(self.kept.get()) if self.kept.exists() else []
            both = heapq.nlargest(most, (r for part in (before, (tuple(row[c] for c in names) for row in rows)) for r in part), newest)  # holds no more than most
            self.kept.put(both)
            for r in both:
                yield Row(**dict(zip(names, r, strict=True)))

        def close(self) -> None:
            pass

    return Buffer()


def buffer_signals(stream: DataFrame, keys: list[str], order: list[str], out: str, checkpoint: str, most: int = 500, ttl_ms: int | None = None) -> None:
    """Keeps the newest most signals of each key in the state of a stream, and writes the buffers that a batch changed as that batch's partition of out.

    Order is by columns, ties by later ones, so that what is kept doesn't depend on how signals were dealt to batches; nulls are oldest. A batch that is run again
    begins with the state before it and overwrites what it wrote. With ttl_ms, signals expire that long after they were last kept. A key's signals of one batch
    are passed over in one task, which holds most of them at a time.
    """
    spark, schema = stream.sparkSession, T.StructType(list(stream.schema.fields))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        kept = stream.groupBy(*keys).transformWithState(_buffer(schema, order, most, ttl_ms), schema, "Update", "ProcessingTime" if ttl_ms else "None")
        kept.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def buffered(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The signals that the buffers hold now: of each key what the last batch that changed it wrote."""
    rows = spark.read.parquet(out)
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"], "left_semi").drop("batch")


def windowed_counts(stream: DataFrame, at: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts per time window and key; rows later than the watermark are left out of a stream."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
