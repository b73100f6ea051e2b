"""Event reduction as a Structured Streaming job.

The reducers (``event_reduce``, the view / interaction split, privacy flags)
are pure ``DataFrame -> DataFrame`` functions, so the same code runs on a
file stream.  Each micro-batch is written with ``foreachBatch`` into a folder
named by its batch id, overwritten on replay, so a restarted query (after a
lost driver or executor) re-creates exactly the same files: the checkpoint
decides which batch ids are re-run, the sink is idempotent per id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from insight.operators.events import event_counts, event_reduce, split_interactions, split_views
from insight.sources.files import TS_FORMATS


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw events arriving as files (JSON lines, gz or plain, or parquet)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "json":
        reader = reader.options(**TS_FORMATS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def _write_batch(out: str, fmt: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        reduced = event_reduce(batch)  # a narrow projection: cheaper to redo than to keep
        for name, part in (("views", split_views(reduced)), ("interactions", split_interactions(reduced))):
            part.write.mode("overwrite").format(fmt).option("header", True).save(f"{out}/{name}/batch={batch_id}")
    return write


def start_reduction(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet",
                    available_now: bool = True, name: str | None = None) -> StreamingQuery:
    """Reduce every micro-batch and write its views and interactions."""
    writer = stream.writeStream.foreachBatch(_write_batch(out, fmt)).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def start_event_counter(stream: DataFrame, checkpoint: str, out: str,
                        available_now: bool = True) -> StreamingQuery:
    """Running count per event name (absent name -> ``no-event``), kept as
    streaming state.  Every micro-batch writes all counts to the folder of its
    batch id below ``out`` (overwritten on replay); :func:`read_counts` takes the
    last one."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = event_counts(stream).writeStream.outputMode("complete").foreachBatch(write) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts after the last micro-batch."""
    counts = spark.read.parquet(out)
    last = counts.agg(F.max("batch")).first()[0]
    return counts.filter(F.col("batch") == F.lit(last)).drop("batch")


def start_lookup(stream: DataFrame, key: str, values: Sequence[str], order: Sequence[str], checkpoint: str, out: str,
                 available_now: bool = True) -> StreamingQuery:
    """Last write and first appearance of each key, kept as streaming state.

    The state of a key is the values at its largest ``order`` and its smallest
    ``order``.  Both are decided by the order, not by arrival, so late, reordered
    and repeated events end in the lookup of the batch job.  Every micro-batch
    writes the keys that it changed to the folder of its batch id below ``out``
    (overwritten on replay); :func:`read_lookup` merges them.  State holds every
    key ever seen: for many keys set the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).  Let ``order`` be total."""
    at = F.struct(*[F.col(o) for o in order])
    state = stream.groupBy(F.col(key)).agg(
        F.max(F.struct(at.alias("at"), F.struct(*[F.col(v) for v in values]).alias("v"))).alias("last"), F.min(at).alias("first_seen"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_lookup(spark: SparkSession, out: str, key: str) -> DataFrame:
    """(key, values..., first_seen) after the last micro-batch: of the rows written for a key the one with the latest
    state, which a hash aggregate of one row a key and batch finds."""
    rows = spark.read.parquet(out)
    merged = rows.groupBy(key).agg(F.max("last").alias("last"), F.min("first_seen").alias("first_seen"))
    return merged.select(key, "last.v.*", "first_seen")
