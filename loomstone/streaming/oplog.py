"""Structured Streaming over operation logs: JSON operations in, batches of a store's log out.

Every micro-batch becomes one batch of the log, whose number is noted first; a micro-batch that runs again after a failure
finds that number, and writes that batch anew if it is incomplete and not at all otherwise. So each operation is applied
once. A store has one writer at a time."""

from __future__ import annotations

from loomstone.operators import lifecycle
from loomstone.schema import ENTITY_INPUT, LISTS, conform, typed_attributes
from loomstone.sources.store import EntityStore
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OPERATION = f"seq bigint, op string, entity_id bigint, payload struct<{', '.join(x.replace(' ', ':', 1) for x in ENTITY_INPUT.split(', '))}>"


def read_operations(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of operations from JSON-lines files: seq, op (insert, update, remove), entity_id, payload."""
    return spark.readStream.schema(OPERATION).option("maxFilesPerTrigger", per_trigger).json(folder)


def as_log(operations: DataFrame) -> DataFrame:
    """Operations as rows of a log: seq, op and the columns of an entity."""
    empty = F.array().cast("array<struct<key:string,value:string>>")
    lists = {c: F.col(f"payload.{c}") for c in LISTS} | {"attributes": typed_attributes(F.coalesce("payload.attributes", empty))}
    rows = operations.select("seq", "op", F.coalesce("entity_id", "payload.id").alias("entity_id"), F.col("seq").alias("ord"), *[v.alias(k) for k, v in lists.items()])
    return conform(rows, keep=("seq", "op"))


def apply(store: EntityStore, operations: DataFrame, checkpoint: str, rejected: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Applies the valid operations of a stream to a store; the others go, with their error, to the folder ``rejected``."""

    def one(batch: DataFrame, number: int) -> None:
        # the number of the batch in the log is noted before it is written, so a repeated micro-batch writes the same one or none
        note = f"{store.root}/stream/n={number}"
        if store.files.exists(note):
            b = int(store.files.read(note))
            if b < store._current()[1] or b in store._batches():
                return
        else:
            b = store.next_batch()
            store.files.mkdirs(f"{store.root}/stream")
            store.files.replace(note, str(b))
        judged = lifecycle.judged(as_log(batch), store.entities()).persist()
        try:
            if rejected:
                judged.where("error is not null").select("seq", "op", "entity_id", "error").write.mode("overwrite").parquet(f"{rejected}/n={number}")
            good = judged.where("error is null").drop("error").withColumn("stream_seq", F.col("seq"))
            store.write_batch(b, good, "stream_seq")
        finally:
            judged.unpersist()

    w = operations.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
