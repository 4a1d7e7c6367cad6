"""Structured Streaming: continuous aggregates, consumer groups and fan-out."""

from __future__ import annotations

from collections.abc import Iterator
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A table (a folder or one file of parquet) as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)


def continuous(stream: DataFrame, key: Column, time: Column, value: Column, width: str, late: str = "1 hour") -> DataFrame:
    """A downsampling rule on a stream: tumbling windows with a watermark."""
    rows = stream.select(key.alias("key"), time.cast("timestamp").alias("at"), value.alias("value")).withWatermark("at", late)
    out = rows.groupBy("key", F.window("at", width)).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return out.select("key", F.unix_millis("window.start").alias("ts"), "total", "n")


def upsert_to(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run until the source is used up, in update mode: each batch adds the rows that it
    changed as files of its own, which a batch that runs again after a failure replaces. The
    watermark bounds the state. ``upserted`` reads the result."""
    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key that ``upsert_to`` wrote."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (*keys, "batch"))), "batch").alias("row"))
    return last.select(*keys, "row.*")


def append_to(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once files; the checkpoint is the group's cursor."""
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliveries(stream: DataFrame, group: str, key: Column, ms: Column, entry: Column, consumer: Column) -> DataFrame:
    """A consumer group on a stream: (key, grp, ms, entry, consumer) of what is new. The
    query's checkpoint is the group's cursor, so that each entry is delivered once."""
    return stream.select(key.alias("key"), F.lit(group).alias("grp"), ms.alias("ms"), entry.alias("entry"), consumer.alias("consumer"))


_PENDING = "key string, grp string, consumer string, n long, oldest long"


def pending_lists(ops: DataFrame) -> DataFrame:
    """The pending lists of consumer groups as state over a stream ``ops(key, grp, op, entry,
    consumer, at)``, where op is deliver, ack or claim (an entry goes to another consumer, if
    it is pending). A row (key, grp, consumer, n, oldest) tells how many entries a consumer
    has after each batch that changed its list, and when the oldest was delivered. The state
    holds what is pending and nothing else."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        changed = set()
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["at", "entry", "op"], key=lambda c: c.map(_TURN) if c.name == "op" else c, kind="stable")
        for op, entry, consumer, at in zip(rows["op"], rows["entry"].astype(str), rows["consumer"], rows["at"]):
            before = held.get(entry)
            if op == "ack" and before:
                del held[entry]
            elif op == "deliver" and not before or op == "claim" and before:
                held[entry] = [consumer, int(at)]
            changed |= {before[0]} if before else set()
            changed |= {consumer} if op != "ack" else set()
        state.update((json.dumps(held),))
        for c in sorted(changed):
            times = [t for who, t in held.values() if who == c]
            yield pd.DataFrame({"key": [name[0]], "grp": [name[1]], "consumer": [c], "n": [len(times)], "oldest": [min(times, default=None)]}).astype({"oldest": "Int64"})

    return ops.groupBy("key", "grp").applyInPandasWithState(step, _PENDING, "held string", "update", "NoTimeout")


_TURN = {"deliver": 0, "claim": 1, "ack": 2}


def fan_out(stream: DataFrame, exact: DataFrame, patterns: list[tuple[str, str]] = ()) -> DataFrame:
    """Copies of each message of a stream (id, channel) for its subscribers."""
    from ..operators import pubsub

    return pubsub.deliveries(stream, exact, patterns)
