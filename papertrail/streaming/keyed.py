"""Keyed state of streams: how often an item was tried, and reminders that timers fire."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from papertrail.operators.checklist import HOUR, OFFSETS

#: After so many failures an item is given up.
MOST_ATTEMPTS = 3
TRIED = "uri string, generation long, try long, status string, error string"
ITEM = "uri string, generation long, status string, attempts int, error string"
REMINDER = "doc_id long, offset_days int, fire_at timestamp, state string"
_STORE, _PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in the store that arbitrary state needs."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


class Attempts(StatefulProcessor):
    """An item's state over its tries: pending ones change nothing; done and skipped are final; a failure counts, the last
    one gives the item up. A try that comes again (its number isn't larger than the last one's) changes nothing, so that a
    repeated batch counts once. Of an item that is seen for the first time, that generation is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", "generation long, status string, attempts int, error string, try long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        state = tuple(self.item.get()) if self.item.exists() else None
        before = state
        for r in sorted(rows, key=lambda r: (r["try"], r["generation"])):
            if state and (state[1] in ("done", "skipped_non_doc", "given_up") or r["try"] <= state[4]):
                continue
            generation = state[0] if state else r["generation"]
            status, attempts = r["status"], (state[2] if state else 0) + (r["status"] == "failed")
            if status == "failed" and attempts >= MOST_ATTEMPTS:
                status = "given_up"
            state = (generation, status, attempts, r["error"] if status in ("failed", "given_up") else None, r["try"])
        if state is not None and state != before:
            self.item.update(state)
            yield Row(uri=key[0], generation=state[0], status=state[1], attempts=state[2], error=state[3])

    def close(self) -> None:
        pass


class Reminders(StatefulProcessor):
    """A document's reminders: times that are past when it comes are skipped, the others get timers, which the stream's
    watermark fires. A document that comes again has its reminders made anew. Rows without times only move the clock."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.offsets = handle.getMapState("offsets", "ms long", "offset int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        last = max(rows, key=lambda r: r["now"])
        if last["fire_ms"] is None:
            return
        for ms in list(self.handle.listTimers()):
            self.handle.deleteTimer(ms if isinstance(ms, int) else ms[0])
        self.offsets.clear()
        for offset, ms in zip(last["offsets"], last["fire_ms"], strict=True):
            late = ms <= last["now"]
            if not late:
                self.offsets.updateValue((ms,), (offset,))
                self.handle.registerTimer(ms)
            yield Row(doc_id=key[0], offset_days=offset, ms=ms, state="skipped_past" if late else "scheduled")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        ms = expiredTimerInfo.getExpiryTimeInMs()
        if self.offsets.containsKey((ms,)):
            yield Row(doc_id=key[0], offset_days=self.offsets.getValue((ms,))[0], ms=ms, state="fired")

    def close(self) -> None:
        pass


def _written(out: DataFrame, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Each batch of results in a folder of its own, which a repeated batch replaces."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with state_store(out.sparkSession):
        return out.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_attempts(tries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of each item over a stream of tries (uri, generation, try, status, error); stop and go on as you like.
    Items are keys: an item's tries meet in one task, of which there are few."""
    out = tries.groupBy("uri").transformWithState(statefulProcessor=Attempts(), outputStructType=ITEM, outputMode="Update", timeMode="None")
    return _written(out, path, checkpoint, "update")


def items(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each item."""
    every = spark.read.schema(ITEM + ", batch long").parquet(path)
    return every.groupBy("uri").agg(F.max_by(F.struct("generation", "status", "attempts", "error"), "batch").alias("s")).select("uri", "s.*")


def run_reminders(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Reminders over a stream of documents (doc_id, expiry_on, at: a timestamp); a null expiry_on only moves the clock."""
    fire = [F.unix_millis(F.date_sub("expiry_on", o).cast("timestamp") + F.expr(f"INTERVAL {HOUR} HOURS")) for o in OFFSETS]
    rows = docs.withWatermark("at", "0 seconds").select("doc_id", "at", F.unix_millis("at").alias("now"), F.lit(list(OFFSETS)).alias("offsets"), F.when(F.col("expiry_on").isNotNull(), F.array(*fire)).alias("fire_ms"))
    out = rows.groupBy("doc_id").transformWithState(statefulProcessor=Reminders(), outputStructType="doc_id long, offset_days int, ms long, state string", outputMode="Append", timeMode="EventTime")
    return _written(out.select("doc_id", "offset_days", F.timestamp_millis("ms").alias("fire_at"), "state"), path, checkpoint, "append")


def reminders(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each reminder; fired comes after scheduled."""
    every = spark.read.schema(REMINDER + ", batch long").parquet(path)
    return every.groupBy("doc_id", "offset_days", "fire_at").agg(F.max_by("state", F.struct("batch", (F.col("state") == "fired"))).alias("state"))
