"""Incremental runs over a stream of landed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.run import Fetch, Publisher, Source, run
from tidemark.plans.state import Cursor, State


class _Batch:
    """One micro-batch as a source. It is a slice, so it never counts as complete
    unless it carries explicit tombstones."""

    def __init__(self, source: Source, records: DataFrame, query_id: str, batch_id: int) -> None:
        self.name = source.name
        self._source = source
        # two updates of one record may share a batch; the source knows which one is later
        self._records = source.latest(records) if hasattr(source, "latest") else records
        self._payload = {"query_id": query_id, "batch_id": batch_id}

    def problems(self, config: dict) -> list[str]:
        return self._source.problems(config)

    def fetch(self, spark: SparkSession, config: dict, cursor: Cursor | None) -> Fetch:
        explicit = "deleted" in self._records.columns and not self._records.where("deleted").isEmpty()
        return Fetch(self._records, self._payload, complete=explicit)

    def normalize(self, records: DataFrame) -> DataFrame:
        return self._source.normalize(records)


def run_stream(
    records: DataFrame,
    source: Source,
    publisher: Publisher,
    *,
    config: dict,
    state_root: str,
    checkpoint: str,
    replays: tuple[list[str], str, str] | None = None,
    **options: object,
) -> StreamingQuery:
    """Every micro-batch is a run; what is available is processed, then it stops.

    Delivery is at least once. A batch that was published is recognised by the ids of its
    query and itself in the cursor; one that failed before is simply run again, and the
    diff drops what is already there (T2). A new checkpoint is a new query: its batches
    count from 0 again and are all run. Each batch is a run with an id of its own.

    With `replays`, that is key columns, a stamp and a delay, records that come again within the delay
    are dropped before a batch sees them, also across batches and restarts (T2).
    """
    options.pop("run_id", None)
    if replays is not None:
        keys, ts, delay = replays
        # the source's own column stays as it is
        stamped = records.withColumn("__stamp", F.col(ts))
        records = without_replays(stamped, keys, "__stamp", delay).drop("__stamp")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = State(spark, state_root)
        cursor = state.cursor(state.current(), source.name, config)
        query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        payload = cursor.payload if cursor else {}
        if payload.get("query_id") == query_id and payload.get("batch_id", -1) >= batch_id:
            return
        run(
            spark, _Batch(source, batch, query_id, batch_id), publisher,
            config=config, state_root=state_root, **options,
        )

    return (
        records.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def without_replays(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Exact replays dropped within a watermark; a naive stamp is read as session time."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


class _Nothing:
    """A source with no new records: only grounding in other systems can have moved."""

    def __init__(self, source: Source, records: DataFrame) -> None:
        self.name = source.name
        self._source, self._records = source, records

    def problems(self, config: dict) -> list[str]:
        return self._source.problems(config)

    def fetch(self, spark: SparkSession, config: dict, cursor: Cursor | None) -> Fetch:
        payload = cursor.payload if cursor else {}
        return Fetch(self._records.limit(0), payload, complete=False)

    def normalize(self, records: DataFrame) -> DataFrame:
        return self._source.normalize(records)


def run_drift(
    spark: SparkSession,
    source: Source,
    empty_records: DataFrame,
    publisher: Publisher,
    *,
    config: dict,
    state_root: str,
    **options: object,
):
    """T5: the scheduled drift job, scoped by the systems in the cursor.

    A stream does not call its batch function without new input, so drift needs a job of
    its own.
    """
    return run(
        spark, _Nothing(source, empty_records), publisher,
        config=config, state_root=state_root, **options,
    )
