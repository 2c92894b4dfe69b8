"""Change classification over a keyed log, in batch and as a stateful stream (T4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

OUTPUT = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)


def classify_log(log: DataFrame, width: str = "day") -> DataFrame:
    """(key, ts, event_id, content) to (key, event_id, kind) by the key's previous content.

    Batch twin of the stateful stream. A key is cut into time buckets: inside a bucket
    the previous row is a `lag`, and a bucket's first row looks at the last content of
    the bucket before. So one key with a third of the log is worked on by many tasks.
    """
    rows = log.withColumn("bucket", F.date_trunc(width, "ts"))
    # content travels in a struct, so that a NULL content differs from no row at all
    rows = rows.withColumn("held", F.struct("content"))
    tails = rows.groupBy("key", "bucket").agg(
        F.max_by("held", F.struct("ts", "event_id")).alias("tail")
    )
    by_key = Window.partitionBy("key").orderBy("bucket")
    carried = tails.select("key", "bucket", F.lag("tail").over(by_key).alias("carried"))
    inside = Window.partitionBy("key", "bucket").orderBy("ts", "event_id")
    first = F.row_number().over(inside) == 1
    previous = F.when(first, F.col("carried")).otherwise(F.lag("held").over(inside))
    joined = rows.join(carried, ["key", "bucket"])
    kind = (
        F.when(F.col("previous").isNull(), "added")
        .when(F.col("previous.content").eqNullSafe(F.col("content")), "unchanged")
        .otherwise("modified")
    )
    return joined.withColumn("previous", previous).select("key", "event_id", kind.alias("kind"))


_KEY = T.StructType([T.StructField("key", T.StringType())])
_CONTENT = T.StructType([T.StructField("content", T.StringType())])
_HELD = T.StructType([*_KEY.fields, *_CONTENT.fields])

SLICED = T.StructType(
    [
        *OUTPUT.fields,
        # the rest is NULL but in the one row that tells how a slice goes on
        T.StructField("slice", T.TimestampType()),
        T.StructField("opens", T.BooleanType()),
        T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()),
    ]
)


def _contents(column: pd.Series) -> pd.Series:
    """With None for NULL, whatever pandas made of it."""
    column = column.astype(object)
    return column.where(column.notna(), None)


class _Slices(StatefulProcessor):
    """First stage, by slice and lane of keys: a row is classified by its key's row before in the slice."""

    def __init__(self, keep: int | None) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        # read and written as one list: a call to the state for each key costs more than the key's rows
        self.held = handle.getListState("held", _HELD, self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # rows of one lane come in no order; the lane of a slice and a micro-batch bound them
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["key", "ts", "event_id"], ignore_index=True)
        held = {k: None if pd.isna(c) else c for k, c in self.held.get()}
        keys, content = frame["key"], _contents(frame["content"])
        first, last = keys.ne(keys.shift()), keys.ne(keys.shift(-1))
        before = _contents(content.shift())
        before[first] = pd.Series([held.get(k) for k in keys[first]], index=keys.index[first], dtype=object)
        opens = first & ~keys.isin(held.keys())
        same = (content == before) | (content.isna() & before.isna())
        kind = same.map({True: "unchanged", False: "modified"})
        inside = pd.DataFrame({"key": keys, "event_id": frame["event_id"], "kind": kind})[~opens]
        yield inside.reindex(columns=SLICED.names).astype(object)
        yield pd.DataFrame(
            {
                "key": keys[first].to_numpy(), "event_id": frame["event_id"][first].to_numpy(), "kind": None, "slice": key[0],
                "opens": opens[first].to_numpy(), "first": content[first].to_numpy(), "last": content[last].to_numpy(),
            }
        )[SLICED.names].astype(object)
        held.update(zip(keys[last], content[last], strict=True))
        self.held.put(list(held.items()))

    def close(self) -> None:
        pass


class _Borders(StatefulProcessor):
    """Second stage, by lane of keys: the first row of a slice against the last content of the slices before.

    Rows that the first stage has classified come in lanes below 0 and pass without state.
    """

    def __init__(self, forget_after: int | None) -> None:
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", _KEY, _CONTENT, self.forget_after)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            yield from (frame[OUTPUT.names] for frame in rows)
            return
        # one row for each key and slice that the micro-batch touches
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["key", "slice"], ignore_index=True)
        keys, first, last = frame["key"], _contents(frame["first"]), _contents(frame["last"])
        known: tuple | None = None
        kinds: list[str | None] = []
        starts, ends = keys.ne(keys.shift()), keys.ne(keys.shift(-1))
        for k, start, end, opens, a, b in zip(keys, starts, ends, frame["opens"], first, last, strict=True):
            if start:
                known = self.last.getValue((k,))
                known = None if known is None else (None if pd.isna(known[0]) else known[0],)
            kinds.append(None if not opens else "added" if known is None else "unchanged" if known[0] == a else "modified")
            known = (b,)
            if end:
                self.last.updateValue((k,), known)
        out = pd.DataFrame({"key": keys, "event_id": frame["event_id"], "kind": pd.Series(kinds, dtype=object)})
        yield out[out["kind"].notna()]

    def close(self) -> None:
        pass


def _time(ttl: int | None) -> str:
    return "None" if ttl is None else "ProcessingTime"


def sliced_log(log: DataFrame, width: str = "day", keep: int | None = None, lanes: int = 256) -> DataFrame:
    """First stage: classified rows, and for each key and slice touched one row that says how it opens and ends."""
    key = F.col("key").cast("string")
    return (
        log.select(
            key.alias("key"), F.date_trunc(width, "ts").alias("slice"), F.pmod(F.xxhash64(key), F.lit(lanes)).alias("lane"),
            "ts", "event_id", "content",
        )
        .groupBy("slice", "lane")
        .transformWithStateInPandas(
            statefulProcessor=_Slices(keep), outputStructType=SLICED, outputMode="Append", timeMode=_time(keep)
        )
    )


def classify_stream(
    log: DataFrame, width: str = "day", keep_slices: int | None = None, forget_after: int | None = None, lanes: int = 256
) -> DataFrame:
    """Stateful form of the keyed diff in two stages; needs the RocksDB state store.

    A key is cut into time slices that classify inside themselves, so that a key with a third of the
    log is worked on by many tasks. Only one small row for each slice goes on to the key's own state,
    which says what the slice's first row is. Keys share `lanes` by hash: Python is called, and a slice's
    state read, once for a lane and not once for a key. Rows come in about the order of time; a slice may
    go on in a later micro-batch. `forget_after` milliseconds without a row, a key is forgotten and
    its next row counts as added; by default none is. `lanes` can't change under one checkpoint.

    Bound a micro-batch with `maxFilesPerTrigger` or `maxBytesPerTrigger` at the source: a lane's
    rows of one slice and micro-batch are ordered together in one task.
    """
    dealt = sliced_log(log, width, keep_slices, lanes).withColumn(
        "lane",
        F.when(F.col("slice").isNull(), -1 - F.pmod(F.xxhash64("event_id"), F.lit(lanes)))
        .otherwise(F.pmod(F.xxhash64("key"), F.lit(lanes))),
    )
    return dealt.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=_Borders(forget_after), outputStructType=OUTPUT, outputMode="Append",
        timeMode=_time(forget_after),
    )
