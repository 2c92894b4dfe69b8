"""Exact duplicates through an extendible-hash index kept as files in the shared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, texts

#: Entries a bucket holds before it is split.
BUCKET_ENTRIES = 4096
#: The directory doubles until no bucket is overfull, or until the hash has no bits left.
MOST_BITS = 62


@dataclass
class Index:
    """``entries``: a row for each text, in key order. ``directory``: a row for each bucket."""

    entries: DataFrame
    directory: DataFrame
    depth: int


def keyed(docs: DataFrame) -> DataFrame:
    """Null text counts as empty. ``key`` has the hash bits that address buckets."""
    body = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return body.select(
        "doc_id",
        "text",
        F.xxhash64("text").alias("key"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def prefix(key, bits: int):
    """The first ``bits`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def build(docs: DataFrame, scratch: Scratch, capacity: int = BUCKET_ENTRIES) -> Index:
    """Index all rows.

    Equal texts meet by value: grouping by key and text compares bytes, and copies are combined
    before the shuffle, so that a text with a third of all rows is one row from each task. The
    table of entries then holds no text. Texts that share a key form a chain.

    The directory starts at the depth that the count of texts asks for; each doubling splits only overfull buckets by
    their next bit. A bucket whose entries all share one key has nothing to split by: it stays as
    a chain. Only the largest bucket's size reaches the driver.
    """
    grouped = keyed(docs).groupBy("key", "text").agg(
        F.max("doc_id").alias("keep_id"),
        F.count("*").alias("group_size"),
    )
    flat = scratch.settle(grouped.withColumn("text_sha256", F.sha2("text", 256)).drop("text"))
    total = flat.count()
    depth = max(0, (total // capacity).bit_length() - 1)
    open_, closed = flat.select("key"), None
    while True:
        cells = open_.groupBy(prefix(F.col("key"), depth).alias("slot")).agg(
            F.count("*").alias("entries"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        cells = scratch.settle(cells.withColumn("bits", F.lit(depth)))
        splits = (F.col("entries") > capacity) & (F.col("low") != F.col("high"))
        done = cells.where(~splits if depth < MOST_BITS else F.lit(True)).select("slot", "bits", "entries")
        closed = done if closed is None else closed.union(done)
        over = cells.where(splits).select("slot")
        if depth >= MOST_BITS or over.isEmpty():
            break
        open_ = open_.withColumn("slot", prefix(F.col("key"), depth)).join(over, "slot", "left_semi").select("key")
        depth += 1
    directory = scratch.settle(
        closed.select(
            F.expr("shiftleft(slot, cast(64 - bits as int))").alias("first_key"), "slot", "bits", "entries"
        )
    )
    # owner tasks hold ranges of keys, that is runs of neighbouring buckets; in signed order a
    # bucket's keys stay together, since a bucket is a run of keys with one prefix
    owned = flat.repartitionByRange("key").sortWithinPartitions("key", "text_sha256")
    return Index(scratch.settle(owned), directory, depth)


def exact_duplicates(docs: DataFrame, scratch: Scratch | None = None, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row, dropped ones too.

    Of equal texts the row with the largest ``doc_id`` stays; a null ``doc_id`` is smaller than any
    other, and a group of nulls only has a null ``keep_id`` and keeps its rows. Null and empty texts
    are equal. Rows repeated with their ``doc_id`` count as rows of the group and are all marked like
    the one that stays. Texts of any length are compared whole. An empty table gives no rows. Further
    columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    index = build(docs, scratch, capacity)
    rows = keyed(docs)
    entry = ["key", "text_sha256"]
    found = rows.drop("text").join(index.entries.select(*entry, "keep_id", "group_size"), entry)
    chained = scratch.settle(index.entries.groupBy(*entry).agg(F.count("*").alias("n")).where("n > 1").select(*entry))
    if not chained.isEmpty():  # texts that share key and digest: their rows are told apart by bytes
        rest = found.join(chained, entry, "left_anti")
        tied = rows.join(chained, entry, "left_semi")
        own = tied.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = rest.union(tied.join(own, ["key", "text"]).select(*rest.columns))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
