"""The keyed change log as a stream of several micro-batches."""

import random

from pyspark.sql import functions as F

from tidemark.session import ROCKSDB_PROVIDER
from tidemark.streaming.keyed_changes import OUTPUT, classify_log, classify_stream

LOG = "key string, s long, event_id long, content string"


def test_hot_key_in_slices_over_micro_batches(spark, tmp_path):
    """A key with a third of the log, slices that go on in the next file, NULL contents."""
    rng = random.Random(9)
    rows = [("hub" if i % 3 == 0 else f"k{i % 7}", 3_000 * i + rng.randrange(900), i, rng.choice(["a", "b", None])) for i in range(400)]
    cuts = [0, 130, 131, 280, 400]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:b], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part{n}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)

    def log(df):
        return df.select("key", F.timestamp_seconds("s").alias("ts"), "event_id", "content")

    schema = spark.createDataFrame([], LOG).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream = (
        classify_stream(log(source)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    assert stream.awaitTermination(280)
    got = sorted(map(tuple, spark.read.schema(OUTPUT).parquet(str(tmp_path / "out")).collect()))
    whole = log(spark.createDataFrame(rows, LOG))
    assert got == sorted(map(tuple, classify_log(whole).collect())) and len(got) == 400
    # the first stage's groups: the hub is many of them, none with more than a few rows
    groups = whole.where("key = 'hub'").groupBy(F.date_trunc("day", "ts")).count().collect()
    assert len(groups) > 10 and max(r["count"] for r in groups) < 20
