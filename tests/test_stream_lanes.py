"""Many keys share a lane of the keyed stream: the first stage runs once, Python is called by lane."""

import random

from pyspark.sql import functions as F

from tidemark.session import ROCKSDB_PROVIDER
from tidemark.streaming.keyed_changes import OUTPUT, classify_log, classify_stream

LOG = "key string, s long, event_id long, content string"


def test_lanes_hold_many_keys_over_micro_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(300)}", 400 * i, i, rng.choice(["a", "b", None])) for i in range(1500)]
    for n, (a, b) in enumerate([(0, 700), (700, 1500)]):
        spark.createDataFrame(rows[a:b], LOG).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
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
    assert got == sorted(map(tuple, classify_log(log(spark.createDataFrame(rows, LOG))).collect())) and len(got) == 1500
    # one operator for each stage; the first one ran twice before
    assert len(stream.lastProgress["stateOperators"]) == 2
