"""What a run writes of its texts is compressed well."""

import random
from pathlib import Path

import pytest

from tidemark.plans.state import Snapshots


@pytest.mark.parametrize("by", [(), ("part",)])
def test_a_written_table_is_smaller_than_with_the_default_codec(spark, tmp_path, by):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(words[int(rng.paretovariate(0.6)) % 3000] for _ in range(400)) for _ in range(400)]
    df = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)], "part int, text string").coalesce(2)
    folder = Snapshots(spark, str(tmp_path)).write("texts", df, *by)
    df.write.option("compression", "snappy").parquet(f"{tmp_path}/plain")
    size, plain = (sum(f.stat().st_size for f in Path(tmp_path, x).rglob("*.parquet")) for x in (folder, "plain"))
    assert spark.read.parquet(f"{tmp_path}/{folder}").count() == 400
    assert size < 0.8 * plain
