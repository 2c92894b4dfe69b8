"""Kept manifests of enumerating selectors, compared by digests of buckets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.state import Snapshots, Version, new_run_id

#: Ids a bucket holds before a selector's buckets double.
BUCKET_ROWS = 200_000
ROWS = "doc_id string"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets))


def digests(ids: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, digest): a fingerprint of each bucket of distinct ids.

    Sums of a hash depend on no order; a task shuffles a row for each bucket.
    """
    return (
        ids.select("doc_id").distinct()
        .groupBy(_bucket(buckets).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id", F.lit(7)).cast("decimal(20,0)")).cast("string").alias("digest"))
    )


class Manifests(Snapshots):
    """What each selector listed last, in buckets whose digests stand in the commit.

    A table is named `manifest/<selector>/<buckets>/<bucket>/<digest>`: a new listing is compared with
    the names, and only buckets that differ are read, anti-joined and written again.
    """

    @staticmethod
    def _prefix(selector: str) -> str:
        return "manifest/" + hashlib.sha256(selector.encode("utf-8")).hexdigest()[:16]

    def _kept(self, version: Version, selector: str) -> dict[int, str]:
        prefix = self._prefix(selector) + "/"
        return {int(n.split("/")[3]): n for n in version.tables if n.startswith(prefix)}

    def _plan(self, version: Version, selector: str, rows: int) -> int:
        kept = list(self._kept(version, selector).values())
        buckets = int(kept[0].split("/")[2]) if kept else 1
        while rows > 2 * buckets * BUCKET_ROWS:
            buckets *= 2
        return buckets

    def listed(self, selector: str, only: set[int] | None = None) -> DataFrame:
        """Ids of the last listing, of some buckets or of all."""
        version = self.current()
        names = [n for b, n in self._kept(version, selector).items() if only is None or b in only]
        folders = sorted(f"{self.root}/{version.tables[n]}" for n in names)
        schema = self.spark.createDataFrame([], ROWS).schema
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], ROWS)

    def compare(self, selector: str, current: DataFrame) -> tuple[DataFrame, set[int], int]:
        """Ids gone since the last listing, the buckets that differ, and how many buckets there are.

        Digests of the new listing come to the driver, one for each bucket of `BUCKET_ROWS` ids.
        """
        version = self.current()
        kept = self._kept(version, selector)
        buckets = int(next(iter(kept.values())).split("/")[2]) if kept else 1
        now = {r.bucket: f"{r.n}-{r.digest}" for r in digests(current, buckets).collect()}
        odd = {b for b, name in kept.items() if name.rsplit("/", 1)[1] != now.get(b)}
        fresh = current.select("doc_id").distinct()
        if len(odd) < buckets:
            fresh = fresh.where(_bucket(buckets).isin(sorted(odd)))
        gone = self.listed(selector, odd).join(fresh, "doc_id", "left_anti")
        return gone, odd | (set(now) - set(kept)), buckets

    def replace(self, selector: str, current: DataFrame) -> set[str]:
        """Make `current` the selector's listing; returns the names of the buckets that were written."""
        version = self.current()
        rows = current.select("doc_id").distinct()
        _, odd, before = self.compare(selector, current)
        buckets = self._plan(version, selector, sum(r.n for r in digests(current, before).collect()))
        kept = self._kept(version, selector)
        if buckets != before:
            odd = set(range(buckets))
        tables = {n: f for n, f in version.tables.items() if n not in kept.values() or (buckets == before and int(n.split("/")[3]) not in odd)}
        if odd:
            placed = rows.withColumn("bucket", _bucket(buckets)).where(F.col("bucket").isin(sorted(odd)))
            folder = self.write(f"{self._prefix(selector)}/run={new_run_id()}", placed, "bucket")
            for r in digests(rows, buckets).collect():
                if r.bucket in odd:
                    tables[f"{self._prefix(selector)}/{buckets}/{r.bucket}/{r.n}-{r.digest}"] = f"{folder}/bucket={r.bucket}"
        self.commit(version, tables)
        return set(tables) - set(version.tables)


def tombstones(
    spark: SparkSession, root: str, selector: str, current: DataFrame, complete: bool
) -> DataFrame:
    """Ids an enumerating selector once listed and no longer does, from its kept manifest.

    Only a complete selection may delete, within its own selector's scope, and only then does it
    replace the manifest. The ids are settled in the manifest's folder before that.
    """
    store = Manifests(spark, root)
    gone, _, _ = store.compare(selector, current)
    if not complete:
        return gone.where(F.lit(False))
    folder = store.write(f"tombstones/run={new_run_id()}", gone)
    store.replace(selector, current)
    return spark.read.schema(gone.schema).parquet(f"{store.root}/{folder}")

