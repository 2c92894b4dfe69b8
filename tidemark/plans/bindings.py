"""Sources bound to the run contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.run import Fetch, SelectionError
from tidemark.plans.state import Cursor
from tidemark.session import settled
from tidemark.sources import commits, issues, markdown, responses


class MarkdownTree:
    """Always a full scan; the cursor is not used."""

    name = markdown.SYSTEM

    def problems(self, config: dict) -> list[str]:
        return markdown.config_problems(config)

    def fetch(self, spark: SparkSession, config: dict, cursor: Cursor | None) -> Fetch:
        return Fetch(markdown.read(spark, config))

    def normalize(self, records: DataFrame) -> DataFrame:
        return markdown.normalize(records)


class CommitLog:
    """S3: a Parquet table (seq, record); only records after the watermark are read."""

    name = commits.SYSTEM

    def problems(self, config: dict) -> list[str]:
        return commits.config_problems(config)

    def fetch(self, spark: SparkSession, config: dict, cursor: Cursor | None) -> Fetch:
        last = cursor.payload.get("last_seq") if cursor else None
        log = spark.read.parquet(config["log"])
        got = commits.fetch(log, last, config.get("max_commits"))
        tip = commits.watermark(log.select("seq"), last).first()["last_seq"]
        return Fetch(got, {} if tip is None else {"last_seq": tip})

    def normalize(self, records: DataFrame) -> DataFrame:
        return commits.normalize(records)


class IssueFeed:
    """Landed JSON lines, inclusive of the last update stamp."""

    name = issues.SYSTEM

    def problems(self, config: dict) -> list[str]:
        return issues.config_problems(config) + (
            [] if config.get("path") else ["config 'path' is required"]
        )

    def fetch(self, spark: SparkSession, config: dict, cursor: Cursor | None) -> Fetch:
        since = cursor.payload.get("since") if cursor else None
        landed = issues.read_landed(spark, config["path"])
        got = issues.fetch(landed, config["repo"], since, config.get("state", "all"))
        bad = issues.rejects(landed)
        seen = issues.watermark(got, since).first()["since"]
        # the watermark moves past a broken line: it has no stamp, and its reject row stays
        return Fetch(got, {"since": seen} if seen else {}, complete=bad.isEmpty(), rejects=bad)

    def latest(self, records: DataFrame) -> DataFrame:
        return issues.latest(records)

    def normalize(self, records: DataFrame) -> DataFrame:
        return issues.normalize(records)


class ToolResponses:
    """Landed responses for a configured id list, or for landed selections."""

    name = "responses"

    def problems(self, config: dict) -> list[str]:
        need = [k for k in ("system", "responses", "retrieved_at") if not config.get(k)]
        out = [f"config '{k}' is required" for k in need]
        if bool(config.get("ids")) == bool(config.get("selections")):
            out.append("configure exactly one of 'ids' and 'selections'")
        if not out and config.get("ids"):
            spark = SparkSession.active()
            ids = spark.read.parquet(config["ids"])
            unusable = responses.enumerated(ids).where(F.col("reject_reason").isNotNull()).count()
            shared = responses.id_collisions(ids).count()
            if unusable:
                out.append(f"{unusable} configured ids cannot be used as document ids")
            if shared:
                out.append(f"{shared} document ids are each configured under several spellings")
        return out

    def fetch(self, spark: SparkSession, config: dict, cursor: Cursor | None) -> Fetch:
        if config.get("ids"):
            refs, whole = responses.enumerated(spark.read.parquet(config["ids"])), True
        else:
            landed = responses.read_landed(spark, config["selections"])
            # three readers, one parse
            refs, whole = settled(responses.select_refs(landed, *config.get("mapping", (None, None, None)))), False
            bad = refs.where(F.col("reject_reason").isNotNull())
            if not bad.isEmpty():
                # a selection that cannot be read fails closed
                raise SelectionError(bad)
        reads = responses.read_records(
            refs, responses.read_landed(spark, config["responses"]), config.get("text_key")
        )
        complete = responses.completeness(reads, whole).first()["complete"]
        stamped = reads.select(
            "*", F.lit(config["system"]).alias("system"), F.lit(config["retrieved_at"]).alias("stamp")
        )
        bad = reads.where(F.col("reject_reason").isNotNull()).select("raw_id", "reject_reason")
        return Fetch(stamped, {}, complete, rejects=bad)

    def normalize(self, records: DataFrame) -> DataFrame:
        return responses.normalize(records, F.col("system"), F.to_timestamp("stamp"))
