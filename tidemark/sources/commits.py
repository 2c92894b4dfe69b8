"""Exported commit log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.instants import aware_instant
from tidemark.operators.changes import canonical_documents
from tidemark.operators.numbering import numbered
from tidemark.session import settled

SYSTEM = "git_commits"

# The export's field separator, and its fields in order.
FIELD_SEPARATOR = "\x1f"
FIELDS = ["sha", "author", "author_email", "author_date", "commit_date", "subject", "body"]


def config_problems(config: dict) -> list[str]:
    problems = []
    if not config.get("log"):
        problems.append("config 'log' is required")
    bound = config.get("max_commits")
    if bound is not None and (not isinstance(bound, int) or isinstance(bound, bool)):
        problems.append(f"config 'max_commits' must be an int: {bound!r}")
    return problems


def newest(log: DataFrame, count: int, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The `count` records of the largest `seq`, by rank; ranges are sorted by a task each.

    Only sequence numbers are sorted, and records are read again for the ones that stay.
    """
    keys = log.select("seq", F.lit(0).alias("__all"), (-F.col("seq")).alias("__age"))
    chosen = numbered(keys, ["__age"], "__all", settle).where(F.col("rank") < count).select("seq")
    return log.join(chosen, "seq", "left_semi")


def fetch(
    log: DataFrame, last_seq: int | None = None, max_commits: int | None = None,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Records after the watermark, newest first when a first load is bounded.

    `log` holds (seq, record). The bound applies to the first load only, never to a
    delta. A record with too few fields is skipped.
    """
    rows = log
    if last_seq is not None:
        rows = rows.where(F.col("seq") > last_seq)
    elif max_commits is not None:
        rows = newest(rows, max_commits, settle or settled)
    parts = F.split(F.col("record"), FIELD_SEPARATOR)
    return (
        rows.where(text.strip(F.col("record")) != "")
        .withColumn("parts", parts)
        .where(F.size("parts") >= len(FIELDS))
        .select("seq", *[F.col("parts")[i].alias(f) for i, f in enumerate(FIELDS)])
    )


def watermark(fetched: DataFrame, previous: int | None) -> DataFrame:
    """The new watermark; a fetch without rows leaves the old one."""
    return fetched.agg(
        F.coalesce(F.max("seq"), F.lit(previous).cast("bigint")).alias("last_seq")
    )


def normalize(commits: DataFrame, system: str = SYSTEM) -> DataFrame:
    """A commit is immutable, so its hash never moves."""
    structured = F.to_json(
        F.struct("author", "author_date", "author_email"), {"ignoreNullFields": "false"}
    )
    return canonical_documents(
        commits.select(
            F.lit(system).alias("system"),
            F.col("sha").alias("native_id"),
            aware_instant(F.col("commit_date")).alias("retrieved_at"),
            text.first_nonempty(F.col("subject"), F.left("sha", F.lit(12))).alias("title"),
            text.strip(F.col("body")).alias("text"),
            structured.alias("structured"),
        )
    )
