"""Landed issue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.instants import aware_instant
from tidemark.operators.changes import canonical_documents

SYSTEM = "github"
STATES = ["all", "open", "closed"]


def config_problems(config: dict) -> list[str]:
    problems = []
    if "/" not in str(config.get("repo") or ""):
        problems.append(f"config 'repo' must be owner/name: {config.get('repo')!r}")
    if config.get("state", "all") not in STATES:
        problems.append(f"config 'state' must be all/open/closed: {config.get('state')!r}")
    return problems


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines landing zone to one `raw` text column."""
    return spark.read.text(path).select(F.col("value").alias("raw"))


def _text_field(name: str) -> Column:
    return F.try_variant_get("v", f"$.{name}", "string")


def _parsed(landed: DataFrame) -> DataFrame:
    # a one-element array stops the optimizer from copying the parse into every filter
    return landed.select("raw", F.explode(F.array(F.try_parse_json("raw"))).alias("v"))


def _reason() -> Column:
    """Why a landed line is no record; NULL for a good one."""
    kind = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
    return (
        F.when(F.col("v").isNull(), "line does not parse as JSON")
        .when(~kind.startswith("OBJECT"), "line holds JSON, but no object")
        .when(_text_field("number").isNull(), "object has no number")
        .when(_text_field("updated_at").isNull(), "object has no update stamp")
    )


def fetch(landed: DataFrame, repo: str, since: str | None = None, state: str = "all") -> DataFrame:
    """Each issue as it landed last, where that is at or after the watermark.

    The comparison is inclusive, so the last record comes again; the diff makes that
    harmless. Other row kinds are dropped; lines that are no record go to `rejects`.
    The state filter looks at the latest landing only.
    """
    is_issue = F.try_variant_get("v", "$.pull_request", "variant").isNull()
    rows = _parsed(landed).where(F.col("raw").isNotNull() & _reason().isNull() & is_issue)
    rows = rows.withColumn("updated_at", _text_field("updated_at"))
    if since is not None:
        rows = rows.where(F.col("updated_at") >= since)
    rows = rows.select(
        F.concat(F.lit(f"{repo}/issues/"), _text_field("number")).alias("native_id"),
        _text_field("html_url").alias("url"),
        "updated_at",
        "raw",
        _text_field("state").alias("state"),
    )
    if not landed.isStreaming:  # a stream's micro-batches are cut to the latest by their run
        rows = latest(rows)
    if state != "all":
        rows = rows.where(F.col("state") == state)
    return rows.select("native_id", "url", "updated_at", "raw")


def latest(rows: DataFrame) -> DataFrame:
    """One row for each `native_id`: the one updated last, by raw text where stamps tie."""
    rest = [c for c in rows.columns if c != "native_id"]
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", "raw"))
    return rows.groupBy("native_id").agg(newest.alias("r")).select("native_id", *(f"r.{c}" for c in rest))


def rejects(landed: DataFrame) -> DataFrame:
    """Lines that are no record, with the reason."""
    return (
        _parsed(landed.where(F.col("raw").isNotNull()))
        .select("raw", _reason().alias("reject_reason"))
        .where(F.col("reject_reason").isNotNull())
    )


def watermark(fetched: DataFrame, previous: str | None) -> DataFrame:
    """The greatest update stamp seen, else the previous one."""
    return fetched.agg(
        F.greatest(F.max("updated_at"), F.lit(previous).cast("string")).alias("since")
    )


def normalize(issues: DataFrame, system: str = SYSTEM) -> DataFrame:
    """Update stamps and comment counts never enter the canonical form."""
    issues = issues.withColumn("v", F.try_parse_json("raw"))
    labels = F.array_sort(
        F.transform(
            F.coalesce(
                F.try_variant_get("v", "$.labels", "array<variant>"),
                F.array().cast("array<variant>"),
            ),
            lambda label: F.try_variant_get(label, "$.name", "string"),
        )
    )
    structured = F.to_json(
        F.struct(
            F.try_variant_get("v", "$.user.login", "string").alias("author"),
            _text_field("created_at").alias("created_at"),
            labels.alias("labels"),
            _text_field("state").alias("state"),
        ),
        {"ignoreNullFields": "false"},
    )
    return canonical_documents(
        issues.select(
            F.lit(system).alias("system"),
            "native_id",
            "url",
            aware_instant(F.col("updated_at")).alias("retrieved_at"),
            text.first_nonempty(_text_field("title"), F.col("native_id")).alias("title"),
            text.strip(F.coalesce(_text_field("body"), F.lit(""))).alias("text"),
            structured.alias("structured"),
        )
    )
