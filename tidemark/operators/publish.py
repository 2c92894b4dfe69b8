"""Publication: path safety, action plan, accumulation, summary and bundle files
(K4-K8, J11, P23)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.operators.concepts import SECTIONS
from tidemark.session import settled


#: Failures that a message shows; a table has all of them.
SHOWN = 5


class PathError(ValueError):
    """A written or removed path leaves the bundle; `rows` has every one."""

    def __init__(self, message: str, rows: DataFrame | None = None) -> None:
        super().__init__(message)
        self.rows = rows


class PartialListingError(RuntimeError):
    """A base listing is incomplete, so absence from it proves nothing; `rows` has every branch."""

    def __init__(self, message: str, rows: DataFrame | None = None) -> None:
        super().__init__(message)
        self.rows = rows


def path_rejects(files: DataFrame, removed: DataFrame) -> DataFrame:
    """(path, action, reject_reason) for every unsafe path, written or removed."""
    every = files.select("path", F.lit("write").alias("action")).unionByName(
        removed.select("path", F.lit("remove").alias("action"))
    )
    return every.withColumn("reject_reason", identity.path_problem(F.col("path"))).where(
        F.col("reject_reason").isNotNull()
    )


def require_safe_paths(files: DataFrame, removed: DataFrame) -> None:
    """Raise for unsafe paths. A message shows the first; all are kept as a table in the shared folder."""
    bad = path_rejects(files, removed)
    if bad.isEmpty():
        return
    bad = settled(bad)
    shown = bad.orderBy("path", "action").limit(SHOWN).collect()
    named = "; ".join(f"{r.reject_reason}: {r.path!r}" for r in shown)
    raise PathError(f"{bad.count()} unsafe paths: {named}", bad)


def listing_failures(listing: DataFrame) -> DataFrame:
    """K8: branches whose listing says of itself that it is partial."""
    return listing.groupBy("branch").agg(F.bool_and("complete").alias("complete")).where(
        ~F.col("complete")
    ).select("branch")


def require_complete_listing(listing: DataFrame) -> None:
    partial = listing_failures(listing)
    if partial.isEmpty():
        return
    partial = settled(partial)
    names = ", ".join(r.branch for r in partial.orderBy("branch").limit(SHOWN).collect())
    raise PartialListingError(f"base listing is incomplete for {partial.count()} branches: {names}", partial)


def action_plan(files: DataFrame, removed: DataFrame, base: DataFrame, base_path: str = "") -> DataFrame:
    """K5: (path, action, content) as one commit against the paths on `base`.

    A removal of a path that is not on the base is no action. Paths must be safe.
    """
    target = identity.joined_path(base_path, F.col("path"))
    on_base = base.select("path").distinct().withColumn("present", F.lit(True))
    writes = (
        files.select(target.alias("path"), "content")
        .join(on_base, "path", "left")
        .select("path", F.when(F.col("present"), "update").otherwise("create").alias("action"), "content")
    )
    deletes = (
        removed.select(target.alias("path"))
        .join(on_base, "path", "left_semi")
        .select("path", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("content"))
    )
    return writes.unionByName(deletes)


def nothing_to_do(plan: DataFrame, base: str, branch: str) -> bool:
    """K5: no action, and the branch already is its own base."""
    return base == branch and plan.isEmpty()


def open_base(proposals: DataFrame, branch: str, default: str) -> str:
    """K6: an open proposal builds on its own branch, a new one on the default branch."""
    is_open = not proposals.where((F.col("branch") == branch) & (F.col("state") == "open")).isEmpty()
    return branch if is_open else default


def accumulate(state: DataFrame, branch: str, base: str, files: DataFrame, removed: DataFrame) -> DataFrame:
    """K6: the branch's tree after this proposal, as (branch, path, content)."""
    touched = files.select("path").unionByName(removed.select("path")).distinct()
    kept = state.where(F.col("branch") == base).join(touched, "path", "left_anti")
    tree = kept.select("path", "content").unionByName(files.select("path", "content"))
    return tree.select(F.lit(branch).alias("branch"), "path", "content")


def upsert_proposal(proposals: DataFrame, branch: str, run_id: str) -> DataFrame:
    """K6: exactly one open proposal per branch."""
    others = proposals.where(~((F.col("branch") == branch) & (F.col("state") == "open")))
    now = proposals.sparkSession.createDataFrame(
        [(branch, "open", run_id)], "branch string, state string, run_id string"
    )
    return others.unionByName(now)


# ---------------------------------------------------------------- summary


def _rank(section: Column) -> Column:
    ranked = F.when(section == SECTIONS[0], 1)
    for i, name in enumerate(SECTIONS[1:], start=2):
        ranked = ranked.when(section == name, i)
    return ranked


def summary_lines(summary: DataFrame) -> DataFrame:
    """K7: the rendered summary as (section_rank, line_rank, line).

    Ordered by these three columns the lines are the document. Sections without items
    do not appear. Items stay rows, so a summary of any size renders in parallel.
    """
    items = summary.select(
        _rank(F.col("section")).alias("section_rank"),
        F.lit(3).alias("line_rank"),
        F.concat(F.lit("- "), "item").alias("line"),
    )
    present = summary.select("section").distinct()
    heads = present.select(
        _rank(F.col("section")).alias("section_rank"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("r"), F.lit("").alias("t")),
                F.struct(F.lit(2).alias("r"), F.concat(F.lit("## "), "section").alias("t")),
            )
        ).alias("h"),
    ).select("section_rank", F.col("h.r").alias("line_rank"), F.col("h.t").alias("line"))
    title = summary.sparkSession.createDataFrame(
        [(0, 0, "# Proposed change")], "section_rank int, line_rank int, line string"
    )
    return title.unionByName(heads).unionByName(items)


def write_summary(summary: DataFrame, folder: str) -> None:
    """K7: part files that, read in name order, are the summary document."""
    ordered = summary_lines(summary).orderBy("section_rank", "line_rank", "line")
    ordered.select("line").write.mode("overwrite").text(folder)


# ---------------------------------------------------------------- bundle


def write_bundle_table(files: DataFrame, removed: DataFrame, summary: DataFrame, out_dir: str) -> str:
    """K4: the proposal as tables; works on any file system Spark writes to."""
    require_safe_paths(files, removed)
    files.write.mode("overwrite").parquet(f"{out_dir}/files")
    removed.write.mode("overwrite").parquet(f"{out_dir}/removed")
    write_summary(summary, f"{out_dir}/summary")
    return out_dir


def write_bundle_files(files: DataFrame, removed: DataFrame, summary: DataFrame, out_dir: str) -> str:
    """K4: one file per concept under a folder that every executor mounts.

    Each task writes its own rows through a temporary name, so a retried task repeats
    its writes and leaves the same tree. Deleting an absent file is no error.
    """
    require_safe_paths(files, removed)
    os.makedirs(out_dir, exist_ok=True)

    def put(rows) -> None:
        for row in rows:
            dest = os.path.join(out_dir, row.path)
            os.makedirs(os.path.dirname(dest), exist_ok=True)
            partial = f"{dest}.{os.getpid()}.partial"
            with open(partial, "w", encoding="utf-8", newline="") as handle:
                handle.write(row.content)
            os.replace(partial, dest)

    def drop(rows) -> None:
        for row in rows:
            try:
                os.remove(os.path.join(out_dir, row.path))
            except FileNotFoundError:
                pass

    clean = identity.joined_path("", F.col("path")).alias("path")
    files.select(clean, "content").foreachPartition(put)
    removed.select(clean).foreachPartition(drop)
    write_summary(summary, os.path.join(out_dir, "_summary"))
    return out_dir
