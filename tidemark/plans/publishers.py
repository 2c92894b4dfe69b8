"""Publishers (E2): a dry run into a folder, and review branches kept as tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.operators import publish as pb
from tidemark.plans.run import Proposal
from tidemark.plans.state import Snapshots, Version, new_run_id

#: Files a bucket of a branch's tree holds before its buckets double.
BUCKET_FILES = 100_000

_TREE = "path string, content string"
_PROPOSALS = "branch string, state string, run_id string"


class DryRun:
    """K4: writes the proposal to a folder, as files or as tables."""

    def __init__(self, as_tables: bool = False) -> None:
        self.as_tables = as_tables

    def problems(self, config: dict) -> list[str]:
        return [] if config.get("out_dir") else ["'out_dir' is required"]

    def publish(self, proposal: Proposal, config: dict) -> str:
        out = f"{config['out_dir'].rstrip('/')}/{proposal.branch.replace('/', '-')}"
        write = pb.write_bundle_table if self.as_tables else pb.write_bundle_files
        return write(proposal.files, proposal.removed, proposal.summary, out)


class ReviewBranches:
    """K5/K6/K8: one open proposal per branch; a run builds on it while it is open.

    Only proposals are ever written. Accepting one is somebody else's decision.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.store = Snapshots(spark, root)

    def problems(self, config: dict) -> list[str]:
        return []

    @staticmethod
    def _prefix(branch: str) -> str:
        return "tree/" + hashlib.sha256(branch.encode("utf-8")).hexdigest()[:16]

    def _buckets(self, version: Version, branch: str) -> dict[int, str]:
        """Names of a branch's tables, `tree/<branch>/<buckets>/<bucket>`, by bucket."""
        prefix = self._prefix(branch) + "/"
        return {int(n.split("/")[3]): n for n in version.tables if n.startswith(prefix)}

    def _read(self, version: Version, branch: str, only: set[int] | None = None) -> DataFrame:
        names = [n for b, n in self._buckets(version, branch).items() if only is None or b in only]
        folders = sorted(f"{self.store.root}/{version.tables[n]}" for n in names)
        schema = self._schema(_TREE)
        files = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return files.select(F.lit(branch).alias("branch"), "path", "content")

    def tree(self, branch: str):
        return self._read(self.store.current(), branch)

    def listing(self, tree: DataFrame, base: str, config: dict) -> DataFrame:
        """K8: `(branch, path, complete)` of the base, asked for before every plan.

        A reviewer's own listing may be passed, with or without paths. Ours is complete, as a commit
        names every bucket of a tree.
        """
        ours = tree.select("branch", "path", F.lit(True).alias("complete"))
        given = config.get("listing")
        if given is None:
            return ours
        if "path" in given.columns:
            return given.select("branch", "path", "complete").where(F.col("branch") == base)
        marks = given.select("branch", F.lit(None).cast("string").alias("path"), "complete")
        return ours.unionByName(marks)

    def proposals(self):
        version = self.store.current()
        return self.store.read(version.tables.get("proposals"), self._schema(_PROPOSALS))

    def _schema(self, ddl: str):
        return self.spark.createDataFrame([], ddl).schema

    def publish(self, proposal: Proposal, config: dict) -> str:
        pb.require_safe_paths(proposal.files, proposal.removed)
        attempt = f"{proposal.run_id}-{new_run_id()}"
        version = self.store.current()
        branch = config.get("branch") or proposal.branch
        base = pb.open_base(self.proposals(), branch, config.get("base", "main"))
        mine = self._buckets(version, base)
        before = next((int(n.split("/")[2]) for n in mine.values()), 1)
        have = sum(version.rows.get(n, 0) for n in mine.values())
        buckets, more = before, proposal.files.count()
        while have + more > 2 * buckets * BUCKET_FILES:
            buckets *= 2

        def home(path: Column) -> Column:
            return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")

        target = identity.joined_path(config.get("base_path", ""), F.col("path"))
        asked = proposal.files.select(target.alias("path")).unionByName(proposal.removed.select(target.alias("path")))
        touched = {r[0] for r in asked.select(home(F.col("path"))).distinct().collect()}
        # a tree that grows is dealt anew; else only buckets with a path of this proposal are read
        old = None if buckets != before else touched
        tree = self._read(version, base, old)
        # a plan against half a listing would write what is there and miss what is not
        listing = self.listing(tree, base, config)
        pb.require_complete_listing(listing)
        plan = pb.action_plan(proposal.files, proposal.removed, listing, config.get("base_path", ""))
        url = f"{self.store.root}#{branch}"
        if pb.nothing_to_do(plan, base, branch):
            return url
        after = pb.accumulate(
            tree,
            branch,
            base,
            plan.where(F.col("action") != "delete").select("path", "content"),
            plan.where(F.col("action") == "delete").select("path"),
        )
        folder = f"{self._prefix(branch)}/run={attempt}"
        self.store.write(folder, after.select("path", "content", home(F.col("path")).alias("bucket")), "bucket")
        tables = {n: f for n, f in version.tables.items() if not n.startswith(self._prefix(branch) + "/")}
        rows = {n: c for n, c in version.rows.items() if n in tables}
        for bucket, name in mine.items():
            if old is not None and bucket not in touched:
                # a proposal shares what it leaves as it is with its base
                own = f"{self._prefix(branch)}/{buckets}/{bucket}"
                tables[own], rows[own] = version.tables[name], version.rows.get(name, 0)
        written = self.spark.read.schema(f"{_TREE}, bucket int").parquet(f"{self.store.root}/{folder}")
        for r in written.groupBy("bucket").count().collect():
            own = f"{self._prefix(branch)}/{buckets}/{r.bucket}"
            tables[own], rows[own] = f"{folder}/bucket={r.bucket}", r["count"]
        tables["proposals"] = self.store.write(
            f"proposals/run={attempt}",
            pb.upsert_proposal(self.proposals(), branch, proposal.run_id).coalesce(1),
        )
        pb.write_summary(proposal.summary, f"{self.store.root}/summaries/run={attempt}")
        self.store.commit(version, tables, rows)
        return url
