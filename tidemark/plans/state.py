"""Versioned snapshots of mirror, lineage, cursors and runs.

Tables are plain Parquet folders. A commit file names the folder of every table, so all
of them move to the next version together; it is created only if nobody else created
that version. Nothing a reader can see is ever overwritten.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import identity
from tidemark.operators import changes, grounding
from tidemark.operators.joins import guarded_broadcast
from tidemark.schema import (
    CITED, CURSORS, DOCUMENT_COLUMNS, DOCUMENTS, LINEAGE, RUNS, SUBJECT_MAP, SUSPECTS, TRACKED,
)


CODEC = "zstd"


class ConcurrentRunError(RuntimeError):
    """Another run committed first; this one changed nothing and may be repeated."""


def new_run_id() -> str:
    return uuid.uuid4().hex[:16]


def scope_of(system: str) -> str:
    """Folder name of a system's part of the mirror; safe for any system name."""
    return "s" + hashlib.sha256(system.split(":", 1)[0].encode("utf-8")).hexdigest()[:15]


def instance_key(config: dict) -> str:
    """8 hex digits, so that two configurations of one source keep two cursors."""
    canonical = json.dumps(config, sort_keys=True, default=str)
    return hashlib.sha256(canonical.encode("utf-8")).hexdigest()[:8]


def _scope(key: str):
    digest = F.sha2(identity.system_of(F.col(key)), 256)
    return F.concat(F.lit("s"), F.left(digest, F.lit(15)))


def buckets_of(version: Version, kind: str = "mirror") -> list[str]:
    return [n for n in version.tables if n.startswith(f"{kind}/")]


def plan_of(version: Version, kind: str) -> dict[str, int]:
    """Buckets that each scope of a table has."""
    return {n.split("/")[1]: int(n.split("/")[2]) for n in buckets_of(version, kind)}


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: dict[str, str] = field(default_factory=dict)
    #: Rows of each bucket, counted when it was written.
    rows: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Cursor:
    payload: dict = field(default_factory=dict)
    systems: list[str] = field(default_factory=list)


class Snapshots:
    """Named Parquet folders under one root, switched together by numbered commits."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def subfolders(self, name: str) -> list[str]:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())

    def current(self) -> Version:
        fs, folder = self._fs(), self._path("commits")
        if not fs.exists(folder):
            return Version()
        names = sorted(
            s.getPath().getName()
            for s in fs.listStatus(folder)
            if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("_")
        )
        if not names:
            return Version()
        stream = fs.open(self._path(f"commits/{names[-1]}"))
        try:
            body = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        record = json.loads(body)
        return Version(record["version"], record["tables"], record.get("rows", {}))

    def read(self, folder: str | None, schema: T.StructType) -> DataFrame:
        if not folder:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")

    def write(self, folder: str, df: DataFrame, *partition_by: str) -> str:
        """Write a new folder, never over an old one. A hot partition value is split over tasks.

        A run writes each text several times, so the codec is one that makes texts small.
        """
        if not partition_by:
            df.write.mode("error").option("compression", CODEC).parquet(f"{self.root}/{folder}")
        else:
            (
                df.hint("rebalance", *partition_by)
                .write.mode("error")
                .option("compression", CODEC)
                .partitionBy(*partition_by)
                .parquet(f"{self.root}/{folder}")
            )
        return folder

    def commit(self, base: Version, tables: dict[str, str], rows: dict[str, int] | None = None) -> Version:
        """Make `tables` the next version, or fail when `base` is no longer current."""
        nxt = Version(base.number + 1, tables, rows or {})
        fs = self._fs()
        fs.mkdirs(self._path("commits"))
        draft = self._path(f"commits/_{uuid.uuid4().hex}.draft")
        final = self._path(f"commits/{nxt.number:012d}.json")
        stream = fs.create(draft, True)
        try:
            body = json.dumps({"version": nxt.number, "tables": tables, "rows": nxt.rows}, sort_keys=True)
            stream.write(bytearray(body.encode("utf-8")))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            draft.getFileSystem(self._conf).getUri(), self._conf
        )
        no_overwrite = self.spark.sparkContext._gateway.new_array(
            self._jvm.org.apache.hadoop.fs.Options.Rename, 0
        )
        try:
            context.rename(draft, final, no_overwrite)
        except Exception as exc:
            fs.delete(draft, False)
            if fs.exists(final):
                raise ConcurrentRunError(f"version {nxt.number} was committed by another run") from exc
            raise
        return nxt


def scan_name(system: str, limit: int | None) -> str:
    return f"scan/{scope_of(system)}/{'all' if limit is None else limit}"


def _within(names: list[str], systems: list[str] | None) -> list[str]:
    wanted = None if systems is None else {scope_of(s) for s in systems}
    return [n for n in names if wanted is None or n.split("/")[1] in wanted]


class State(Snapshots):
    """The tables a run reads and advances.

    Three of them are cut into buckets named `<table>/<system>/<buckets>/<bucket>`, and an id
    says which bucket is its own: `mirror` by document; `lineage` by owner, in the mirror's
    buckets, with what was recorded and declared; `cited`, its inverse, from an id to the
    owners that declare it. `suspects` lists owners to look at again, one folder for each
    system, and `scan/<system>/<limit>` holds the operator's map as the last scan saw it.
    """

    #: Rows a bucket holds before the system's buckets double.
    bucket_rows = 100_000

    def mirror(self, version: Version, systems: list[str] | None = None) -> DataFrame:
        """Live documents, only of the given systems' folders where named.

        Column pruning does the rest: a diff reads the id and hash columns only.
        """
        return self._folders(version, _within(buckets_of(version), systems), DOCUMENTS)

    def _folders(self, version: Version, names: list[str], schema: T.StructType = DOCUMENTS) -> DataFrame:
        folders = [f"{self.root}/{version.tables[n]}" for n in sorted(names)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def tracked(self, version: Version, systems: list[str] | None = None) -> DataFrame:
        """What each owner declared and what its last rebuild recorded."""
        return self._folders(version, _within(buckets_of(version, "lineage"), systems), TRACKED)

    def lineage(self, version: Version, systems: list[str] | None = None) -> DataFrame:
        rows = self.tracked(version, systems).where(F.col("recorded").isNotNull())
        return rows.select(*LINEAGE.fieldNames())

    def cited(self, version: Version) -> DataFrame:
        return self._folders(version, buckets_of(version, "cited"), CITED)

    def suspects(self, version: Version, systems: list[str] | None = None) -> DataFrame:
        """Owners that something may have happened to since they were last looked at."""
        return self._folders(version, _within(buckets_of(version, "suspects"), systems), SUSPECTS)

    def tracks(self, version: Version) -> bool:
        """Whether any system was ever scanned for drift."""
        return bool(buckets_of(version, "scan"))

    def scanned_map(self, version: Version, systems: list[str], limit: int | None) -> DataFrame | None:
        """The operator's map as the last scan of these systems saw it; None where one had no scan under this limit."""
        names = [scan_name(s, limit) for s in systems]
        if not names or any(n not in version.tables for n in names):
            return None
        return self._folders(version, [n for n in names if version.tables[n]], SUBJECT_MAP)

    def cursors(self, version: Version) -> DataFrame:
        return self.read(version.tables.get("cursors"), CURSORS)

    def runs(self, version: Version) -> DataFrame:
        return self.read(version.tables.get("runs"), RUNS)

    def cursor(self, version: Version, source: str, config: dict) -> Cursor | None:
        """This configuration's cursor, else a legacy one without its systems."""
        key = instance_key(config)
        rows = (
            self.cursors(version)
            .where((F.col("source") == source) & (F.col("instance_key").eqNullSafe(key) | F.col("instance_key").isNull()))
            .collect()
        )
        own = [r for r in rows if r.instance_key == key]
        if own:
            return Cursor(json.loads(own[0].payload or "{}"), list(own[0].systems or []))
        if rows:
            return Cursor(json.loads(rows[0].payload or "{}"), [])
        return None

    # ------------------------------------------------------------ buckets

    def _placed(self, df: DataFrame, key: str, plan: dict[str, int]) -> DataFrame:
        counts = self.spark.createDataFrame(sorted(plan.items()), "scope string, buckets int")
        return (
            df.withColumn("scope", _scope(key))
            .join(F.broadcast(counts), "scope", "left")
            .withColumn("buckets", F.coalesce("buckets", F.lit(1)))
            .withColumn("bucket", F.pmod(F.xxhash64(key), F.col("buckets")))
        )

    def _names(self, ids: DataFrame, key: str, kind: str, plan: dict[str, int]) -> set[str]:
        """Buckets that these ids belong to: a name for each bucket, and no id, comes to the driver."""
        own = self._placed(ids.select(key), key, plan).select("scope", "buckets", "bucket").distinct()
        return {f"{kind}/{r.scope}/{r.buckets}/{r.bucket}" for r in own.collect()}

    def holding(self, version: Version, kind: str, ids: DataFrame, key: str) -> DataFrame:
        """The buckets of a table that may hold `ids`, and no others."""
        schema = {"mirror": DOCUMENTS, "lineage": TRACKED, "cited": CITED}[kind]
        if not buckets_of(version, kind):
            return self.spark.createDataFrame([], schema)
        wanted = self._names(ids, key, kind, plan_of(version, kind))
        return self._folders(version, [n for n in wanted if n in version.tables], schema)

    def _rewrite(
        self, tables: dict, rows: dict, attempt: str, kind: str, key: str, schema: T.StructType,
        plan: dict[str, int], touched: set[str], after: DataFrame,
    ) -> None:
        """Put the written rows of `after` in place of the touched buckets; all others keep their folders.

        Their new row counts come from the footers of what was just written.
        """
        folder = self.write(f"{kind}/run={attempt}", self._placed(after, key, plan), "scope", "buckets", "bucket")
        for name in touched:
            tables.pop(name, None)
            rows.pop(name, None)
        kinds = {"scope": T.StringType(), "buckets": T.IntegerType(), "bucket": T.LongType()}
        parts = T.StructType([*schema.fields, *(T.StructField(n, k) for n, k in kinds.items())])
        written = self.spark.read.schema(parts).parquet(f"{self.root}/{folder}")
        for r in written.groupBy("scope", "buckets", "bucket").count().collect():
            name = f"{kind}/{r.scope}/{r.buckets}/{r.bucket}"
            tables[name] = f"{folder}/scope={r.scope}/buckets={r.buckets}/bucket={r.bucket}"
            rows[name] = r["count"]

    def _grown(self, version: Version, kind: str, more: dict[str, int]) -> dict[str, int]:
        """Buckets of the scopes that get `more` rows; a scope whose buckets have filled has twice as many."""
        plan = {scope: plan_of(version, kind).get(scope, 1) for scope in more}
        for scope, extra in more.items():
            have = sum(n for name, n in version.rows.items() if name.startswith(f"{kind}/{scope}/"))
            while have + extra > 2 * plan[scope] * self.bucket_rows:
                plan[scope] *= 2
        return plan

    @staticmethod
    def _moved(version: Version, kind: str, plan: dict[str, int]) -> set[str]:
        """Buckets of scopes whose number of buckets changes."""
        old = plan_of(version, kind)
        return {n for n in buckets_of(version, kind) if plan.get(n.split("/")[1], old[n.split("/")[1]]) != old[n.split("/")[1]]}

    # ------------------------------------------------------------ advance

    def write_mirror(
        self, version: Version, attempt: str, docs: DataFrame, per_system: dict[str, int], fetched: int
    ) -> tuple[dict[str, str], dict[str, int], dict[str, int]]:
        """K1: rewrite the buckets that the fetch touches; all others carry over by name.

        Returns tables, rows of their buckets, and the bucket plan. A system's buckets double when
        they have filled, which rewrites that system once; their rows are known from the commit.
        """
        more: dict[str, int] = {}
        for system, n in per_system.items():
            more[scope_of(system)] = more.get(scope_of(system), 0) + n
        plan = plan_of(version, "mirror") | self._grown(version, "mirror", more)
        touched = self._names(docs, "doc_id", "mirror", plan) | self._moved(version, "mirror", plan)
        before = self._folders(version, [n for n in touched if n in version.tables])
        after = changes.advance_mirror(before, docs.select(*DOCUMENT_COLUMNS), fetched)
        tables, rows = dict(version.tables), dict(version.rows)
        self._rewrite(tables, rows, attempt, "mirror", "doc_id", DOCUMENTS, plan, touched, after)
        return tables, rows, plan

    def write_tracked(
        self, version: Version, attempt: str, tables: dict, rows: dict, plan: dict[str, int],
        news: DataFrame, n_news: int, settle,
    ) -> None:
        """K2: lineage in the mirror's buckets, then the inverse of what owners declare.

        Only buckets with an owner of `news` are rewritten, and of the inverse only those of ids
        whose owners are others now.
        """
        plan = plan_of(version, "lineage") | plan
        touched = self._names(news, "owner_id", "lineage", plan) | self._moved(version, "lineage", plan)
        before = self._folders(version, [n for n in touched if n in version.tables], TRACKED)
        moves, n_moves = settle("edge_moves", grounding.edge_moves(before, news, n_news))
        after = grounding.advance_tracked(before, news, n_news)
        self._rewrite(tables, rows, attempt, "lineage", "owner_id", TRACKED, plan, touched, after)
        if not n_moves:
            return
        added = moves.where("sign > 0").groupBy(_scope("grounding_id").alias("scope")).count()
        plan = plan_of(version, "cited") | self._grown(version, "cited", {r.scope: r["count"] for r in added.collect()})
        touched = self._names(moves, "grounding_id", "cited", plan) | self._moved(version, "cited", plan)
        before = self._folders(version, [n for n in touched if n in version.tables], CITED)
        after = grounding.advance_cited(before, moves, n_moves)
        self._rewrite(tables, rows, attempt, "cited", "grounding_id", CITED, plan, touched, after)

    def write_suspects(
        self, version: Version, attempt: str, tables: dict, fresh: DataFrame, cleared: list[str]
    ) -> None:
        """Add `fresh` owners to those of their systems; the systems in `cleared` keep no others."""
        named = [r[0] for r in fresh.select(_scope("doc_id").alias("scope")).distinct().collect()]
        gone = {scope_of(s) for s in cleared}
        kept = [f"suspects/{scope}" for scope in named if scope not in gone]
        old = self._folders(version, [n for n in kept if n in version.tables], SUSPECTS)
        for scope in gone:
            tables.pop(f"suspects/{scope}", None)
        if named:
            rows = old.unionByName(fresh.select("doc_id")).distinct().withColumn("scope", _scope("doc_id"))
            folder = self.write(f"suspects/run={attempt}", rows, "scope")
            tables |= {f"suspects/{scope}": f"{folder}/scope={scope}" for scope in named}

    def write_scan(self, attempt: str, tables: dict, systems: list[str], limit: int | None, own_map: DataFrame) -> None:
        """Mark these systems as scanned under `limit`, with the map that the scan saw."""
        folder = self.write(f"scan/run={attempt}", own_map.withColumn("scope", _scope("owner_id")), "scope")
        there = {p.split("=", 1)[1] for p in self.subfolders(folder)}
        for system in systems:
            scope = scope_of(system)
            for name in [n for n in tables if n.startswith(f"scan/{scope}/")]:
                del tables[name]
            # no rows, no folder: the mark alone counts
            tables[scan_name(system, limit)] = f"{folder}/scope={scope}" if scope in there else ""

    def write_outcome(self, run_id: str, row: tuple) -> None:
        """Runs that published nothing, outside the snapshot: a no-op moves no state."""
        self.write(f"outcomes/run={run_id}", self.spark.createDataFrame([row], RUNS))

    def outcomes(self) -> DataFrame:
        folders = [f"{self.root}/outcomes/{f}" for f in self.subfolders("outcomes")]
        if not folders:
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(*folders)

    def expire(self) -> list[str]:
        """Delete run folders that the current version does not name; returns their names.

        Only for a state that no run is working on: a run's own staging goes too.
        """
        named = set(self.current().tables.values())
        gone = []
        for top in ("mirror", "lineage", "cited", "suspects", "scan", "cursors", "runs", "staging"):
            for run in self.subfolders(top):
                folder = f"{top}/{run}"
                if not any(n == folder or n.startswith(f"{folder}/") for n in named):
                    self._fs().delete(self._path(folder), True)
                    gone.append(folder)
        return gone

    def write_cursor(
        self, version: Version, run_id: str, source: str, config: dict, payload: dict,
        systems: list[str],
    ) -> str:
        """K3: one row per source and configuration; systems are stamped here, sorted."""
        key = instance_key(config)
        others = self.cursors(version).where(
            ~((F.col("source") == source) & F.col("instance_key").eqNullSafe(key))
        )
        row = (source, key, json.dumps(payload, sort_keys=True), sorted(systems), run_id)
        now = self.spark.createDataFrame([row], CURSORS)
        return self.write(f"cursors/run={run_id}", others.unionByName(now).coalesce(1))

    def write_run(self, version: Version, run_id: str, row: tuple) -> str:
        now = self.spark.createDataFrame([row], RUNS)
        return self.write(f"runs/run={run_id}", self.runs(version).unionByName(now).coalesce(1))
