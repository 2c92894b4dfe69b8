"""The generic run (C5): fetch, diff, scope, assemble, gate, publish, advance."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changes as ch
from tidemark.operators import concepts as cn
from tidemark.operators import grounding as gr
from tidemark.operators import laws, prose, scope
from tidemark.operators.joins import guarded_broadcast
from tidemark.plans.state import ConcurrentRunError, Cursor, State, Version, new_run_id
from tidemark.schema import SUBJECT_MAP

SAMPLE = 20  # failures shown in an outcome; the whole table stays on disk


class ConfigError(RuntimeError):
    """A source or publisher refused its configuration before any reading."""


class _WithTable(RuntimeError):
    """Carries the number of failures and the table that has all of them."""

    def __init__(self, message: str, total: int = 0, table: str = "") -> None:
        super().__init__(message)
        self.total, self.table = total, table


class SelectionError(RuntimeError):
    """A selection could not be read; `rows` has every reason."""

    def __init__(self, rows: DataFrame) -> None:
        super().__init__("selection responses could not be read")
        self.rows = rows


class FetchContractError(_WithTable):
    """A fetch is not identifiable, or claims coverage it does not have."""


class MapError(ConfigError, _WithTable):
    """The operator's subject map has rows of the wrong shape."""


class StabilityError(_WithTable):
    """A normaliser gave two results for one input; the table names the documents."""


class GeneratorError(_WithTable):
    """A prose generator returned an empty field."""


@dataclass(frozen=True)
class Fetch:
    records: DataFrame
    payload: dict = field(default_factory=dict)
    complete: bool = True
    #: What landed and could not be read, kept beside the fetch as a table.
    rejects: DataFrame | None = None


class Source(Protocol):
    """Where records come from. `normalize` is pure and reads no clock."""

    name: str

    def problems(self, config: dict) -> list[str]: ...

    def fetch(self, spark: SparkSession, config: dict, cursor: Cursor | None) -> Fetch: ...

    def normalize(self, records: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Proposal:
    """One reviewable change set, as tables."""

    run_id: str
    branch: str
    files: DataFrame
    removed: DataFrame
    concepts: DataFrame
    summary: DataFrame
    sources_changed: DataFrame


class Publisher(Protocol):
    """Puts a proposal up for review. There is no way to merge one."""

    def problems(self, config: dict) -> list[str]: ...

    def publish(self, proposal: Proposal, config: dict) -> str: ...


@dataclass(frozen=True)
class NoOp:
    stage_ms: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Aborted:
    failures: list[tuple[str, str, str]]
    total: int
    table: str
    stage_ms: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Published:
    url: str
    version: int
    counts: dict[str, int] = field(default_factory=dict)
    stage_ms: dict[str, int] = field(default_factory=dict)


class _Clock:
    def __init__(self, observer: Callable[[str, dict], None] | None) -> None:
        self.ms: dict[str, int] = {}
        self._last = time.monotonic()
        self._observer = observer

    def mark(self, stage: str, **facts: object) -> None:
        """Stage timings and sizes, also handed to an observer."""
        now = time.monotonic()
        self.ms[stage] = int((now - self._last) * 1000)
        self._last = now
        if self._observer:
            self._observer(stage, {"ms": self.ms[stage], **facts})


def _light(df: DataFrame) -> DataFrame:
    """Everything but the prose: what scoping, resolution and laws need."""
    return df.drop("text", "title", "structured", "opaque_keys")


def run(
    spark: SparkSession,
    source: Source,
    publisher: Publisher,
    *,
    config: dict,
    state_root: str,
    publish_config: dict | None = None,
    generator: prose.Verbatim | prose.Generator | None = None,
    subject_map: DataFrame | None = None,
    max_grounding_docs: int | None = None,
    extra_laws: list[laws.Law] | None = None,
    check_stability: bool = True,
    run_id: str | None = None,
    observer: Callable[[str, dict], None] | None = None,
) -> NoOp | Aborted | Published:
    """One run over one source. State moves only after the publisher has returned.

    Intermediate tables are written under the state folder, so that a lost executor
    costs one stage, and so that laws and publisher see the same rows.
    """
    publish_config = publish_config or {}
    generator = generator or prose.Verbatim()
    wrong = source.problems(config) + publisher.problems(publish_config)
    if wrong:
        raise ConfigError(f"{source.name}: {'; '.join(wrong)}")

    clock = _Clock(observer)
    run_id = run_id or new_run_id()
    # an id may come again: the folders of each attempt are its own
    attempt = f"{run_id}-{new_run_id()}"
    state = State(spark, state_root)
    version = state.current()

    facts: dict[str, dict] = {}

    def staged(name: str, df: DataFrame, **more: Column) -> DataFrame:
        """Write a stage and read it back; its rows are counted by the write itself."""
        seen = Observation()
        rows = F.count(F.lit(1)).alias("rows")
        folder = state.write(
            f"staging/run={attempt}/{name}", df.observe(seen, rows, *(c.alias(n) for n, c in more.items()))
        )
        facts[name] = seen.get
        return spark.read.schema(df.schema).parquet(f"{state.root}/{folder}")

    def rows_of(name: str) -> int:
        return facts[name]["rows"]

    def refuse(name: str, failures: DataFrame, column: str, error: type[_WithTable]) -> None:
        """Raise when there are failures; all of them stay in a table."""
        found = staged(name, failures)
        total = rows_of(name)
        if total:
            shown = [r[0] for r in found.select(column).orderBy(column).limit(SAMPLE).collect()]
            table = f"{state.root}/staging/run={attempt}/{name}"
            raise error(f"{source.name}: {total} failures in {table}: {'; '.join(shown)}", total, table)

    if subject_map is not None:
        problems = gr.subject_map_problems(subject_map, max_grounding_docs)
        refuse("map_problems", problems, "problem", MapError)

    def staging(prefix: str) -> Callable[[DataFrame], DataFrame]:
        """`settle` for operators: numbered tables under one prefix."""
        numbers = itertools.count()
        return lambda df: staged(f"{prefix}_{next(numbers)}", df)

    cursor = state.cursor(version, source.name, config)
    fetch = source.fetch(spark, config, cursor)
    records = staged("records", fetch.records)
    if fetch.rejects is not None:
        staged("rejects", fetch.rejects)
    docs = staged("docs", source.normalize(records))
    clock.mark("fetch", rows=rows_of("docs"))

    if check_stability:
        again = source.normalize(spark.read.schema(records.schema).parquet(
            f"{state.root}/staging/run={attempt}/records"
        ))
        odd = staged("unstable_buckets", ch.unstable_buckets(docs, again))
        if rows_of("unstable_buckets"):
            names = ch.stability_failures(docs, again, odd)
            refuse("unstable", names, "doc_id", StabilityError)
            raise StabilityError("normalize gave other rows each time it was asked")
    refuse("fetch_failures", ch.fetch_contract_failures(docs, fetch.complete), "message", FetchContractError)
    clock.mark("fetch_laws")

    # one name and a few folders for each system; the documents never come here
    per_system = {r["system"]: r["count"] for r in docs.groupBy("system").count().collect()}
    fetched_systems = sorted(per_system)
    # a fallback and never a union: a source that moved on must not scan its old systems
    system_names = fetched_systems or sorted(cursor.systems if cursor else [])
    systems = spark.createDataFrame([(s,) for s in system_names], "system string")

    fetched = rows_of("docs")
    kinds = (ch.ADDED, ch.MODIFIED, ch.REMOVED, ch.UNCHANGED)
    # a document of one system can only sit in that system's folder
    found = ch.diff(docs, state.mirror(version, fetched_systems), fetched)
    changes = staged("changes", found, **{k: F.count_if(F.col("kind") == k) for k in kinds})
    counts = {k: facts["changes"][k] for k in kinds}
    is_noop = counts[ch.ADDED] + counts[ch.MODIFIED] + counts[ch.REMOVED] == 0
    scan = gr.scan_needed(generator.grounds, subject_map, docs, state.lineage(version))
    tracking = scan or state.tracks(version)
    clock.mark("diff", **counts)

    def ended(outcome: str, failures: int = 0) -> None:
        state.write_outcome(
            attempt, (run_id, source.name, outcome, *counts.values(), failures, dict(clock.ms))
        )

    if is_noop and not scan:
        ended("no-op")
        return NoOp(clock.ms)

    mirror = state.mirror(version)
    own_mirror = state.mirror(version, system_names)
    light_docs = _light(docs)
    # identities of every system; each reader prunes it to the few columns it needs
    targets = ch.overlay(_light(mirror), light_docs, fetched)

    def cited_documents(declared: DataFrame) -> DataFrame:
        """Overlay of the buckets that declared ids lie in."""
        ids = declared.select(F.col("grounding_id").alias("doc_id"))
        return ch.overlay(_light(state.holding(version, "mirror", ids, "doc_id")), light_docs, fetched)

    moved = drift = candidates = None
    known_map = own_map = None
    if tracking:
        moved = staged("moved", gr.movements(docs, state.mirror(version, fetched_systems), fetched))
    if scan:
        none = spark.createDataFrame([], SUBJECT_MAP)
        named = none if subject_map is None else subject_map.where(F.col("grounding_id").isNotNull())
        of_ours = gr.identity.system_of(F.col("owner_id")) == F.col("system")
        own_map = staged("map", named.select(*SUBJECT_MAP.fieldNames()).join(F.broadcast(systems), of_ours, "left_semi").distinct())
        known_map = state.scanned_map(version, system_names, max_grounding_docs)
        pool = own_mirror
        if known_map is not None:
            # only what may have drifted is looked at; a first scan looks at everything
            moves = staged("map_moves", gr.map_moves(known_map, own_map))
            targeted = moved.where("target and not deleted").select("doc_id")
            asked = staged(
                "asked",
                gr.doubtful(
                    state.suspects(version, system_names),
                    state.holding(version, "cited", targeted.select(F.col("doc_id").alias("grounding_id")), "grounding_id"),
                    moved, systems, moves, rows_of("moved"),
                ),
            )
            pool = state.holding(version, "mirror", asked, "doc_id").join(
                guarded_broadcast(asked, rows_of("asked")), "doc_id", "left_semi"
            )
        candidates = staged("candidates", scope.drift_candidates(pool, docs, systems, changes, fetched))
        if rows_of("candidates"):
            kept_now, _ = gr.resolve(
                candidates, subject_map, cited_documents, max_grounding_docs, staging("drift")
            )
            recorded = state.lineage(version, system_names)
            if known_map is not None:
                recorded = state.holding(version, "lineage", candidates.select(F.col("doc_id").alias("owner_id")), "owner_id")
            drift = staged("drift", gr.drifted(candidates, recorded, kept_now))
    looked = rows_of("candidates") if candidates is not None else 0
    clock.mark("drift", candidates=looked, drifted=rows_of("drift") if drift is not None else 0)
    if is_noop and (drift is None or not rows_of("drift")):
        ended("no-op")
        return NoOp(clock.ms)

    referring = None
    if counts[ch.REMOVED]:
        referring = staged("referrers", scope.referrers(own_mirror, systems, changes, counts[ch.REMOVED], fetched))
    work = staged("work", scope.work_list(changes, drift, referring))
    n_work = rows_of("work")

    def pick(df: DataFrame, origins: list[int]) -> DataFrame:
        ids = work.where(F.col("origin").isin(origins)).select("doc_id")
        return df.join(guarded_broadcast(ids, n_work), "doc_id", "left_semi")

    # a referrer is rebuilt from its published copy, everything else from this run's
    items = staged(
        "items",
        pick(docs.where(~F.col("deleted")), [scope.FETCHED, scope.DRIFTED])
        .unionByName(
            pick(own_mirror, [scope.DRIFTED]).join(
                guarded_broadcast(docs.where(~F.col("deleted")).select("doc_id"), fetched),
                "doc_id", "left_anti",
            )
        )
        .unionByName(pick(own_mirror, [scope.REFERRING])),
    )
    clock.mark("scope", work=n_work)

    def abort(name: str, failures: DataFrame) -> Aborted | None:
        found = staged(name, failures)
        total = rows_of(name)
        if not total:
            return None
        ended("aborted", total)
        shown = found.orderBy("path", "law", "message").limit(SAMPLE).collect()
        return Aborted([tuple(r) for r in shown], total, f"{state.root}/staging/run={attempt}/{name}", clock.ms)

    stop = abort(
        "scope_failures",
        scope.path_collisions(
            targets,
            staging("contested"),
            changes.where(F.col("kind") == ch.ADDED).select("doc_id"),
            counts[ch.ADDED],
        ).unionByName(scope.cross_system_relations(items)),
    )
    if stop:
        return stop

    kept = declared = None
    notes: list[DataFrame] = []
    if generator.grounds:
        kept_df, resolve_notes = gr.resolve(
            items, subject_map, cited_documents, max_grounding_docs, staging("resolve")
        )
        kept = staged("kept", kept_df)
        declared = gr.declared_ids(items, subject_map)
        notes.append(resolve_notes.select("note"))

    if isinstance(generator, prose.Generator):
        blocks = None
        if kept is not None:
            wanted = guarded_broadcast(
                kept.select(F.col("grounding_id").alias("doc_id")).distinct(), rows_of("kept")
            )
            texts = ch.overlay(
                mirror.select("doc_id", "text", "deleted"), docs.select("doc_id", "text", "deleted"), fetched
            ).join(wanted, "doc_id", "left_semi")
            blocks = prose.grounding_blocks(kept, texts, generator.max_source_chars)
        prompted = staged("prompts", prose.prompts(items, blocks, generator.max_source_chars))
        notes.append(prompted.select(F.explode("notes").alias("note")))
        # written before anything reads it: a generator need not answer alike twice
        written = staged("prose", prose.generate(prompted, generator))
        bad = prose.prose_rejects(written)
        named = bad.select(F.concat_ws(": ", "doc_id", "reject_reason").alias("message"))
        refuse("prose_rejects", named, "message", GeneratorError)
        body = prose.finished(written)
    else:
        body = None

    # only the targets of this run's links are asked about
    links = cn.link_targets(items).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    asked_paths = staged("link_targets", links, links=F.sum("n")).select("path")
    n_links = facts["link_targets"]["links"] or 0
    existing = staged(
        "existing", ch.known_paths(own_mirror, docs, systems, changes, asked_paths, n_links)
    )
    assembled = staged(
        "assembled",
        cn.assemble(items, body, existing, generator.actor, kept, n_links, staging("assembly")),
    )
    files, concepts = cn.files_of(assembled), cn.projection_of(assembled)
    removed = ch.removed_paths(changes)
    notes += scope.explanatory_notes(drift, referring, files)
    summary = staged("summary", cn.summary(changes, notes))
    clock.mark("assemble", files=rows_of("assembled"), links=n_links)

    stop = abort("failures", laws.gate(files, concepts, removed, existing, extra_laws, n_links))
    if stop:
        return stop
    clock.mark("gate")

    branch = scope.branch(work, ch.removed_ids(changes)).first()["branch"]
    proposal = Proposal(
        run_id, branch, files, removed, concepts, summary, cn.sources_changed(items)
    )
    if state.current().number != version.number:
        raise ConcurrentRunError("another run committed meanwhile; nothing was published")
    url = publisher.publish(proposal, publish_config)
    clock.mark("publish")

    tables, rows, plan = state.write_mirror(version, attempt, docs, per_system, fetched)
    if tracking:
        removed_now = ch.removed_ids(changes)
        decisions = gr.lineage_decisions(work, files, declared, kept, removed_now)
        looked_at = None
        if scan:
            light_items = items.select("doc_id", "grounded_by")
            seen = candidates.select("doc_id", "grounded_by").join(light_items, "doc_id", "left_anti").unionByName(light_items)
            looked_at = gr.declarations(seen, subject_map)
        news = staged("tracking", gr.tracking_news(decisions, looked_at, removed_now))

        def settle(name: str, df: DataFrame) -> tuple[DataFrame, int]:
            return staged(name, df), rows_of(name)

        state.write_tracked(version, attempt, tables, rows, plan, news, rows_of("tracking"), settle)
        # a tombstoned target keeps its copy in this run's overlay: its owners are for the next one
        outside = ~F.col("system").isin(system_names) if scan else F.lit(True)
        hits = gr.citing(
            state.holding(Version(0, tables), "cited", moved.select(F.col("doc_id").alias("grounding_id")), "grounding_id"),
            moved.where("target"), rows_of("moved"),
        ).withColumn("system", gr.identity.system_of(F.col("doc_id"))).where(outside).select("doc_id")
        later = [hits]
        if scan:
            later.append(gr.citing(
                state.holding(Version(0, tables), "cited", removed_now.select(F.col("doc_id").alias("grounding_id")), "grounding_id"),
                removed_now, counts[ch.REMOVED],
            ))
            later.append(work.select("doc_id").join(decisions.select(F.col("owner_id").alias("doc_id")), "doc_id", "left_anti"))
        else:
            later += [moved.where("owner").select("doc_id"), work.select("doc_id")]
        fresh = staged("suspects", reduce(DataFrame.unionByName, later).distinct())
        if rows_of("suspects") or scan:
            state.write_suspects(version, attempt, tables, fresh, system_names if scan else [])
        if scan and (known_map is None or rows_of("map_moves")):
            state.write_scan(attempt, tables, system_names, max_grounding_docs, own_map)
    tables["cursors"] = state.write_cursor(
        version, attempt, source.name, config, fetch.payload, system_names
    )
    clock.mark("advance")
    row = (run_id, source.name, "published", *counts.values(), 0, dict(clock.ms))
    tables["runs"] = state.write_run(version, attempt, row)
    committed = state.commit(version, tables, rows)
    return Published(url, committed.number, counts, clock.ms)
