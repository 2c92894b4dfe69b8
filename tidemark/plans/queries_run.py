"""Registered queries: whole runs, several over one state."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.operators.changes import canonical_documents
from tidemark.operators.prose import Generator
from tidemark.plans import corpus
from tidemark.plans.corpus import sql_resolution, with_states
from tidemark.plans.publishers import ReviewBranches
from tidemark.plans.registry import query
from tidemark.plans.run import Aborted, Fetch, NoOp, Published, run
from tidemark.plans.state import State
from tidemark.session import shared_dir


class CorpusState:
    """One state of the derived corpus as a source; links stay within a system."""

    def __init__(self, docs: DataFrame, name: str = "corpus", own_links: bool = True) -> None:
        own = F.filter("relations", lambda r: identity.system_of(r) == F.col("system"))
        self._docs = docs.withColumn("relations", own) if own_links else docs
        self.name = name

    def problems(self, config: dict) -> list[str]:
        return []

    def fetch(self, spark, config, cursor) -> Fetch:
        return Fetch(self._docs)

    def normalize(self, records: DataFrame) -> DataFrame:
        return canonical_documents(records)


def run_states(spark, sf_dir, observer=None):
    """Load the mirror state, then the fetch, then the fetch again."""
    root = f"{shared_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}"
    review = ReviewBranches(spark, f"{root}/review")
    was, now = corpus.mirror(spark, sf_dir), corpus.fetch(spark, sf_dir)
    outcomes = []
    for docs in (was, now, now.where(~F.col("deleted"))):
        outcomes.append(
            run(spark, CorpusState(docs), review, config={}, state_root=f"{root}/state", observer=observer)
        )
    return outcomes, review


@query(
    "C5_run",
    with_states(
        """SELECT 1 AS step, 'Published' AS outcome, (SELECT count(*) FROM mirror) AS added, 0::BIGINT AS modified,
            0::BIGINT AS removed, (SELECT count(*) FROM mirror) AS files
        UNION ALL SELECT 2, 'Published', count(*) FILTER (kind = 'added'), count(*) FILTER (kind = 'modified'),
            count(*) FILTER (kind = 'removed'),
            (SELECT count(DISTINCT did) FROM (
              SELECT did FROM changes WHERE kind IN ('added', 'modified')
              UNION SELECT did FROM (SELECT did, system, unnest(relations) AS t FROM mirror)
                WHERE t IN (SELECT did FROM changes WHERE kind = 'removed') AND split_part(t, ':', 1) = system
                  AND did NOT IN (SELECT did FROM changes WHERE kind = 'removed')
                  AND system IN (SELECT system FROM fetched))) FROM changes
        UNION ALL SELECT 3, 'NoOp', 0, 0, 0, 0"""
    ),
)
def whole_run(spark, sf_dir):
    """Load, update, replay: two proposals and then nothing at all."""
    written = []

    def watch(stage, facts):
        if stage == "scope":
            written.append(facts["work"])

    outcomes, _ = run_states(spark, sf_dir, watch)
    rows = []
    for i, o in enumerate(outcomes, start=1):
        counts = o.counts if isinstance(o, Published) else {}
        files = 0 if isinstance(o, NoOp) else written[i - 1]
        rows.append((i, type(o).__name__, counts.get("added", 0), counts.get("modified", 0), counts.get("removed", 0), files))
    return spark.createDataFrame(
        rows, "step int, outcome string, added long, modified long, removed long, files long"
    )


# ---------------------------------------------------------------- grounded runs

#: Documents 0, 5, 10, ... declare others of sixteen other systems; nobody else declares any.
OWNER = "n % 5 = 0"


def _written(batch):
    return batch.assign(title=batch["doc_id"], description="d", body="b")


@cache
def grounded_runs(spark, sf_dir):
    """Five runs over one state, and what each told its observer.

    1. The documents that are cited, by a generator that grounds nothing. 2. Their owners, grounded.
    3. The cited documents' fetch: edits, deletions and additions. 4. The owners' next run, with nothing
    fetched: only drift can make it publish. 5. Edited owners with links that leave their system.
    """
    root = f"{shared_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}"
    number = F.regexp_extract("native_id", r"docs/(\d+)", 1).cast("bigint")

    def part(docs, owners):
        return docs.withColumn("n", number).where(OWNER if owners else f"not ({OWNER})").drop("n")

    was, now = corpus.mirror(spark, sf_dir), corpus.fetch(spark, sf_dir)
    crossing = part(was, True).where(number % 23 == 0).withColumn("text", F.concat("text", F.lit(" [rev 3]")))
    owners = CorpusState(part(was, True), "owners")
    sources = [
        (CorpusState(part(was, False), "cited"), None),
        (owners, True),
        (CorpusState(part(now, False), "cited"), None),
        (CorpusState(part(was, True).limit(0), "owners"), True),
        (CorpusState(crossing, "owners", own_links=False), True),
    ]
    told, outcomes = [], []
    for step, (source, grounds) in enumerate(sources, start=1):
        def watch(stage, facts, step=step):
            told.append((step, stage, facts))

        generator = Generator(write=_written, model="vendor/plain") if grounds else None
        outcomes.append(
            run(spark, source, ReviewBranches(spark, f"{root}/review"), config={}, state_root=f"{root}/state",
                generator=generator, check_stability=False, observer=watch)
        )
    return outcomes, told, State(spark, f"{root}/state")


# The runs cut links that leave a system, so hashes are those without them. Owners never change;
# the cited documents are as their second run left them.
_CUT = "list_filter(relations, lambda r: split_part(r, ':', 1) = system) AS relations"
_FINAL = f"""cut_mirror AS (SELECT * REPLACE ({corpus.sql_hash()} AS content_hash) FROM (SELECT * REPLACE ({_CUT}) FROM mirror)),
cut_live AS (SELECT * REPLACE ({corpus.sql_hash()} AS content_hash) FROM (SELECT * REPLACE ({_CUT}) FROM live)),
final AS (
  SELECT * FROM cut_mirror WHERE n % 5 = 0 OR did NOT IN (SELECT did FROM fetched)
  UNION ALL BY NAME SELECT * FROM cut_live WHERE n % 5 <> 0),
owner_docs AS (SELECT * FROM cut_mirror WHERE n % 5 = 0)"""
_FINAL_SETS = sql_resolution("owner_docs", "final", "end") + """,
end_sets AS (SELECT owner_id, list_sort(list(gid || '=' || content_hash)) AS entries FROM end_kept GROUP BY owner_id)"""
_FIRST_SETS = sql_resolution("owner_docs", "cut_mirror", "first") + """,
first_sets AS (SELECT owner_id, list_sort(list(gid || '=' || content_hash)) AS entries FROM first_kept GROUP BY owner_id),
grounded_drift AS (SELECT did FROM owner_docs LEFT JOIN first_sets f ON f.owner_id = did LEFT JOIN end_sets e ON e.owner_id = did
  WHERE coalesce(f.entries, []) IS DISTINCT FROM coalesce(e.entries, []))"""
_CITED_WORK = """cited_changes AS (SELECT c.*, m.relations FROM changes c LEFT JOIN mirror m USING (did) WHERE c.n % 5 <> 0),
cited_work AS (SELECT did FROM cited_changes WHERE kind IN ('added', 'modified')
  UNION SELECT did FROM (SELECT did, system, unnest(relations) AS t FROM mirror WHERE n % 5 <> 0
      AND system IN (SELECT system FROM fetched WHERE n % 5 <> 0))
    WHERE t IN (SELECT did FROM cited_changes WHERE kind = 'removed') AND split_part(t, ':', 1) = system
      AND did NOT IN (SELECT did FROM cited_changes WHERE kind = 'removed'))"""
_CROSSING = "SELECT count(*) FROM owner_docs WHERE n % 23 = 0"


@query(
    "C5_grounded_runs",
    with_states(
        f"""SELECT 1 AS step, 'Published' AS outcome, (SELECT count(*) FROM mirror WHERE n % 5 <> 0) AS changed,
            (SELECT count(*) FROM mirror WHERE n % 5 <> 0) AS work, 0::BIGINT AS drifted, 0::BIGINT AS failures
        UNION ALL SELECT 2, 'Published', count(*), count(*), 0, 0 FROM owner_docs
        UNION ALL SELECT 3, 'Published', (SELECT count(*) FROM cited_changes WHERE kind IN ('added', 'modified', 'removed')),
            (SELECT count(*) FROM cited_work), 0, 0
        UNION ALL SELECT 4, 'Published', 0, count(*), count(*), 0 FROM grounded_drift
        UNION ALL SELECT 5, 'Aborted', ({_CROSSING}), ({_CROSSING}) + count(DISTINCT owner_id), count(DISTINCT owner_id), ({_CROSSING})
          FROM end_kept WHERE gid IN (SELECT did FROM owner_docs WHERE n % 23 = 0)
            AND owner_id NOT IN (SELECT did FROM owner_docs WHERE n % 23 = 0)""",
        _FINAL,
        _FINAL_SETS,
        _FIRST_SETS,
        _CITED_WORK,
    ),
)
def grounded_outcomes(spark, sf_dir):
    """What five runs did; the last is stopped by the gate and moves nothing."""
    outcomes, told, _ = grounded_runs(spark, sf_dir)
    rows = []
    for step, outcome in enumerate(outcomes, start=1):
        facts = {stage: f for s, stage, f in told if s == step}
        changed = sum(facts["diff"][k] for k in ("added", "modified", "removed"))
        failures = outcome.total if isinstance(outcome, Aborted) else 0
        rows.append((step, type(outcome).__name__, changed, facts["scope"]["work"], facts["drift"]["drifted"], failures))
    return spark.createDataFrame(rows, "step int, outcome string, changed long, work long, drifted long, failures long")


@query(
    "K2_lineage_state",
    with_states(
        """SELECT did AS owner_id, array_to_string(coalesce(entries, []), ',') AS recorded
        FROM owner_docs LEFT JOIN end_sets ON owner_id = did""",
        _FINAL,
        _FINAL_SETS,
    ),
)
def lineage_state(spark, sf_dir):
    """K2: lineage as the runs left it, read back from its buckets."""
    _, _, state = grounded_runs(spark, sf_dir)
    entries = F.transform(
        F.array_sort(F.map_entries("recorded")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return state.lineage(state.current()).select("owner_id", F.array_join(entries, ",").alias("recorded"))


@query(
    "S13_state_mirror",
    with_states("SELECT did AS doc_id, content_hash FROM final", _FINAL),
)
def state_mirror(spark, sf_dir):
    """The snapshot that five runs left, all buckets of all systems."""
    _, _, state = grounded_runs(spark, sf_dir)
    return state.mirror(state.current()).select("doc_id", "content_hash")


@query(
    "S14_state_cursors",
    with_states(
        """SELECT source, left(sha256('{}'), 8) AS instance_key, string_agg(system, ',' ORDER BY system) AS systems FROM (
          SELECT DISTINCT 'cited' AS source, system FROM fetched WHERE n % 5 <> 0
          UNION SELECT 'owners', system FROM owner_docs) GROUP BY source""",
        _FINAL,
    ),
)
def state_cursors(spark, sf_dir):
    """What each source's cursor names; the run that fetched nothing kept its systems."""
    _, _, state = grounded_runs(spark, sf_dir)
    return state.cursors(state.current()).select("source", "instance_key", F.array_join("systems", ",").alias("systems"))


@query(
    "U4_inverse_state",
    with_states(
        "SELECT DISTINCT gid AS grounding_id, did AS owner_id FROM owner_docs, unnest(grounded_by) AS u(gid)", _FINAL
    ),
)
def inverse_state(spark, sf_dir):
    """The inverse of all declarations, read back from its buckets."""
    _, _, state = grounded_runs(spark, sf_dir)
    return state.cited(state.current())


@query(
    "X12_stage_figures",
    with_states(
        f"""SELECT 1 AS step, 'fetch' AS stage, 'rows' AS figure, count(*) AS n FROM mirror WHERE n % 5 <> 0
        UNION ALL SELECT 2, 'fetch', 'rows', count(*) FROM owner_docs
        UNION ALL SELECT 2, 'drift', 'candidates', 0
        UNION ALL SELECT 3, 'fetch', 'rows', count(*) FROM fetched WHERE n % 5 <> 0
        UNION ALL SELECT 3, 'diff', kind, count(*) FROM cited_changes WHERE kind <> 'ignored_tombstone' GROUP BY kind
        UNION ALL SELECT 4, 'drift', 'drifted', count(*) FROM grounded_drift
        UNION ALL SELECT 5, 'fetch', 'rows', ({_CROSSING})""",
        _FINAL,
        _FINAL_SETS,
        _FIRST_SETS,
        _CITED_WORK,
    ),
)
def stage_figures(spark, sf_dir):
    """Figures that each stage's own write observed, no job counts them."""
    _, told, _ = grounded_runs(spark, sf_dir)
    shown = {(1, "fetch"), (2, "fetch"), (3, "fetch"), (3, "diff"), (5, "fetch")}
    rows = [(s, stage, k, v) for s, stage, f in told for k, v in f.items() if (s, stage) in shown and k != "ms" and (stage != "diff" or v)]
    rows += [(s, stage, "drifted", f["drifted"]) for s, stage, f in told if (s, stage) == (4, "drift")]
    rows += [(s, stage, "candidates", f["candidates"]) for s, stage, f in told if (s, stage) == (2, "drift")]
    return spark.createDataFrame(rows, "step int, stage string, figure string, n long")
