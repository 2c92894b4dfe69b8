"""Which documents a run must rebuild."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.operators.changes import changed_ids, removed_ids
from tidemark.operators.joins import BROADCAST_ROWS, edges, guarded_broadcast, skew_safe_join
from tidemark.schema import failure

FETCHED, DRIFTED, REFERRING = 0, 1, 2  # origin of a work-list entry, in order

# Wording of failures and notes that a reviewer reads.
COLLISION = (
    " claim one path, and the later of two merges would replace the earlier"
)
CROSSING = "; links end in the system they start in"
REFERRER_NOTE = (
    ": rebuilt, as it linked to what this run removes; its own source is as before"
)
DRIFT_NOTE = (
    ": rebuilt, as a document of another system that it is grounded in has changed; its own source is as before"
)


def in_scope(df: DataFrame, systems: DataFrame) -> DataFrame:
    """Documents of this run's systems."""
    return df.join(systems, "system", "left_semi")


def _settled(
    mirror: DataFrame, systems: DataFrame, changes: DataFrame, touched_rows: int | None
) -> DataFrame:
    touched = changed_ids(changes).unionByName(removed_ids(changes))
    return in_scope(mirror, systems).join(
        guarded_broadcast(touched, touched_rows), "doc_id", "left_anti"
    )


def drift_candidates(
    mirror: DataFrame,
    docs: DataFrame,
    systems: DataFrame,
    changes: DataFrame,
    fetched: int | None = None,
) -> DataFrame:
    """Settled documents of this run's systems, each as this run sees it.

    A document that changed nothing but `grounded_by` is unchanged in the diff, so its
    fetched copy must stand in for the mirror's, or the edit would be compared with
    itself. Identity columns only.
    """
    cols = ["doc_id", "system", "native_id", "url", "content_hash", "grounded_by"]
    fresh = docs.where(~F.col("deleted")).select(
        "doc_id", F.struct(*cols[1:]).alias("fresh")
    )
    settled = _settled(mirror.select(*cols), systems, changes, fetched)
    joined = settled.join(guarded_broadcast(fresh, fetched), "doc_id", "left")
    return joined.select(
        "doc_id",
        *[
            F.when(F.col("fresh").isNotNull(), F.col(f"fresh.{c}")).otherwise(F.col(c)).alias(c)
            for c in cols[1:]
        ],
    )


def referrers(
    mirror: DataFrame,
    systems: DataFrame,
    changes: DataFrame,
    removed: int | None = None,
    fetched: int | None = None,
) -> DataFrame:
    """Settled documents of this run's systems that link to a removed one.

    With few removals their ids go to the links, which then need no shuffle; with many
    the join is salted, as a removed hub may be the target of most links.
    """
    settled = _settled(mirror.select("doc_id", "system", "relations"), systems, changes, fetched)
    links = edges(settled, "doc_id", "relations", "target")
    gone = removed_ids(changes).select(F.col("doc_id").alias("target"))
    if removed is not None and removed <= BROADCAST_ROWS:
        hit = links.join(F.broadcast(gone), "target", "left_semi")
    else:
        hit = skew_safe_join(links, gone, "target", "left_semi", ["doc_id"])
    return hit.select("doc_id").distinct()


def work_list(changes: DataFrame, drift: DataFrame | None, referring: DataFrame | None) -> DataFrame:
    """(doc_id, origin), each document once under its first origin."""
    parts = [changed_ids(changes).withColumn("origin", F.lit(FETCHED))]
    if drift is not None:
        parts.append(drift.select("doc_id").withColumn("origin", F.lit(DRIFTED)))
    if referring is not None:
        parts.append(referring.select("doc_id").withColumn("origin", F.lit(REFERRING)))
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("doc_id")
        .agg(F.min("origin").alias("origin"))
    )


def branch(work: DataFrame, removed: DataFrame) -> DataFrame:
    """`sync/<system>` of the first work-list entry, else of the first removed id."""
    first = work.agg(F.min(F.struct("origin", "doc_id")).alias("first")).select(
        F.col("first.doc_id").alias("item"), F.lit(1).alias("one")
    )
    gone = removed.agg(F.min("doc_id").alias("gone"), F.lit(1).alias("one"))
    system = F.coalesce(
        identity.system_of(F.col("item")), identity.system_of(F.col("gone")), F.lit("source")
    )
    return first.join(gone, "one").select(F.concat(F.lit("sync/"), system).alias("branch"))


# ---------------------------------------------------------------- scope laws


def path_collisions(
    docs: DataFrame,
    settle: Callable[[DataFrame], DataFrame] | None = None,
    added: DataFrame | None = None,
    added_rows: int | None = None,
) -> DataFrame:
    """A3/L3: documents whose bundle path already belongs to a smaller id.

    A published state has no collision, so in a run only a path of an `added` document can
    be contested: other paths leave at the scan, before anything is shuffled.

    Contested paths come from a map-side aggregate and are rare. Where `settle` writes
    them out and they prove few, they go to the documents; else the join is salted.
    """
    live = docs.where(~F.col("deleted")).select(
        identity.concept_path(F.col("doc_id")).alias("path"), "doc_id"
    )
    if added is not None:
        paths = added.select(identity.concept_path(F.col("doc_id")).alias("path")).distinct()
        live = live.join(guarded_broadcast(paths, added_rows), "path", "left_semi")
    contested = (
        live.groupBy("path")
        .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        .where(F.col("owner") != F.col("last"))
        .select("path", "owner")
    )
    few = False
    if settle is not None:
        contested = settle(contested)
        few = contested.count() <= BROADCAST_ROWS
    if few:
        rivals = live.join(F.broadcast(contested), "path")
    else:
        rivals = skew_safe_join(live, contested, "path", "inner", ["doc_id"])
    return rivals.where(F.col("doc_id") != F.col("owner")).select(
        *failure(
            "path",
            "bundle-path-collision",
            F.concat(
                F.col("owner"), F.lit(" and "), F.col("doc_id"),
                F.lit(COLLISION),
            ),
        )
    )


def cross_system_relations(docs: DataFrame) -> DataFrame:
    """L4: relations that leave the document's own system. No shuffle."""
    system = identity.system_of(F.col("doc_id"))
    links = docs.select("doc_id", F.explode("relations").alias("target"))
    return links.where(identity.system_of(F.col("target")) != system).select(
        *failure(
            identity.concept_path(F.col("doc_id")),
            "cross-system-relation",
            F.concat(
                F.lit("link to "), F.col("target"), F.lit(" leaves "), system,
                F.lit(CROSSING),
            ),
        )
    )


def explanatory_notes(
    drift: DataFrame | None, referring: DataFrame | None, produced_paths: DataFrame
) -> list[DataFrame]:
    """Why a file changed although its own source did not; produced files only."""
    notes = []
    for ids, why in ((referring, REFERRER_NOTE), (drift, DRIFT_NOTE)):
        if ids is None:
            continue
        paths = ids.select(identity.concept_path(F.col("doc_id")).alias("path"))
        notes.append(
            paths.join(produced_paths.select("path"), "path", "left_semi").select(
                F.concat(F.col("path"), F.lit(why)).alias("note")
            )
        )
    return notes
