"""Cross-system grounding: declarations, resolution, drift and lineage
(S15, U1, J4, W1, W2, J5, U4, K2, A11)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions import identity
from tidemark.operators.joins import BROADCAST_ROWS, guarded_broadcast, skew_safe_join

# Wording of resolution notes and of map problems.
NOT_FOUND = " names no document here and is left out"
TOMBSTONED = " names a deleted document and is left out"
OVER_LIMIT = " is beyond the limit of "
NOT_QUALIFIED = " needs the form system:id"

MAP = T.MapType(T.StringType(), T.StringType())


def subject_map_problems(subject_map: DataFrame, max_docs: int | None = None) -> DataFrame:
    """Shape errors of the operator's map. Whether an id resolves is no shape error."""
    tail = F.lit(NOT_QUALIFIED)
    keys = subject_map.select("owner_id").distinct().where(
        ~identity.is_qualified(F.col("owner_id"))
    )
    values = subject_map.where(
        F.col("grounding_id").isNotNull() & ~identity.is_qualified(F.col("grounding_id"))
    )
    parts = [
        keys.select(F.concat(F.lit("grounding key '"), "owner_id", F.lit("'"), tail).alias("problem")),
        values.select(
            F.concat(
                F.lit("grounding value '"), "grounding_id", F.lit("' under '"), "owner_id",
                F.lit("'"), tail,
            ).alias("problem")
        ),
    ]
    if max_docs is not None and max_docs < 1:
        parts.append(
            subject_map.sparkSession.createDataFrame(
                [("grounding 'max_grounding_docs' must be at least 1",)], "problem string"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def declared_ids(owners: DataFrame, subject_map: DataFrame | None) -> DataFrame:
    """(owner_id, grounding_id), the document's own and the map's, each once."""
    own = owners.select(
        F.col("doc_id").alias("owner_id"), F.explode("grounded_by").alias("grounding_id")
    )
    if subject_map is not None:
        mapped = subject_map.where(F.col("grounding_id").isNotNull()).join(
            owners.select(F.col("doc_id").alias("owner_id")), "owner_id", "left_semi"
        )
        own = own.unionByName(mapped.select("owner_id", "grounding_id"))
    return own.distinct()


def looked_up(declared: DataFrame, targets: DataFrame, rows: int | None = None) -> DataFrame:
    """Each declaration beside the document it names, NULL where there is none.

    Targets are cut to identity columns. A document that many owners cite is a hot key,
    so the join is salted; few declarations (`rows`) filter the targets in place.
    """
    found = targets.select(
        F.col("doc_id").alias("grounding_id"),
        F.struct("system", "native_id", "url", "content_hash").alias("anchor"),
        F.col("deleted").alias("gone"),
    )
    others = declared.where(F.col("owner_id") != F.col("grounding_id"))
    return skew_safe_join(others, found, "grounding_id", "left", ["owner_id"], rows=rows)


def _anchor_key(anchor: str) -> Column:
    return identity.resource_key(
        F.col(f"{anchor}.url"), F.col(f"{anchor}.system"), F.col(f"{anchor}.native_id")
    )


def citable(lookup: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per owner and resource, the first id winning; the owner's own dropped."""
    own = owners.select(
        F.col("doc_id").alias("owner_id"),
        identity.resource_key(F.col("url"), F.col("system"), F.col("native_id")).alias("own_key"),
    )
    live = lookup.where(F.col("anchor").isNotNull() & ~F.col("gone"))
    cited = (
        live.withColumn("resource", _anchor_key("anchor"))
        .groupBy("owner_id", "resource")
        .agg(F.min(F.struct("grounding_id", "anchor")).alias("first"))
    )
    # an owner may declare very many: its rows are spread, not its one resource
    return (
        skew_safe_join(cited, own, "owner_id", "inner", ["resource"])
        .where(F.col("resource") != F.col("own_key"))
        .select("owner_id", F.col("first.grounding_id").alias("grounding_id"), "resource",
                F.col("first.anchor").alias("anchor"))
    )


def capped(cited: DataFrame, max_docs: int | None = None) -> DataFrame:
    """All per owner, or the first `max_docs` by id where that is asked for, with their rank.

    The rank filter lets Spark keep only `max_docs` rows per owner in every map task,
    so an owner with very many declarations does not travel whole to one reducer.
    """
    by_owner = Window.partitionBy("owner_id").orderBy("grounding_id")
    ranked = cited.withColumn("rank", F.row_number().over(by_owner))
    return ranked if max_docs is None else ranked.where(F.col("rank") <= max_docs)


def resolution_notes(
    lookup: DataFrame, cited: DataFrame, kept: DataFrame, max_docs: int | None = None
) -> DataFrame:
    """J4/W2 notes: (owner_id, note) for missing, tombstoned and capped ids.

    One note for each id, however many an owner has.
    """
    path = identity.concept_path(F.col("owner_id"))

    def dropped(why: str) -> Column:
        return F.concat(path, F.lit(": grounding "), F.col("grounding_id"), F.lit(why))

    missing = lookup.where(F.col("anchor").isNull()).select(
        "owner_id", dropped(NOT_FOUND).alias("note")
    )
    gone = lookup.where(F.col("anchor").isNotNull() & F.col("gone")).select(
        "owner_id", dropped(TOMBSTONED).alias("note")
    )
    if max_docs is None:
        return missing.unionByName(gone)
    over = cited.select("owner_id", "grounding_id").join(
        kept.select("owner_id", "grounding_id"), ["owner_id", "grounding_id"], "left_anti"
    )
    capped_notes = over.select("owner_id", dropped(f"{OVER_LIMIT}{max_docs}").alias("note"))
    return missing.unionByName(gone).unionByName(capped_notes)


def resolve(
    owners: DataFrame,
    subject_map: DataFrame | None,
    targets: DataFrame | Callable[[DataFrame], DataFrame],
    max_docs: int | None = None,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """U1 then J4 then W1 then W2: (kept rows, notes).

    `targets` may be a function of the declarations, for a caller that knows where their ids lie.

    Declarations, lookup and citable rows are each read more than once; `settle` writes
    them out, so that the join behind them runs once and the first can be counted.
    """
    declared, rows = declared_ids(owners, subject_map), None
    if settle is not None:
        declared = settle(declared)
        rows = declared.count()
    keep = settle or (lambda df: df)
    if callable(targets):
        targets = targets(declared)
    lookup = keep(looked_up(declared, targets, rows))
    cited = keep(citable(lookup, owners))
    kept = capped(cited, max_docs)
    return kept, resolution_notes(lookup, cited, kept, max_docs)


def as_recorded(kept: DataFrame) -> DataFrame:
    """Lineage form of a resolution: owner to {grounding id: hash}, at most the cap."""
    return kept.groupBy("owner_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("grounding_id", "anchor.content_hash")))
        ).alias("current")
    )


def _entries(m: str) -> Column:
    filled = F.coalesce(F.col(m), F.map_from_arrays(F.array(), F.array()).cast(MAP))
    return F.array_sort(F.map_entries(filled))


def drifted(candidates: DataFrame, lineage: DataFrame, kept: DataFrame) -> DataFrame:
    """Candidates whose resolved set or whose hashes differ from the recorded ones.

    A missing record is an empty set, so grounding that resolves for the first time
    counts as drift, and nothing declared with nothing recorded never does.
    """
    return (
        candidates.select(F.col("doc_id").alias("owner_id"))
        .join(lineage.select("owner_id", "recorded"), "owner_id", "left")
        .join(as_recorded(kept), "owner_id", "left")
        .where(_entries("recorded") != _entries("current"))
        .select(F.col("owner_id").alias("doc_id"))
    )


def lineage_decisions(
    work_list: DataFrame,
    produced_paths: DataFrame,
    declared: DataFrame | None,
    kept: DataFrame | None,
    removed: DataFrame,
) -> DataFrame:
    """K2: (owner_id, recorded) for this run; a NULL map means delete.

    Owners whose file the generator dropped are left out, so their old row stays.
    `declared` and `kept` are None when the generator does not ground.
    """
    built = (
        work_list.select(F.col("doc_id").alias("owner_id"))
        .withColumn("path", identity.concept_path(F.col("owner_id")))
        .join(produced_paths.select("path").distinct(), "path", "left_semi")
        .select("owner_id")
    )
    nothing = F.lit(None).cast(MAP)
    if kept is None or declared is None:
        decided = built.withColumn("recorded", nothing)
    else:
        has_declared = declared.select("owner_id").distinct().withColumn("declares", F.lit(True))
        decided = (
            built.join(as_recorded(kept), "owner_id", "left")
            .join(has_declared, "owner_id", "left")
            .select(
                "owner_id",
                F.when(F.col("current").isNotNull(), F.col("current"))
                .when(F.col("declares"), F.map_from_arrays(F.array(), F.array()).cast(MAP))
                .alias("recorded"),
            )
        )
    gone = removed.select(F.col("doc_id").alias("owner_id"), nothing.alias("recorded"))
    return decided.unionByName(gone)


def advance_lineage(lineage: DataFrame, decisions: DataFrame) -> DataFrame:
    """K2: old rows without a decision stay; decided rows replace or delete."""
    new = decisions.select("owner_id", F.col("recorded").alias("new"), F.lit(True).alias("decided"))
    return (
        lineage.join(new, "owner_id", "full_outer")
        .select(
            "owner_id",
            F.when(F.col("decided"), F.col("new")).otherwise(F.col("recorded")).alias("recorded"),
        )
        .where(F.col("recorded").isNotNull())
    )


def scan_needed(grounds: bool, subject_map: DataFrame | None, docs: DataFrame, lineage: DataFrame) -> bool:
    """Whether the drift scan may be skipped. Each probe stops at the first row."""
    if not grounds:
        return False
    if subject_map is not None and not subject_map.isEmpty():
        return True
    if not docs.where(F.size("grounded_by") > 0).isEmpty():
        return True
    return not lineage.isEmpty()


# ---------------------------------------------------------------- reverse lineage


def movements(docs: DataFrame, mirror: DataFrame, fetched: int | None = None) -> DataFrame:
    """Fetched documents that look different to their owners or have other declarations than the mirror's copy.

    (doc_id, deleted, target, owner). `target`: whoever cites it gets another hash, another
    resource or none. `owner`: it is there as before but cites others, or is another resource itself.
    """
    own = F.array_sort(F.array_distinct("grounded_by"))
    was = mirror.select(
        "doc_id", F.struct("content_hash", "url").alias("was_cited"), F.struct("url", own.alias("ids")).alias("was_citing")
    )
    was = was.join(guarded_broadcast(docs.select("doc_id").distinct(), fetched), "doc_id", "left_semi")
    now = docs.select(
        "doc_id", "deleted", F.struct("content_hash", "url").alias("cited"), F.struct("url", own.alias("ids")).alias("citing")
    )
    there = F.col("was_cited").isNotNull()
    # url may be NULL on either side: structs are compared null-safely
    other = ~F.col("cited").eqNullSafe(F.col("was_cited"))
    moved = F.when(F.col("deleted"), there).otherwise(~there | other)
    edited = ~F.col("deleted") & there & ~F.col("citing").eqNullSafe(F.col("was_citing"))
    joined = now.join(was, "doc_id", "left").select("doc_id", "deleted", moved.alias("target"), edited.alias("owner"))
    return joined.where("target or owner")


def citing(cited: DataFrame, ids: DataFrame, rows: int | None = None) -> DataFrame:
    """Owners, as `doc_id`, that declare one of these ids. Few ids filter the inverse in place."""
    wanted = ids.select(F.col("doc_id").alias("grounding_id"))
    if rows is not None and rows <= BROADCAST_ROWS:
        hit = cited.join(F.broadcast(wanted), "grounding_id", "left_semi")
    else:
        hit = skew_safe_join(cited, wanted, "grounding_id", "left_semi", ["owner_id"])
    return hit.select(F.col("owner_id").alias("doc_id")).distinct()


def _balance(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges (owner_id, grounding_id) of one side only: sign 1 for new ones, -1 for those gone."""
    pair = ["owner_id", "grounding_id"]
    both = before.select(*pair, F.lit(-1).alias("sign")).unionByName(after.select(*pair, F.lit(1).alias("sign")))
    return both.distinct().groupBy(*pair).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def map_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Owners, as `doc_id`, whose rows in the operator's map are others than before."""
    return _balance(before, after).select(F.col("owner_id").alias("doc_id")).distinct()


def declarations(owners: DataFrame, subject_map: DataFrame | None) -> DataFrame:
    """(owner_id, declared): all ids that each owner declares, none as an empty array."""
    said = declared_ids(owners, subject_map).groupBy("owner_id").agg(
        F.array_sort(F.collect_set("grounding_id")).alias("declared")
    )
    none = F.array().cast("array<string>")
    return (
        owners.select(F.col("doc_id").alias("owner_id")).distinct()
        .join(said, "owner_id", "left")
        .select("owner_id", F.coalesce("declared", none).alias("declared"))
    )


def tracking_news(decisions: DataFrame, declared: DataFrame | None, removed: DataFrame) -> DataFrame:
    """(owner_id, decided, recorded, declared) of each owner this run decided or looked at.

    `decided` marks a lineage decision, whose NULL map means delete. A NULL `declared` leaves the
    old declarations; a removed owner has none.
    """
    none = F.array().cast("array<string>")
    gone = removed.select(F.col("doc_id").alias("owner_id"), none.alias("declared"))
    read = gone if declared is None else declared.join(gone, "owner_id", "left_anti").unionByName(gone)
    made = decisions.select("owner_id", "recorded", F.lit(True).alias("made"))
    return made.join(read, "owner_id", "full_outer").select(
        "owner_id", F.coalesce("made", F.lit(False)).alias("decided"), "recorded", "declared"
    )


def _touched(before: DataFrame, news: DataFrame, rows: int | None) -> DataFrame:
    """Old rows of the owners in `news`, beside them."""
    ids = guarded_broadcast(news.select("owner_id"), rows)
    old = before.join(ids, "owner_id", "left_semi").select(
        "owner_id", F.col("recorded").alias("was_recorded"), F.col("declared").alias("was_declared")
    )
    none = F.array().cast("array<string>")
    return news.join(old, "owner_id", "left").select(
        "owner_id",
        F.when(F.col("decided"), F.col("recorded")).otherwise(F.col("was_recorded")).alias("recorded"),
        F.coalesce("declared", "was_declared", none).alias("declared"),
        F.coalesce("was_declared", none).alias("was_declared"),
    )


def advance_tracked(before: DataFrame, news: DataFrame, rows: int | None = None) -> DataFrame:
    """K2: stored lineage with this run's news; rows with nothing recorded and nothing declared go.

    With few news the stored rows are filtered in place and not shuffled.
    """
    kept = before.join(guarded_broadcast(news.select("owner_id"), rows), "owner_id", "left_anti")
    now = _touched(before, news, rows).select("owner_id", "recorded", "declared")
    return kept.unionByName(now.where(F.col("recorded").isNotNull() | (F.size("declared") > 0)))


def edge_moves(before: DataFrame, news: DataFrame, rows: int | None = None) -> DataFrame:
    """Declared edges that this run's news adds (sign 1) or takes away (sign -1)."""
    both = _touched(before, news, rows)
    return _balance(
        both.select("owner_id", F.explode("was_declared").alias("grounding_id")),
        both.select("owner_id", F.explode("declared").alias("grounding_id")),
    )


def advance_cited(before: DataFrame, moves: DataFrame, rows: int | None = None) -> DataFrame:
    """The inverse with these moves; edges that stay are not shuffled where moves are few."""
    pair = ["grounding_id", "owner_id"]
    gone = guarded_broadcast(moves.where("sign < 0").select(*pair), rows)
    return before.join(gone, pair, "left_anti").unionByName(moves.where("sign > 0").select(*pair)).distinct()


def doubtful(
    suspects: DataFrame,
    cited: DataFrame,
    moved: DataFrame,
    systems: DataFrame,
    map_owners: DataFrame | None = None,
    moved_rows: int | None = None,
) -> DataFrame:
    """Owners whose grounding may differ from what was recorded; all others can't have drifted.

    Those left over from earlier runs, those that declare an id that moves in this run, those whose
    own declarations move, and those with other rows in the operator's map. The ids come from the
    inverse of the declarations, so that settled documents are not read.
    """
    parts = [
        suspects.select("doc_id"),
        citing(cited, moved.where("target and not deleted"), moved_rows),
        moved.where("owner").select("doc_id"),
    ]
    if map_owners is not None:
        parts.append(map_owners)
    found = reduce(DataFrame.unionByName, parts).distinct()
    return found.join(
        F.broadcast(systems), identity.system_of(F.col("doc_id")) == F.col("system"), "left_semi"
    )


def next_hops(lineage: DataFrame, published: DataFrame) -> DataFrame:
    """Owners to revisit, by system, after some documents were published."""
    cited = lineage.select("owner_id", F.explode(F.map_keys("recorded")).alias("doc_id"))
    hit = skew_safe_join(cited, published.select("doc_id").distinct(), "doc_id", "left_semi", ["owner_id"])
    return (
        hit.select("owner_id").distinct()
        .groupBy(identity.system_of(F.col("owner_id")).alias("system"))
        .agg(F.count(F.lit(1)).alias("owners"))
    )
