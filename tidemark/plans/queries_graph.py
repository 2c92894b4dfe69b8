"""Registered queries: links, referrers, scope laws, work list, grounding, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.operators import changes as ch
from tidemark.operators import concepts as cn
from tidemark.operators import grounding as gr
from tidemark.operators import laws, prose, scope
from tidemark.plans import corpus
from tidemark.plans.corpus import sql_path, sql_resolution, with_states
from tidemark.plans.registry import query
from tidemark.session import settled

_SETTLED = """settled AS (SELECT * FROM mirror WHERE system IN (SELECT system FROM fetched)
  AND did NOT IN (SELECT did FROM changes WHERE kind IN ('added', 'modified', 'removed')))"""
_SEEN = """seen AS (SELECT s.did, s.system, s.native_id, coalesce(l.url, s.url) AS url,
    coalesce(l.grounded_by, s.grounded_by) AS grounded_by, coalesce(l.content_hash, s.content_hash) AS content_hash
  FROM settled s LEFT JOIN live l ON l.did = s.did)"""
_REFERRERS = """referrers AS (SELECT DISTINCT did FROM (SELECT did, unnest(relations) AS target FROM settled)
  WHERE target IN (SELECT did FROM changes WHERE kind = 'removed'))"""
_RECORDED = sql_resolution("mirror", "mirror", "old") + """,
recorded AS (
  SELECT owner_id, list_sort(list([gid, CASE WHEN num % 40 = 0 THEN 'stale' ELSE content_hash END])) AS entries
  FROM (SELECT *, regexp_extract(owner_id, 'docs/(\\d+)', 1)::BIGINT AS num FROM old_kept)
  WHERE num % 15 <> 0 GROUP BY owner_id)"""
_NOW = sql_resolution("seen", "overlay", "now") + """,
current_sets AS (SELECT owner_id, list_sort(list([gid, content_hash])) AS entries FROM now_kept GROUP BY owner_id),
drift AS (SELECT s.did FROM seen s LEFT JOIN recorded r ON r.owner_id = s.did
  LEFT JOIN current_sets c ON c.owner_id = s.did
  WHERE coalesce(r.entries, []) IS DISTINCT FROM coalesce(c.entries, []))"""
_WORK = """work AS (SELECT did, min(origin) AS origin FROM (
  SELECT did, 0 AS origin FROM changes WHERE kind IN ('added', 'modified')
  UNION ALL SELECT did, 1 FROM drift UNION ALL SELECT did, 2 FROM referrers) GROUP BY did)"""


def _parts(spark, sf_dir):
    st = corpus.states(spark, sf_dir)
    return st, settled(st.changes)


@query(
    "J3_drift_candidates",
    with_states(
        "SELECT did AS doc_id, content_hash, len(grounded_by) AS declared FROM seen", _SETTLED, _SEEN
    ),
)
def drift_candidates(spark, sf_dir):
    st, changes = _parts(spark, sf_dir)
    return scope.drift_candidates(st.was, st.docs, st.systems, changes).select(
        "doc_id", "content_hash", F.size("grounded_by").cast("bigint").alias("declared")
    )


@query("J6_referrers", with_states("SELECT did AS doc_id FROM referrers", _SETTLED, _REFERRERS))
def referrers(spark, sf_dir):
    st, changes = _parts(spark, sf_dir)
    return scope.referrers(st.was, st.systems, changes)


@query(
    "J7_links",
    with_states(
        f"""SELECT did AS doc_id, string_agg(path, ',' ORDER BY path) AS links FROM (
          SELECT did, {sql_path('target')} AS path FROM (SELECT did, unnest(relations) AS target FROM live))
        WHERE path IN (SELECT path FROM known) GROUP BY did"""
    ),
)
def links(spark, sf_dir):
    st = corpus.states(spark, sf_dir)
    found = cn.resolved_links(st.live, st.known)
    return found.select("doc_id", F.array_join("links", ",").alias("links"))


@query(
    "J7_dropped_links",
    with_states(
        f"""SELECT did AS doc_id, array_to_string(list_sort(list(DISTINCT path)), ',') AS dropped FROM (
          SELECT did, {sql_path('target')} AS path FROM (SELECT did, unnest(relations) AS target FROM live))
        WHERE path NOT IN (SELECT path FROM known) GROUP BY did"""
    ),
)
def dropped_links(spark, sf_dir):
    """J7 as a run asks it: the few links that lead nowhere, for assembly to leave out."""
    st = corpus.states(spark, sf_dir)
    found = cn.dropped_links(st.live, st.known)
    return found.select("doc_id", F.array_join(F.array_sort("dropped"), ",").alias("dropped"))


def _linked_concepts(st):
    return st.live.select(
        identity.concept_path(F.col("doc_id")).alias("path"),
        F.transform("relations", identity.concept_path).alias("links"),
    )


@query(
    "J8_dangling_links",
    with_states(
        f"""SELECT path, 'link-resolvability' AS law, 'link ''' || link || ''' leads to no published path' AS message
        FROM (SELECT {sql_path('did')} AS path, {sql_path('target')} AS link
          FROM (SELECT did, unnest(relations) AS target FROM live))
        WHERE link NOT IN (SELECT path FROM known)"""
    ),
)
def dangling_links(spark, sf_dir):
    st = corpus.states(spark, sf_dir)
    return laws.dangling_links(_linked_concepts(st), st.known)


def _contested(spark, sf_dir):
    """Every 50th document's two successors claim its path."""
    n = F.col("n")
    rows = corpus.base(spark, sf_dir)
    return ch.canonical_documents(
        rows.withColumn(
            "native_id",
            F.when(n % 50 == 1, F.concat(F.lit("docs/"), corpus.text(n - 1), F.lit(".md")))
            .when(n % 50 == 2, F.concat(F.lit("docs/"), corpus.text(n - 2)))
            .otherwise(F.col("native_id")),
        )
    )


@query(
    "A3_path_collisions",
    f"""WITH {corpus.SQL_BASE}, claims AS (SELECT doc, {sql_path('doc')} AS path FROM (
      SELECT system || ':' || CASE WHEN n % 50 = 1 THEN 'docs/' || (n - 1) || '.md'
        WHEN n % 50 = 2 THEN 'docs/' || (n - 2) ELSE native_id END AS doc FROM base)),
    owners AS (SELECT path, min(doc) AS owner FROM claims GROUP BY path)
    SELECT path, 'bundle-path-collision' AS law, owner || ' and ' || doc || ' claim one path, and the later of two merges '
      || 'would replace the earlier' AS message
    FROM claims JOIN owners USING (path) WHERE doc <> owner""",
)
def path_collisions(spark, sf_dir):
    return scope.path_collisions(_contested(spark, sf_dir), settled)


@query(
    "L4_cross_system_relations",
    f"""WITH {corpus.SQL_BASE}, e AS (SELECT did, split_part(did, ':', 1) AS s, unnest(relations) AS target FROM base)
    SELECT {sql_path('did')} AS path, 'cross-system-relation' AS law, 'link to ' || target || ' leaves '
      || s || '; links end in the system they start in' AS message
    FROM e WHERE split_part(target, ':', 1) <> s""",
)
def cross_system_relations(spark, sf_dir):
    return scope.cross_system_relations(ch.canonical_documents(corpus.base(spark, sf_dir)))


# ---------------------------------------------------------------- grounding


def _subject_map(spark, sf_dir):
    """labels as an operator's map: a labelled document is grounded in another one."""
    n = F.col("doc_id")
    good = F.col("quality") == 1
    return corpus.table(spark, sf_dir, "labels").select(
        F.when(good, corpus.page(n)).otherwise(corpus.text(n)).alias("owner_id"),
        F.when(F.col("toxic") == 0, corpus.page(n * 2)).otherwise(F.concat(F.lit(":"), corpus.text(n))).alias(
            "grounding_id"
        ),
    )


_MAP = f"""subject_map AS (SELECT CASE WHEN quality = 1 THEN {corpus._page('doc_id')} ELSE doc_id::VARCHAR END AS owner_id,
  CASE WHEN toxic = 0 THEN {corpus._page('doc_id * 2')} ELSE ':' || doc_id END AS grounding_id FROM labels)"""
_TAIL = " needs the form system:id"


@query(
    "S15_subject_map_problems",
    f"""WITH {_MAP}
    SELECT 'grounding key ''' || owner_id || '''{_TAIL}' AS problem FROM (SELECT DISTINCT owner_id FROM subject_map)
      WHERE owner_id NOT LIKE '_%:_%'
    UNION ALL SELECT 'grounding value ''' || grounding_id || ''' under ''' || owner_id || '''{_TAIL}'
      FROM subject_map WHERE grounding_id NOT LIKE '_%:_%'""",
)
def subject_map_problems(spark, sf_dir):
    return gr.subject_map_problems(_subject_map(spark, sf_dir))


@query(
    "U1_declared_ids",
    with_states(
        """SELECT DISTINCT owner_id, grounding_id FROM (
          SELECT did AS owner_id, unnest(grounded_by) AS grounding_id FROM live
          UNION ALL SELECT owner_id, grounding_id FROM subject_map WHERE owner_id IN (SELECT did FROM live))""",
        _MAP,
    ),
)
def declared_ids(spark, sf_dir):
    owners = corpus.light(corpus.fetch(spark, sf_dir)).where(~F.col("deleted"))
    return gr.declared_ids(owners, _subject_map(spark, sf_dir))


_RES = sql_resolution("live", "overlay")
#: Documents an owner may cite, in the two queries that show the limit.
LIMIT = 5
_RES_LIMITED = sql_resolution("live", "overlay", limit=LIMIT)


def _owners_lookup(spark, sf_dir):
    st = corpus.states(spark, sf_dir)
    return st.live, gr.looked_up(gr.declared_ids(st.live, None), st.targets)


@query(
    "J4_grounding_resolve",
    with_states("SELECT owner_id, gid AS grounding_id, content_hash FROM res_found", _RES),
)
def grounding_resolve(spark, sf_dir):
    _, lookup = _owners_lookup(spark, sf_dir)
    return lookup.select("owner_id", "grounding_id", F.col("anchor.content_hash").alias("content_hash"))


@query(
    "W1_resource_dedupe",
    with_states("SELECT owner_id, gid AS grounding_id, resource FROM res_cited", _RES),
)
def resource_dedupe(spark, sf_dir):
    owners, lookup = _owners_lookup(spark, sf_dir)
    return gr.citable(lookup, owners).select("owner_id", "grounding_id", "resource")


@query(
    "W2_grounding_cap",
    with_states("SELECT owner_id, gid AS grounding_id, rank::INT AS rank FROM res_kept", _RES_LIMITED),
)
def grounding_cap(spark, sf_dir):
    st = corpus.states(spark, sf_dir)
    kept = gr.resolve(st.live, None, st.targets, LIMIT, settle=settled)[0]
    return kept.select("owner_id", "grounding_id", "rank")


@query(
    "W2_resolution_notes",
    with_states(
        f"""SELECT owner_id, {sql_path('owner_id')} || ': grounding ' || gid ||
          ' names no document here and is left out' AS note FROM res_found WHERE hit IS NULL
        UNION ALL SELECT owner_id, {sql_path('owner_id')} || ': grounding ' || gid || ' is beyond the limit of {LIMIT}'
        FROM res_ranked WHERE rank > {LIMIT}""",
        _RES_LIMITED,
    ),
)
def resolution_notes(spark, sf_dir):
    st = corpus.states(spark, sf_dir)
    return gr.resolve(st.live, None, st.targets, LIMIT, settle=settled)[1]


def _resolved_candidates(st, changes):
    candidates = settled(scope.drift_candidates(st.was, st.docs, st.systems, changes))
    return candidates, gr.resolve(candidates, None, st.targets, settle=settled)[0]


def _drift(st, changes):
    candidates, kept = _resolved_candidates(st, changes)
    return settled(gr.drifted(candidates, st.recorded, kept))


_DRIFT_CTES = (_SETTLED, _SEEN, _RECORDED, _NOW)


@query("J5_drift", with_states("SELECT did AS doc_id FROM drift", *_DRIFT_CTES))
def drift(spark, sf_dir):
    """Resolved set or hashes differ from what lineage recorded."""
    return _drift(*_parts(spark, sf_dir))


def _doubtful(st):
    """Owners to look at again, from the inverse of what the mirror's documents declare.

    The recorded lineage has none for multiples of 15 and stale hashes for those of 40: such owners
    are what an earlier run left over. All others can only have drifted by what this fetch moves.
    """
    n = F.regexp_extract("doc_id", r"docs/(\d+)\.md", 1).cast("bigint")
    cited = settled(gr.declared_ids(st.was, None).select("grounding_id", "owner_id"))
    left_over = st.was.select("doc_id").where((n % 15 == 0) | (n % 40 == 0))
    moved = settled(gr.movements(st.docs, st.was))
    return settled(gr.doubtful(left_over, cited, moved, settled(st.systems)))


@query("J5_reverse_drift", with_states("SELECT did AS doc_id FROM drift", *_DRIFT_CTES))
def reverse_drift(spark, sf_dir):
    """J5 and U4 over the owners of ids that changed, which gives what the scan of all gives."""
    st, changes = _parts(spark, sf_dir)
    pool = st.was.join(_doubtful(st), "doc_id", "left_semi")
    candidates = settled(scope.drift_candidates(pool, st.docs, st.systems, changes))
    kept = gr.resolve(candidates, None, st.targets, settle=settled)[0]
    return gr.drifted(candidates, st.recorded, kept)


@query(
    "J5_doubtful_owners",
    with_states(
        """SELECT did AS doc_id FROM mirror WHERE system IN (SELECT system FROM fetched) AND (n % 15 = 0 OR n % 40 = 0)
        UNION SELECT m.did FROM mirror m, unnest(m.grounded_by) AS u(gid)
          WHERE m.system IN (SELECT system FROM fetched)
            AND gid IN (SELECT did FROM changes WHERE kind IN ('added', 'modified'))"""
    ),
)
def doubtful_owners(spark, sf_dir):
    """What the inverse of declarations answers: owners that this fetch can have moved."""
    return _doubtful(corpus.states(spark, sf_dir))


@query(
    "U4_set_drift",
    with_states(
        """SELECT s.did AS doc_id FROM seen s
        LEFT JOIN (SELECT owner_id, list_sort(list_transform(entries, lambda e: e[1])) AS ids FROM recorded) r
          ON r.owner_id = s.did
        LEFT JOIN (SELECT owner_id, list_sort(list(gid)) AS ids FROM now_kept GROUP BY owner_id) c ON c.owner_id = s.did
        WHERE coalesce(r.ids, []) IS DISTINCT FROM coalesce(c.ids, [])""",
        *_DRIFT_CTES,
    ),
)
def set_drift(spark, sf_dir):
    """U4 alone: the set of ids moved, whatever their hashes say."""
    st, changes = _parts(spark, sf_dir)
    candidates, kept = _resolved_candidates(st, changes)
    blank = F.lit("")
    flat = kept.withColumn("anchor", F.struct(blank.alias("content_hash")))
    ids_only = st.recorded.withColumn(
        "recorded", F.transform_values("recorded", lambda _, v: blank)
    )
    return gr.drifted(candidates, ids_only, flat)


def _work(spark, sf_dir):
    st, changes = _parts(spark, sf_dir)
    referring = scope.referrers(st.was, st.systems, changes)
    return scope.work_list(changes, _drift(st, changes), referring), changes


_WORK_CTES = (*_DRIFT_CTES, _REFERRERS, _WORK)


@query("C1_work_list", with_states("SELECT did AS doc_id, origin FROM work", *_WORK_CTES))
def work_list(spark, sf_dir):
    """Changed, drifted and referring documents, each once."""
    return _work(spark, sf_dir)[0]


@query(
    "W5_branch",
    with_states(
        "SELECT 'sync/' || split_part(did, ':', 1) AS branch FROM work ORDER BY origin, did LIMIT 1",
        *_WORK_CTES,
    ),
)
def branch(spark, sf_dir):
    work, changes = _work(spark, sf_dir)
    return scope.branch(work, ch.removed_ids(changes))


@query(
    "C3_explanatory_notes",
    with_states(
        f"""SELECT {sql_path('did')} || ': rebuilt, as it linked to what this run removes; '
            || 'its own source is as before' AS note FROM referrers
        UNION ALL SELECT {sql_path('did')} || ': rebuilt, as a document of another system that it is '
            || 'grounded in has changed; its own source is as before' FROM drift""",
        *_WORK_CTES,
    ),
)
def explanatory_notes(spark, sf_dir):
    st, changes = _parts(spark, sf_dir)
    found = _drift(st, changes)
    referring = settled(scope.referrers(st.was, st.systems, changes))
    work = scope.work_list(changes, found, referring)
    produced = work.select(identity.concept_path(F.col("doc_id")).alias("path"))
    first, second = scope.explanatory_notes(found, referring, produced)
    return first.unionByName(second)


@query(
    "K2_lineage_advance",
    with_states(
        """SELECT coalesce(r.owner_id, d.did) AS owner_id,
          array_to_string(list_transform(CASE WHEN d.did IS NULL THEN r.entries ELSE d.entries END,
            lambda e: e[1] || '=' || e[2]), ',') AS recorded
        FROM recorded r FULL JOIN (
          SELECT l.did, CASE WHEN k.owner_id IS NOT NULL THEN k.entries WHEN len(l.grounded_by) > 0 THEN [] END AS entries
            FROM live l LEFT JOIN (SELECT owner_id, list_sort(list([gid, content_hash])) AS entries FROM res_kept
              GROUP BY owner_id) k ON k.owner_id = l.did WHERE l.n % 7 <> 0
          UNION ALL SELECT did, NULL FROM changes WHERE kind = 'removed') d ON d.did = r.owner_id
        WHERE CASE WHEN d.did IS NULL THEN r.entries ELSE d.entries END IS NOT NULL""",
        _RECORDED,
        _RES,
    ),
)
def lineage_advance(spark, sf_dir):
    """Four outcomes: dropped by the generator (every 7th), resolved, unresolved, removed."""
    st = corpus.states(spark, sf_dir)
    owners = st.live
    n = F.regexp_extract("doc_id", r"docs/(\d+)\.md", 1).cast("bigint")
    produced = owners.where(n % 7 != 0).select(identity.concept_path(F.col("doc_id")).alias("path"))
    decisions = gr.lineage_decisions(
        owners, produced, gr.declared_ids(owners, None), st.kept, ch.removed_ids(st.changes)
    )
    after = gr.advance_lineage(st.recorded, decisions)
    entries = F.transform(
        F.array_sort(F.map_entries("recorded")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return after.select("owner_id", F.array_join(entries, ",").alias("recorded"))


@query(
    "W3_grounding_blocks",
    with_states(
        """SELECT k.owner_id AS doc_id, sha256(string_agg('--- ' || k.gid || ' ---' || chr(10) ||
            left(t.text, (600 // c.n)::INT), chr(10) || chr(10) ORDER BY k.rank)) AS parts_hash,
          count(*) FILTER (length(t.text) > 600 // c.n) AS cut
        FROM res_kept k JOIN overlay t ON t.did = k.gid
        JOIN (SELECT owner_id, count(*) AS n FROM res_kept GROUP BY owner_id) c ON c.owner_id = k.owner_id
        GROUP BY k.owner_id""",
        _RES,
    ),
)
def grounding_blocks(spark, sf_dir):
    """A budget of 600 characters per owner, shared evenly by what grounds it."""
    st = corpus.states(spark, sf_dir, with_text=True)
    blocks = prose.grounding_blocks(settled(st.kept), ch.overlay(st.was, st.docs), 600)
    after_lead = F.substr("block", F.instr("block", "--- "))
    return blocks.select(
        "doc_id", F.sha2(after_lead, 256).alias("parts_hash"),
        F.size("notes").cast("bigint").alias("cut"),
    )


@query(
    "X13_next_hops",
    with_states(
        """SELECT split_part(owner_id, ':', 1) AS system, count(DISTINCT owner_id) AS owners FROM (
          SELECT owner_id, unnest(list_transform(entries, lambda e: e[1])) AS gid FROM recorded)
        WHERE gid IN (SELECT did FROM changes WHERE kind IN ('added', 'modified')) GROUP BY 1""",
        _RECORDED,
    ),
)
def next_hops(spark, sf_dir):
    st = corpus.states(spark, sf_dir)
    return gr.next_hops(st.recorded, ch.changed_ids(st.changes))
