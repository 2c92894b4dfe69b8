"""Registered queries: read-side jobs over concepts, and the keyed change log."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import functions as F

from tidemark.functions import facets as fx
from tidemark.functions import identity
from tidemark.operators import catalog
from tidemark.operators import changes as ch
from tidemark.operators import concepts as cn
from tidemark.operators import publish
from tidemark.plans import corpus, manifests
from tidemark.plans.corpus import sql_path
from tidemark.plans.registry import query
from tidemark.plans.text_index import TextIndex
from tidemark.session import ROCKSDB_PROVIDER, shared_dir
from tidemark.streaming import keyed_changes, micro_batches


def _concepts(spark, sf_dir):
    """One concept per document, without links resolution: enough for browsing."""
    b = corpus.base(spark, sf_dir)
    did = identity.doc_id(F.col("system"), F.col("native_id"))
    return b.select(
        "n",
        identity.concept_path(did).alias("path"),
        F.when(F.col("n") % 3 == 0, "runbook").otherwise("concept").alias("type"),
        fx.facets(F.col("structured")).alias("facets"),
        F.array(F.struct(identity.resource_key(F.col("url"), F.col("system"), F.col("native_id")).alias("resource"))).alias(
            "sources"
        ),
        F.transform("relations", identity.concept_path).alias("links"),
        F.col("retrieved_at").alias("generated_at"),
    )


_CONCEPTS = f"""{corpus.SQL_BASE}, concepts AS (
  SELECT n, {sql_path('did')} AS path, CASE WHEN n % 3 = 0 THEN 'runbook' ELSE 'concept' END AS type, lang, n_chars,
    coalesce(url, system || ':' || native_id) AS resource, relations, retrieved FROM base)"""


@query(
    "X1_manifest_tombstones",
    "SELECT 'list:' || doc_id AS doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 6 <> 0",
)
def manifest_tombstones(spark, sf_dir):
    """Scoped by selector: ids that another selector surfaced are never touched."""
    n = F.col("doc_id")
    d = corpus.table(spark, sf_dir, "documents")
    did = F.concat(F.lit("list:"), n.cast("string")).alias("doc_id")
    manifest = d.select(did, F.when(n % 2 == 0, "ids").otherwise("search").alias("selector"))
    return catalog.manifest_tombstones(manifest, d.where(n % 3 == 0).select(did), True, "ids")


@query(
    "X1_manifest_digests",
    """SELECT 'list:' || doc_id AS doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 6 <> 0""",
)
def manifest_digests(spark, sf_dir):
    """The same from a kept manifest: a listing, an incomplete one that deletes nothing, then a complete one."""
    n = F.col("doc_id")
    d = corpus.table(spark, sf_dir, "documents")
    did = F.concat(F.lit("list:"), n.cast("string")).alias("doc_id")
    root = f"{shared_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}"
    manifests.tombstones(spark, root, "search", d.where(n % 2 == 1).select(did), True)
    manifests.tombstones(spark, root, "ids", d.where(n % 2 == 0).select(did), True)
    manifests.tombstones(spark, root, "ids", d.where(n % 12 == 0).select(did), False)
    return manifests.tombstones(spark, root, "ids", d.where(n % 3 == 0).select(did), True)


@query(
    "X2_list_concepts",
    f"""WITH {_CONCEPTS} SELECT path, retrieved AS generated_at FROM concepts
    WHERE type = 'runbook' AND lang = 'en' AND retrieved >= 1704067200 + 60 * (SELECT count(*) FROM concepts) // 2""",
)
def list_concepts(spark, sf_dir):
    c = _concepts(spark, sf_dir)
    half = 1704067200 + 60 * c.count() // 2
    found = catalog.list_concepts(
        c, type_="runbook", tags={"lang": "en"}, updated_since=F.timestamp_seconds(F.lit(half))
    )
    return found.select("path", F.unix_timestamp("generated_at").alias("generated_at"))


@query(
    "X3_related_concepts",
    f"""WITH {_CONCEPTS}, me AS (SELECT * FROM concepts WHERE path = 'concepts/docs/3/overview.md'),
    edges AS (SELECT path, {sql_path('t')} AS link FROM (SELECT path, unnest(relations) AS t FROM concepts))
    SELECT DISTINCT * FROM (
      SELECT link AS path, 'links_to' AS relation FROM edges WHERE path = 'concepts/docs/3/overview.md'
      UNION ALL SELECT path, 'linked_from' FROM edges WHERE link = 'concepts/docs/3/overview.md'
      UNION ALL SELECT path, 'shares_source' FROM concepts WHERE resource IN (SELECT resource FROM me))
    WHERE path <> 'concepts/docs/3/overview.md'""",
)
def related_concepts(spark, sf_dir):
    return catalog.related_concepts(_concepts(spark, sf_dir), "concepts/docs/3/overview.md")


@query(
    "X4_stale_concepts",
    f"""WITH {_CONCEPTS}, aged AS (SELECT path, type, 1704067200 + 86400 * 31 - retrieved AS age FROM concepts)
    SELECT path, type, age // 86400 AS age_days FROM aged WHERE age >= 86400 * CASE WHEN type = 'runbook' THEN 30 ELSE 31 END""",
)
def stale_concepts(spark, sf_dir):
    """`as_of` is given, never read from a clock; runbooks have a policy of their own."""
    policy = spark.createDataFrame([("runbook", 30)], "type string, max_days int")
    as_of = F.timestamp_seconds(F.lit(1704067200 + 86400 * 31))
    return catalog.stale_concepts(_concepts(spark, sf_dir), as_of, 31, policy, "concepts/")


@query(
    "X5_search",
    r"""WITH words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents),
    tf AS (SELECT doc_id, w, count(*) AS tf FROM words WHERE w IN ('the', 'elle', 'reti') GROUP BY doc_id, w),
    df AS (SELECT w, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS weight FROM tf GROUP BY w)
    SELECT 'concepts/' || doc_id AS path, round(sum(tf * weight), 6) AS score FROM tf JOIN df USING (w)
    GROUP BY doc_id ORDER BY score DESC, path LIMIT 20""",
)
def search(spark, sf_dir):
    """Lexical top 20; the limit is the feature."""
    d = corpus.table(spark, sf_dir, "documents")
    bodies = d.select(F.concat(F.lit("concepts/"), F.col("doc_id").cast("string")).alias("path"),
                      F.col("text").alias("body"))
    return catalog.search(bodies, ["The", "elle", "reti"], 20).select("path", "score")


@cache
def _index(spark, sf_dir):
    """An index of all documents, brought up in three steps: some of them as they were, edits, deletions."""
    n = F.col("doc_id")
    d = corpus.table(spark, sf_dir, "documents")
    docs = d.select(n, F.concat(F.lit("concepts/"), n.cast("string")).alias("path"), F.col("text").alias("body"), F.lit(False).alias("deleted"))
    index = TextIndex(spark, f"{shared_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}")
    earlier = docs.where(n % 3 != 0).withColumn("body", F.when(n % 7 == 0, F.lit("the reti the")).otherwise(F.col("body")))
    draft = docs.where(n % 5 == 0).withColumn("path", F.concat(F.lit("drafts/"), n.cast("string")))
    index.refresh(earlier.unionByName(draft).drop("doc_id"))
    index.refresh(docs.where((n % 3 == 0) | (n % 7 == 0)).drop("doc_id"))
    index.refresh(draft.withColumn("deleted", F.lit(True)).drop("doc_id"))
    return index


@query(
    "X5_index_search",
    r"""WITH words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents),
    tf AS (SELECT doc_id, w, count(*) AS tf FROM words WHERE w IN ('the', 'elle', 'reti') GROUP BY doc_id, w),
    df AS (SELECT w, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS weight FROM tf GROUP BY w)
    SELECT 'concepts/' || doc_id AS path, round(sum(tf * weight), 6) AS score FROM tf JOIN df USING (w)
    GROUP BY doc_id ORDER BY score DESC, path LIMIT 20""",
)
def index_search(spark, sf_dir):
    """The top 20 from the kept index; the limit is the feature."""
    return _index(spark, sf_dir).search(["The", "elle", "reti"], 20).rows


@query(
    "X5_index_terms",
    r"""SELECT w AS term, count(DISTINCT doc_id) AS df
    FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE w <> '' GROUP BY w""",
)
def index_terms(spark, sf_dir):
    """Document frequency of every term, from the counts of blocks."""
    return _index(spark, sf_dir).frequencies()


@query(
    "X5_similar_vectors",
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS cosine FROM embeddings, q
    ORDER BY cosine DESC, vec_id LIMIT 10""",
)
def similar_vectors(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "embeddings")
    probe = e.where(F.col("vec_id") == 0).first()["embedding"]
    return catalog.similar_by_vector(e, list(probe), 10)


def _subject_rows(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    subject = F.sha2("text", 256)
    return d.select(
        subject.alias("subject"),
        F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))).alias("key", "value"),
    )


@query(
    "X6_conflicts",
    """WITH r AS (SELECT sha256(text) AS subject, unnest(['lang', 'source']) AS key, unnest([lang, source]) AS value FROM documents)
    SELECT subject, key, value, count(*) AS docs FROM r
    WHERE (subject, key) IN (SELECT (subject, key) FROM r GROUP BY subject, key HAVING count(DISTINCT value) > 1)
    GROUP BY subject, key, value""",
)
def conflicts(spark, sf_dir):
    """Same text under different sources or languages; a fact is asserted per value."""
    return catalog.conflicts(_subject_rows(spark, sf_dir))


@query(
    "X6_event_conflicts",
    """WITH r AS (SELECT user_id::VARCHAR AS subject, 'k' AS key, regexp_extract(props, '(\\d+)', 1) AS value FROM events)
    SELECT subject, key, value, count(*) AS docs FROM r
    WHERE subject IN (SELECT subject FROM r GROUP BY subject HAVING count(DISTINCT value) > 1)
    GROUP BY subject, key, value""".replace("\\\\", "\\"),
)
def event_conflicts(spark, sf_dir):
    """Facets read from JSON properties, per user."""
    e = corpus.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("subject"),
                    F.explode(fx.facets(F.col("props"))).alias("key", "value"))
    return catalog.conflicts(rows)


@query(
    "X7_gaps",
    """SELECT d.doc_id::VARCHAR AS doc_id, unnest(list_concat(CASE WHEN l.doc_id IS NULL THEN ['quality', 'toxic'] ELSE [] END,
      ['owner'])) AS key FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def gaps(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").join(corpus.table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.to_json(F.struct("lang", "quality", "toxic")).alias("structured"),
        F.array().cast("array<string>").alias("opaque_keys"),
    )
    return catalog.facet_gaps(rows, ["lang", "quality", "toxic", "owner"])


@query(
    "X9_chunks",
    """WITH b AS (SELECT source, doc_id::VARCHAR AS doc_id, ('0x' || left(md5(doc_id::VARCHAR), 4))::INT % 256 AS bucket FROM documents)
    SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY bucket, doc_id) - 1) // 12 AS chunk FROM b""",
)
def chunks(spark, sf_dir):
    """Chunks of twelve per source for review, numbered without one task per source."""
    d = corpus.table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    return catalog.chunks(d, "source", 12)


@query(
    "X10_content_identity",
    """SELECT sha256(lang || chr(10) || text) AS content_key, min(doc_id) AS doc_id, count(*) AS copies
    FROM documents GROUP BY 1""",
)
def content_identity(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    return catalog.content_identity(d.select("doc_id", F.col("lang").alias("title"), "text"))


@query(
    "X6_X7_summary",
    """SELECT section_rank, line_rank, count(*) AS lines FROM (
      SELECT 0 AS section_rank, 0 AS line_rank
      UNION ALL SELECT s, l FROM (SELECT unnest([4, 5]) AS s), (SELECT unnest([1, 2]) AS l)
      UNION ALL SELECT 5, 3 FROM documents
      UNION ALL SELECT 4, 3 FROM (SELECT DISTINCT sha256(text) AS t, source FROM documents WHERE text IN
        (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) > 1)))
    GROUP BY ALL""",
)
def flagged_summary(spark, sf_dir):
    """Conflicts and gaps as sections of the change summary."""
    rows = _subject_rows(spark, sf_dir).where(F.col("key") == "source")
    flagged = catalog.conflict_items(catalog.conflicts(rows))
    bare = corpus.base(spark, sf_dir).select(
        identity.doc_id(F.col("system"), F.col("native_id")).alias("doc_id"), "structured",
        F.array().cast("array<string>").alias("opaque_keys"),
    )
    missing = catalog.gap_items(catalog.facet_gaps(bare, ["owner"]))
    none = spark.createDataFrame([], "doc_id string, kind string")
    lines = publish.summary_lines(cn.summary(none, [], flagged, missing))
    return lines.groupBy("section_rank", "line_rank").agg(F.count(F.lit(1)).alias("lines"))


# ---------------------------------------------------------------- keyed log


def _log(df):
    return df.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("event_type").alias("content"),
    )


_EVENT_CHANGES = """SELECT user_id::VARCHAR AS key, event_id, CASE WHEN before IS NULL THEN 'added'
    WHEN before <> event_type THEN 'modified' ELSE 'unchanged' END AS kind
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)"""


@query("T4_event_changes", _EVENT_CHANGES)
def event_changes(spark, sf_dir):
    """Batch twin: key and day windows, with the last content carried between days."""
    return keyed_changes.classify_log(_log(corpus.table(spark, sf_dir, "events")))


@query(
    "T4_null_content",
    """SELECT user_id::VARCHAR AS key, event_id, CASE WHEN rank = 1 THEN 'added'
        WHEN before IS DISTINCT FROM content THEN 'modified' ELSE 'unchanged' END AS kind
      FROM (SELECT *, lag(content) OVER w AS before, row_number() OVER w AS rank
        FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN event_type END AS content FROM events)
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
)
def null_content(spark, sf_dir):
    """A NULL content is a content: it differs from others and from having no row before."""
    e = corpus.table(spark, sf_dir, "events")
    return keyed_changes.classify_log(
        _log(e).withColumn("content", F.when(F.col("event_id") % 4 != 0, F.col("content")))
    )


@query(
    "T2_exact_replays",
    "SELECT event_id, user_id, event_type FROM events",
)
def exact_replays(spark, sf_dir):
    """Every event delivered twice, in one log: the stream passes each on once."""
    e = corpus.table(spark, sf_dir, "events")
    twice = f"{shared_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}"
    e.union(e).write.parquet(f"{twice}/log")
    source = spark.readStream.schema(e.schema).parquet(f"{twice}/log")
    stream = (
        micro_batches.without_replays(source, ["event_id"], "ts", "1 hour")
        .writeStream.format("parquet")
        .option("path", f"{twice}/rows")
        .option("checkpointLocation", f"{twice}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{twice}/rows").select("event_id", "user_id", "event_type")


@query("T4_event_changes_stream", _EVENT_CHANGES)
def event_changes_stream(spark, sf_dir):
    """The same by a stateful stream over the table, run until nothing is left."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    schema = corpus.table(spark, sf_dir, "events").schema
    # the pattern fits a single file as well as a folder of parts
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    out = f"{shared_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}"
    stream = (
        keyed_changes.classify_stream(_log(source))
        .writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return spark.read.schema(keyed_changes.OUTPUT).parquet(f"{out}/rows")


@query(
    "T2_replay_suppression",
    """SELECT count(*) AS events FROM events""",
)
def replay_suppression(spark, sf_dir):
    """A delivered log delivered again: the hash diff finds every event unchanged."""
    e = corpus.table(spark, sf_dir, "events")
    rows = e.select(
        F.lit("log").alias("system"), F.col("event_id").cast("string").alias("native_id"),
        F.col("event_type").alias("title"), F.col("props").alias("text"),
    )
    docs = ch.canonical_documents(rows)
    first = docs.select("doc_id", "content_hash")
    again = ch.diff(docs, first)
    return again.where(F.col("kind") == ch.UNCHANGED).agg(F.count(F.lit(1)).alias("events"))
