"""Registered queries: canonical form, fetch laws, diff, overlay, advance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import hashing, identity, instants, text
from tidemark.operators import changes as ch
from tidemark.plans import corpus
from tidemark.plans.corpus import sql_path, with_states
from tidemark.plans.registry import query

_KEYED = "SELECT did AS doc_id, content_hash, retrieved AS retrieved_epoch, length(text) AS n_text FROM "


def _keyed(df):
    return df.select(
        "doc_id", "content_hash", F.unix_timestamp("retrieved_at").alias("retrieved_epoch"),
        F.length("text").alias("n_text"),
    )


@query("J1_diff", with_states("SELECT did AS doc_id, kind FROM changes"))
def diff(spark, sf_dir):
    return corpus.changes(spark, sf_dir)


@query("A1_change_counts", with_states("SELECT kind, count(*) AS n FROM changes GROUP BY kind"))
def change_counts(spark, sf_dir):
    return ch.change_counts(corpus.changes(spark, sf_dir))


@query(
    "A1_run_summary",
    with_states(
        """SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'modified') AS modified,
        count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'unchanged') AS unchanged,
        count(*) FILTER (kind IN ('added', 'modified', 'removed')) = 0 AS is_noop FROM changes"""
    ),
)
def run_summary(spark, sf_dir):
    return ch.run_summary(corpus.changes(spark, sf_dir))


@query(
    "T2_replay_is_noop",
    with_states(
        """SELECT 0::BIGINT AS added, 0::BIGINT AS modified, 0::BIGINT AS removed,
        (SELECT count(*) FROM live) AS unchanged, true AS is_noop"""
    ),
)
def replay(spark, sf_dir):
    """The fetch again, against the mirror it has just advanced: nothing changes."""
    docs = corpus.fetch(spark, sf_dir)
    after = ch.advance_mirror(corpus.light(corpus.mirror(spark, sf_dir)), corpus.light(docs))
    return ch.run_summary(ch.diff(docs, after))


@query("S13_mirror_read", with_states(_KEYED + "mirror"))
def mirror_read(spark, sf_dir):
    return _keyed(corpus.mirror(spark, sf_dir))


@query("P10_content_hash", with_states("SELECT did AS doc_id, content_hash FROM fetched"))
def content_hash(spark, sf_dir):
    return corpus.fetch(spark, sf_dir).select("doc_id", "content_hash")


@query(
    "P10_content_hash_all",
    f"""WITH {corpus.SQL_BASE}, e AS (SELECT * REPLACE (CASE WHEN n % 11 = 0 THEN text || ' [rev 2]' ELSE text END AS text),
      n % 13 = 0 AS deleted FROM base) SELECT did AS doc_id, {corpus.sql_hash()} AS content_hash FROM e""",
)
def content_hash_all(spark, sf_dir):
    """Of every document, where ``P10_content_hash`` has those of the fetch."""
    return corpus.every(spark, sf_dir).select("doc_id", "content_hash")


@query("J2_overlay", with_states(_KEYED + "overlay"))
def overlay(spark, sf_dir):
    return _keyed(ch.overlay(corpus.mirror(spark, sf_dir), corpus.fetch(spark, sf_dir)))


@query(
    "K1_mirror_advance",
    with_states(
        _KEYED + "(SELECT * FROM mirror WHERE did NOT IN (SELECT did FROM fetched)"
        " UNION ALL BY NAME SELECT * FROM live)"
    ),
)
def mirror_advance(spark, sf_dir):
    return _keyed(ch.advance_mirror(corpus.mirror(spark, sf_dir), corpus.fetch(spark, sf_dir)))


@query("A7_run_scope", with_states("SELECT DISTINCT system FROM fetched"))
def run_scope(spark, sf_dir):
    return ch.run_systems(corpus.fetch(spark, sf_dir))


@query("U2_known_paths", with_states("SELECT path FROM known"))
def known_paths(spark, sf_dir):
    return corpus.states(spark, sf_dir).known


@query(
    "U5_removed_paths",
    with_states(f"SELECT DISTINCT {sql_path('did')} AS path FROM changes WHERE kind = 'removed'"),
)
def removed_paths(spark, sf_dir):
    return ch.removed_paths(corpus.changes(spark, sf_dir))


def _faulty_fetch(spark, sf_dir):
    """Every 50th native id repeats its predecessor's; every 70th is a zero-width space."""
    n = F.col("n")
    rows = corpus.base(spark, sf_dir)
    prior = F.concat(F.lit("docs/"), corpus.text(n - 20), F.lit(".md"))
    return ch.canonical_documents(
        rows.withColumn(
            "native_id",
            F.when(n % 70 == 7, F.concat(F.lit("\u200b"), F.repeat(F.lit(" "), F.col("n").cast("int"))))
            .when((n % 50 == 0) & (n >= 20), prior)
            .otherwise(F.col("native_id")),
        ).withColumn("deleted", n % 13 == 0)
    )


_FAULTY = """f AS (SELECT *, n % 13 = 0 AS gone, source_id || ':' || native AS doc FROM (
  SELECT n, system AS source_id, CASE WHEN n % 70 = 7 THEN chr(8203) || repeat(' ', n::INT)
    WHEN n % 50 = 0 AND n >= 20 THEN 'docs/' || (n - 20) || '.md' ELSE native_id END AS native FROM base))"""


@query(
    "A2_duplicate_ids",
    f"WITH {corpus.SQL_BASE}, {_FAULTY} SELECT doc AS doc_id, count(*) AS copies FROM f GROUP BY doc HAVING count(*) > 1",
)
def duplicate_ids(spark, sf_dir):
    return ch.duplicate_ids(_faulty_fetch(spark, sf_dir))


@query(
    "L1_fetch_contract",
    f"""WITH {corpus.SQL_BASE}, {_FAULTY}
    SELECT doc AS path, 'fetch-contract' AS law, 'more than one record claims this id: ' || doc AS message
      FROM f GROUP BY doc HAVING count(*) > 1
    UNION ALL SELECT doc, 'fetch-contract', 'record without a visible source id: ' || doc FROM f WHERE n % 70 = 7
    UNION ALL SELECT doc, 'fetch-contract', 'deletion reported by a partial fetch: ' || doc FROM f WHERE gone""",
)
def fetch_contract(spark, sf_dir):
    return ch.fetch_contract_failures(_faulty_fetch(spark, sf_dir), complete=False)


@query("L2_stability", "SELECT ''::VARCHAR AS doc_id WHERE false")
def stability(spark, sf_dir):
    """A10: two evaluations from two reads of the given table agree."""
    twice = [
        ch.canonical_documents(corpus.base.__wrapped__(spark, sf_dir)) for _ in range(2)
    ]
    return ch.stability_failures(*twice)


@query(
    "A10_unstable_documents",
    f"""WITH {corpus.SQL_BASE} SELECT did AS doc_id FROM base
    WHERE n % 37 = 0 OR n % 41 = 0 OR n % 43 = 0 OR n % 47 = 0""",
)
def unstable_documents(spark, sf_dir):
    """A10: a normaliser whose second answer has other texts, other grounding, fewer and repeated rows."""
    n = F.col("n")
    rows = corpus.base.__wrapped__(spark, sf_dir)
    second = rows.withColumn("text", F.when(n % 37 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    second = second.withColumn(
        "grounded_by", F.when(n % 41 == 0, F.array(F.lit("ghost:x"))).otherwise(F.col("grounded_by"))
    ).where(n % 43 != 0)
    second = second.unionByName(second.where(n % 47 == 0))
    return ch.stability_failures(ch.canonical_documents(rows), ch.canonical_documents(second.hint("rebalance", "title")))


@query(
    "P1_text_canonical",
    r"""SELECT doc_id,
      regexp_replace(replace(replace(regexp_replace(raw, '^\x{FEFF}', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
        '^\s+|\s+$', '', 'g') AS body
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(65279) ELSE '' END || '  ' ||
      CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10))
           WHEN doc_id % 3 = 1 THEN replace(text, chr(10), chr(13)) ELSE text END || chr(9) || chr(10) AS raw
      FROM documents)""",
)
def text_canonical(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    body = (
        F.when(n % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n")))
        .when(n % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r")))
        .otherwise(F.col("text"))
    )
    raw = F.concat(F.when(n % 2 == 0, "\ufeff").otherwise(""), F.lit("  "), body, F.lit("\t\n"))
    return d.select("doc_id", text.canonical_text(raw).alias("body"))


@query(
    "P1_encodings_hash_alike",
    "SELECT count(*) AS docs, 0::BIGINT AS different FROM documents",
)
def encodings(spark, sf_dir):
    """Re-encoding a document is no change: its canonical text is the same."""
    d = corpus.table(spark, sf_dir, "documents")
    windows = F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    same = text.canonical_text(windows) == text.canonical_text(F.col("text"))
    return d.agg(F.count(F.lit(1)).alias("docs"), F.count_if(~same).alias("different"))


@query(
    "P4_titles",
    """SELECT doc_id, coalesce(nullif(t, ''), native) AS title_or_id, coalesce(nullif(t, ''), left(native, 12)) AS subject_or_id,
      coalesce(nullif(t, ''), split_part(native, '/', -1)) AS title_or_segment
    FROM (SELECT doc_id, 'archive/2024/' || doc_id AS native,
      CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE left(text, 20) END AS t FROM documents)""",
)
def titles(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    native = F.concat(F.lit("archive/2024/"), n.cast("string"))
    t = F.when(n % 4 == 1, "").when(n % 4 > 1, F.left("text", F.lit(20)))
    return d.select(
        "doc_id",
        text.first_nonempty(t, native).alias("title_or_id"),
        text.first_nonempty(t, F.left(native, F.lit(12))).alias("subject_or_id"),
        text.first_nonempty(t, text.last_segment(native)).alias("title_or_segment"),
    )


@query(
    "P11_blank",
    r"""SELECT conv_id, turn, regexp_matches(v, '^[\p{Cf}\p{Cc}\p{Z}]*$') AS blank FROM (
      SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN chr(8203) || chr(160)
        WHEN 3 THEN chr(8288) || ' ' || chr(9) ELSE chr(8203) || left(text, 1) END AS v FROM conversations)""",
)
def blank(spark, sf_dir):
    c = corpus.table(spark, sf_dir, "conversations")
    t = F.col("turn") % 5
    v = (
        F.when(t == 0, F.col("text"))
        .when(t == 1, "")
        .when(t == 2, "\u200b\u00a0")
        .when(t == 3, "\u2060 \t")
        .otherwise(F.concat(F.lit("\u200b"), F.left("text", F.lit(1))))
    )
    return c.select("conv_id", "turn", text.is_blank(v).alias("blank"))


@query(
    "P12_resource_key",
    f"WITH {corpus.SQL_BASE} SELECT did AS doc_id, coalesce(nullif(url, ''), system || ':' || native_id) AS resource FROM base",
)
def resource_key(spark, sf_dir):
    b = corpus.base(spark, sf_dir)
    return b.select(
        identity.doc_id(F.col("system"), F.col("native_id")).alias("doc_id"),
        identity.resource_key(F.col("url"), F.col("system"), F.col("native_id")).alias("resource"),
    )


@query(
    "P13_concept_path",
    f"""SELECT doc_id, {sql_path('q')} AS path FROM (SELECT doc_id, source || ':' ||
      CASE doc_id % 4 WHEN 0 THEN '/a/' || doc_id || '.md' WHEN 1 THEN 'ns:' || doc_id || '/'
        WHEN 2 THEN doc_id || '.md.md' ELSE 'plain' || doc_id END AS q FROM documents)""",
)
def concept_path(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    s = n.cast("string")
    native = (
        F.when(n % 4 == 0, F.concat(F.lit("/a/"), s, F.lit(".md")))
        .when(n % 4 == 1, F.concat(F.lit("ns:"), s, F.lit("/")))
        .when(n % 4 == 2, F.concat(s, F.lit(".md.md")))
        .otherwise(F.concat(F.lit("plain"), s))
    )
    qualified = identity.doc_id(F.col("source"), native)
    return d.select("doc_id", identity.concept_path(qualified).alias("path"))


@query(
    "P17_aware_instants",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch(date_trunc('second', ts))::BIGINT
        WHEN 1 THEN epoch(date_trunc('second', ts))::BIGINT - 19800 END AS instant FROM events""",
)
def aware_instants(spark, sf_dir):
    """Offset-carrying stamps are instants; naive and malformed ones are not."""
    e = corpus.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    local = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    stamp = (
        F.when(k == 0, F.concat(local, F.lit("Z")))
        .when(k == 1, F.concat(local, F.lit("+05:30")))
        .when(k == 2, local)
        .otherwise(F.concat(F.lit("on "), local, F.lit("Z")))
    )
    return e.select(
        "event_id", F.unix_timestamp(instants.aware_instant(stamp)).alias("instant")
    )


@query(
    "S14_instance_keys",
    """SELECT user_id, event_type, left(sha256('{"kind":"' || event_type || '","user":' || user_id || '}'), 8) AS instance_key,
      count(*) AS events FROM events GROUP BY user_id, event_type""",
)
def instance_keys(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    per = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"))
    config = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return per.select(
        "user_id", "event_type", hashing.config_digest(config).alias("instance_key"), "events"
    )
