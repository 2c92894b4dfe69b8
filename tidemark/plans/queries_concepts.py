"""Registered queries: assembly, rendering, laws, publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import facets as fx
from tidemark.functions import frontmatter, identity, text
from tidemark.functions.instants import iso
from tidemark.operators import changes as ch
from tidemark.operators import concepts as cn
from tidemark.operators import laws, prose, publish
from tidemark.plans import corpus
from tidemark.plans.corpus import sql_path, sql_resolution, with_states
from tidemark.plans.registry import query
from tidemark.session import settled

# ---------------------------------------------------------------- facets and type


def _with_fields(spark, sf_dir):
    """Documents with the fields of their label, some empty, nested or owned."""
    d = corpus.table(spark, sf_dir, "documents").alias("d")
    rows = d.join(corpus.table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("doc_id")
    one = F.lit(1)
    return rows.select(
        "doc_id",
        "lang",
        F.to_json(
            F.struct(
                F.when(n % 4 == 0, "").otherwise(F.col("lang")).alias("lang"),
                F.when(n % 6 == 0, F.array(F.col("lang"), F.col("source"))).alias("tags"),
                F.struct(one.alias("x")).alias("nested"),
                F.col("n_chars"),
                F.col("quality"),
                F.col("toxic"),
                F.when(n % 3 == 0, "runbook").when(n % 3 == 1, "").alias("type"),
                F.lit("mine").alias("links"),
            )
        ).alias("structured"),
    )


@query(
    "P14_facets",
    """SELECT doc_id, key, value FROM (
      SELECT d.doc_id, unnest([
        CASE WHEN d.doc_id % 4 <> 0 THEN {'k': 'lang', 'v': '"' || lang || '"'} END,
        CASE WHEN d.doc_id % 6 = 0 THEN {'k': 'tags', 'v': '["' || lang || '","' || source || '"]'} END,
        {'k': 'n_chars', 'v': n_chars::VARCHAR},
        CASE WHEN quality IS NOT NULL THEN {'k': 'quality', 'v': quality::VARCHAR} END,
        CASE WHEN toxic IS NOT NULL THEN {'k': 'toxic', 'v': toxic::VARCHAR} END]) AS f
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), LATERAL (SELECT f.k AS key, f.v AS value)
    WHERE f IS NOT NULL""",
)
def facets(spark, sf_dir):
    rows = _with_fields(spark, sf_dir)
    return rows.select("doc_id", F.explode(fx.facets(F.col("structured"))).alias("key", "value"))


@query(
    "P15_concept_type",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'runbook' ELSE 'concept' END AS type FROM documents",
)
def concept_type(spark, sf_dir):
    return _with_fields(spark, sf_dir).select("doc_id", fx.concept_type(F.col("structured")).alias("type"))


# ---------------------------------------------------------------- assembly and rendering

_RES = sql_resolution("live", "overlay")
_ASSEMBLED = f"""links AS (
  SELECT did, list_sort(list(path)) AS links FROM (
    SELECT did, {sql_path('target')} AS path FROM (SELECT did, unnest(relations) AS target FROM live))
  WHERE path IN (SELECT path FROM known) GROUP BY did),
cited AS (
  SELECT k.owner_id, list([k.gid, k.resource, k.content_hash] ORDER BY k.rank) AS entries
  FROM res_kept k GROUP BY k.owner_id),
assembled AS (
  SELECT {sql_path('l.did')} AS path, l.did, l.title, l.text, l.lang, l.n_chars,
    list_concat([[l.did, coalesce(l.url, l.did), l.content_hash]], coalesce(c.entries, [])) AS sources,
    coalesce(k.links, []) AS links, l.retrieved
  FROM live l LEFT JOIN links k ON k.did = l.did LEFT JOIN cited c ON c.owner_id = l.did)"""


@query(
    "C2_concept_assembly",
    with_states(
        """SELECT path, did AS doc_id, 'concept' AS type, 'lang="' || lang || '",n_chars=' || n_chars AS facets,
        array_to_string(list_transform(sources, lambda s: s[1] || ' ' || s[2]), ',') AS sources,
        array_to_string(links, ',') AS links, retrieved AS generated_at FROM assembled""",
        _RES, _ASSEMBLED,
    ),
)
def concept_assembly(spark, sf_dir):
    concepts = cn.projection_of(corpus.states(spark, sf_dir, with_text=True).assembled)
    return concepts.select(
        "path", "doc_id", "type",
        F.array_join(
            F.transform(
                F.array_sort(F.map_entries("facets")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
            ),
            ",",
        ).alias("facets"),
        F.array_join(
            F.transform("sources", lambda s: F.concat(s["id"], F.lit(" "), s["resource"])), ","
        ).alias("sources"),
        F.array_join("links", ",").alias("links"),
        F.unix_timestamp("generated_at").alias("generated_at"),
    )


@query(
    "P18_frame_render",
    with_states(
        f"""SELECT path, sha256('---' || chr(10) || 'type: "concept"' || chr(10) || 'title: "' || title || '"' || chr(10)
        || 'description: "' || title || '"' || chr(10) || 'generated:' || chr(10) || '  by: "{corpus.ACTOR}"' || chr(10)
        || '  at: "' || strftime(to_timestamp(retrieved) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '.000000+00:00"' || chr(10)
        || '"lang": "' || lang || '"' || chr(10) || '"n_chars": ' || n_chars || chr(10)
        || 'sources:' || chr(10) || array_to_string(list_transform(sources, lambda s: '- id: "' || s[1] || '"' || chr(10)
          || '  resource: "' || s[2] || '"' || chr(10) || '  content_hash: "' || s[3] || '"' || chr(10)), '')
        || CASE WHEN len(links) > 0 THEN 'links:' || chr(10)
          || array_to_string(list_transform(links, lambda p: '- "' || p || '"' || chr(10)), '') ELSE '' END
        || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || text || chr(10)) AS digest FROM assembled""",
        _RES, _ASSEMBLED,
    ),
)
def frame_render(spark, sf_dir):
    files = cn.files_of(corpus.states(spark, sf_dir, with_text=True).assembled)
    return files.select("path", F.sha2("content", 256).alias("digest"))


@query(
    "A5_claims",
    with_states(
        f"""SELECT CASE kind WHEN 'added' THEN 'Added' WHEN 'modified' THEN 'Modified' ELSE 'Removed' END AS section,
        {sql_path('did')} AS item FROM changes WHERE kind IN ('added', 'modified', 'removed')"""
    ),
)
def claims(spark, sf_dir):
    return cn.claims(corpus.changes(spark, sf_dir))


@query(
    "A5_sources_changed",
    with_states(
        "SELECT did AS doc_id, system, native_id, url, content_hash, retrieved AS retrieved_at FROM live"
    ),
)
def sources_changed(spark, sf_dir):
    live = corpus.fetch(spark, sf_dir).where(~F.col("deleted"))
    return cn.sources_changed(live).withColumn("retrieved_at", F.unix_timestamp("retrieved_at"))


@query(
    "K7_summary_lines",
    with_states(
        f"""SELECT 0 AS section_rank, 0 AS line_rank, '# Proposed change' AS line
        UNION ALL SELECT DISTINCT r, 1, '' FROM items
        UNION ALL SELECT DISTINCT r, 2, '## ' || section FROM items
        UNION ALL SELECT r, 3, '- ' || item FROM items""",
        f"""items AS (SELECT CASE kind WHEN 'added' THEN 1 WHEN 'modified' THEN 2 ELSE 3 END AS r,
          CASE kind WHEN 'added' THEN 'Added' WHEN 'modified' THEN 'Modified' ELSE 'Removed' END AS section,
          {sql_path('did')} AS item FROM changes WHERE kind IN ('added', 'modified', 'removed'))""",
    ),
)
def summary_lines(spark, sf_dir):
    return publish.summary_lines(cn.summary(corpus.changes(spark, sf_dir), []))


@query(
    "P19_prompts",
    with_states(
        """SELECT did AS doc_id, sha256('Document: ' || native_id || chr(10) || 'Title: ' || title || chr(10)
          || 'Facets:' || chr(10) || 'lang: "' || lang || '"' || chr(10) || 'n_chars: ' || n_chars || chr(10) || chr(10)
          || 'Text:' || chr(10) || left(text, 5000)) AS prompt_hash,
        (CASE WHEN length(text) > 5000 THEN 1 ELSE 0 END)::BIGINT AS notes FROM live"""
    ),
)
def prompts(spark, sf_dir):
    """P20 too: texts beyond the limit are cut, each with a note."""
    live = corpus.fetch(spark, sf_dir).where(~F.col("deleted"))
    return prose.prompts(live, None, 5000).select(
        "doc_id", F.sha2("prompt", 256).alias("prompt_hash"), F.size("notes").cast("bigint").alias("notes")
    )


@query(
    "P19_source_fields",
    """SELECT doc_id::VARCHAR AS doc_id, sha256('Document: ' || doc_id || chr(10) || 'Title: T' || chr(10) || 'Facets:' || chr(10)
        || CASE WHEN doc_id % 4 = 3 THEN '(none)' ELSE 'by: {"lang":"' || lang || '","n":[' || n_chars || ',[]]}' || chr(10) || 'empty: ""' || chr(10)
          || 'none: []' || chr(10) || 'plain: ' || doc_id END
        || chr(10) || chr(10) || 'Text:' || chr(10) || text) AS prompt_hash FROM documents""",
)
def source_fields(spark, sf_dir):
    """Nested, empty and plain fields are all shown; a document without any says so."""
    d = corpus.table(spark, sf_dir, "documents")
    own = F.concat(
        F.lit('{"by":{"lang":"'), "lang", F.lit('","n":['), F.col("n_chars").cast("string"),
        F.lit(',[]]},"empty":"","none":[],"plain":'), F.col("doc_id").cast("string"), F.lit("}"),
    )
    items = d.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("native_id"),
        F.lit("T").alias("title"), "text", F.when(F.col("doc_id") % 4 == 3, "{}").otherwise(own).alias("structured"),
    )
    return prose.prompts(items, None).select("doc_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query(
    "P21_echoed_heading",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'body' || doc_id WHEN doc_id % 3 = 1 THEN '## Other' || chr(10) || 'body' || doc_id
      ELSE '' END AS body FROM documents""",
)
def echoed_heading(spark, sf_dir):
    n = F.col("doc_id")
    s = n.cast("string")
    body = (
        F.when(n % 3 == 0, F.concat(F.lit("\n# dOCUMENT "), s, F.lit("\n\nbody"), s))
        .when(n % 3 == 1, F.concat(F.lit("## Other\nbody"), s))
        .otherwise(F.concat(F.lit("### Document "), s))
    )
    title = F.concat(F.lit("Document "), s)
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", text.without_echoed_heading(body, title).alias("body")
    )


@query(
    "P22_actors",
    "SELECT doc_id, 'tidemark/' || split_part(source || '/' || lang || '-' || doc_id, '/', -1) AS actor FROM documents",
)
def actors(spark, sf_dir):
    model = F.concat("source", F.lit("/"), "lang", F.lit("-"), F.col("doc_id").cast("string"))
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", text.actor("tidemark", model).alias("actor")
    )


def _shout(batch):
    """A stand-in generator: says little, and drops every prompt whose id ends in 3."""
    kept = batch[~batch["doc_id"].str.contains(r"3\.md$")].copy()
    lines = kept["prompt"].str.split("\n", n=1).str[0]
    whole = kept["prompt"].str.split("\n\nText:\n", n=1).str[1].str.len().astype(str)
    return kept.assign(title=kept["doc_id"], description=lines, body="# " + kept["doc_id"] + "\n" + whole)


@query(
    "C4_batch_prose",
    with_states(
        """SELECT did AS doc_id, did AS title, 'Document: ' || native_id AS description, length(text)::VARCHAR AS body
        FROM live WHERE did NOT LIKE '%3.md'"""
    ),
)
def batch_prose(spark, sf_dir):
    live = corpus.fetch(spark, sf_dir).where(~F.col("deleted"))
    generator = prose.Generator(write=_shout, model="vendor/small-1")
    return prose.finished(prose.generate(prose.prompts(live, None), generator))


@query(
    "E5_prose_rejects",
    """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'title must be non-empty'
      WHEN doc_id % 7 = 0 THEN 'body must be non-empty' END AS reject_reason
    FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""",
)
def prose_rejects(spark, sf_dir):
    n = F.col("doc_id")
    rows = corpus.table(spark, sf_dir, "documents").select(
        n.cast("string").alias("doc_id"),
        F.when(n % 5 == 0, " \n").otherwise("t").alias("title"),
        F.lit("d").alias("description"),
        F.when(n % 7 == 0, F.lit(None).cast("string")).otherwise("b").alias("body"),
    )
    return prose.prose_rejects(rows)


# ---------------------------------------------------------------- laws


def _flawed(spark, sf_dir):
    """Concept projections of all documents, each flaw on its own residue of the number."""
    n = F.col("n")
    b = corpus.base(spark, sf_dir)
    did = identity.doc_id(F.col("system"), F.col("native_id"))
    source = F.struct(
        did.alias("id"), did.alias("resource"), F.lit("0").alias("content_hash")
    )
    return b.select(
        "n",
        identity.concept_path(did).alias("path"),
        did.alias("doc_id"),
        F.when(n % 31 == 0, "\u200b").otherwise("concept").alias("type"),
        F.when(n % 29 == 0, F.create_map(F.lit("owner"), F.lit('""'), F.lit("deep"), F.lit('{"a":1}')))
        .when(n % 29 == 1, F.create_map(F.lit("tags"), F.lit('["a",null]'), F.lit("zero"), F.lit("0")))
        .otherwise(F.create_map(F.lit("tags"), F.lit('["a",1,true]')))
        .alias("facets"),
        F.when(n % 37 == 0, F.slice(F.array(source), 1, 0)).otherwise(F.array(source)).alias("sources"),
        F.transform("relations", identity.concept_path).alias("links"),
        F.when(n % 41 != 0, F.col("retrieved_at")).alias("generated_at"),
        F.lit(corpus.ACTOR).alias("generated_by"),
    )


_FLAWED = f"flawed AS (SELECT n, did, {sql_path('did')} AS path, relations, retrieved FROM base)"


def _flaw_sql(select: str) -> str:
    return f"WITH {corpus.SQL_BASE}, {_FLAWED} {select}"


@query(
    "L5_type",
    _flaw_sql(
        "SELECT path, 'okf-type' AS law, 'no visible type' AS message FROM flawed WHERE n % 31 = 0"
    ),
)
def type_law(spark, sf_dir):
    return laws.type_failures(_flawed(spark, sf_dir))


_FACET_SQL = """SELECT path, 'facet-wellformedness' AS law, 'facet ''owner'' has no value to filter by' AS message
      FROM flawed WHERE n % 29 = 0
    UNION ALL SELECT path, 'facet-wellformedness', 'facet ''deep'' is nested: only single values and flat lists can be filtered' FROM flawed WHERE n % 29 = 0
    UNION ALL SELECT path, 'facet-wellformedness', 'facet ''tags'' is nested: only single values and flat lists can be filtered' FROM flawed WHERE n % 29 = 1"""


@query("L6_facets", _flaw_sql(_FACET_SQL))
def facet_law(spark, sf_dir):
    return laws.facet_failures(_flawed(spark, sf_dir))


@query(
    "L7_anchors",
    _flaw_sql("SELECT path, 'anchor-presence' AS law, 'nothing is cited as a source' AS message FROM flawed WHERE n % 37 = 0"),
)
def anchor_law(spark, sf_dir):
    return laws.anchor_failures(_flawed(spark, sf_dir))


@query(
    "L8_freshness",
    _flaw_sql(
        """SELECT path, 'freshness-legibility' AS law, CASE WHEN n % 41 = 0 THEN 'no time of generation'
          ELSE 'time of generation without a zone' END AS message FROM flawed WHERE n % 41 = 0 OR n % 43 = 0"""
    ),
)
def freshness_law(spark, sf_dir):
    stamped = _flawed(spark, sf_dir).withColumn(
        "generated_at",
        F.when(F.col("n") % 43 == 0, F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss")).otherwise(
            iso(F.col("generated_at"))
        ),
    )
    return laws.freshness_failures(stamped)


_LINK_SQL = f"""SELECT path, 'link-resolvability' AS law, 'link ''' || link || ''' leads to no published path' AS message
    FROM (SELECT path, {sql_path('t')} AS link FROM (SELECT path, unnest(relations) AS t FROM flawed))
    WHERE link NOT IN (SELECT path FROM flawed)"""


@query("L9_links", _flaw_sql(_LINK_SQL))
def link_law(spark, sf_dir):
    concepts = _flawed(spark, sf_dir)
    return laws.dangling_links(concepts, concepts.select("path"))


def _flawed_files(spark, sf_dir):
    """Rendered files that disagree with their projections in one way each."""
    c = _flawed(spark, sf_dir)
    n = F.col("n")
    shown = c.withColumn(
        "sources_shown",
        F.when(n % 53 == 1, F.slice("sources", 1, 0))
        .when(
            n % 53 == 2,
            F.transform("sources", lambda s: F.struct(s["id"].alias("id"), F.lit("\u200b").alias("resource"),
                                                     s["content_hash"].alias("content_hash"))),
        )
        .when(
            n % 53 == 3,
            F.transform("sources", lambda s: F.struct(s["id"].alias("id"), F.lit("https://else").alias("resource"),
                                                     s["content_hash"].alias("content_hash"))),
        )
        .otherwise(F.col("sources")),
    )
    title = F.when(n % 53 == 5, " ").otherwise(F.concat(F.lit("Document "), n.cast("string")))
    front = frontmatter.head(
        type_=F.when(n % 53 == 4, "other").when(n % 53 == 13, "").otherwise("concept"),
        title=title,
        description=F.when(n % 53 == 6, "").otherwise("d"),
        generated_by=F.when(n % 53 == 7, "").otherwise(F.lit(corpus.ACTOR)),
        generated_at=F.when(n % 53 == 8, F.lit(None).cast("timestamp"))
        .when(n % 53 == 9, F.col("retrieved") + F.expr("interval 1 second"))
        .otherwise(F.col("retrieved")),
        facets=F.col("facets"),
        sources=F.col("sources_shown"),
        links=F.when(n % 53 == 10, F.slice("links", 1, 0)).otherwise(F.col("links")),
    )
    content = F.col("content")
    retrieved = F.timestamp_seconds(F.lit(1704067200) + n * 60)
    headed = shown.withColumn("retrieved", retrieved).withColumn("front", front)
    written = headed.withColumn("content", frontmatter.rendered(F.col("front"), title, F.lit("body")))
    return written.select(
        "n",
        "path",
        F.when(n % 53 == 11, "no front matter at all")
        .when(n % 53 == 12, F.regexp_replace(content, r"generated:\n[^\n]*\n[^\n]*\n", "generated: soon\n"))
        .when(n % 53 == 14, F.regexp_replace(content, r"\.000000\+00:00", ""))
        .when(n % 53 == 15, F.concat(F.lit("---\ntype: [unclosed\n---\n"), F.lit("x")))
        .otherwise(content)
        .alias("content"),
    )


def _whole(spark, sf_dir):
    """Projections without the flaws of the projection laws."""
    n = F.col("n")
    did = F.col("doc_id")
    return _flawed(spark, sf_dir).withColumns(
        {
            "type": F.lit("concept"),
            "sources": F.array(F.struct(did.alias("id"), did.alias("resource"), F.lit("0").alias("content_hash"))),
            "generated_at": F.timestamp_seconds(F.lit(1704067200) + n * 60),
            "facets": F.create_map(F.lit("tags"), F.lit('["a",1,true]')),
        }
    )


def _missing(field: str) -> str:
    return f"front matter lacks ''{field}''"


_STRICT = f"""strict AS (SELECT path, unnest(CASE n % 53
    WHEN 2 THEN ['an entry of ''sources'' names no resource']
    WHEN 3 THEN ['''sources'' and checked anchors name different resources']
    WHEN 4 THEN ['''type'' is another than the metadata''s']
    WHEN 1 THEN ['''sources'' lists nothing']
    WHEN 5 THEN ['{_missing('title')}']
    WHEN 6 THEN ['{_missing('description')}']
    WHEN 7 THEN ['''generated.by'' names nobody']
    WHEN 8 THEN ['''generated.at'' has no time']
    WHEN 9 THEN ['''generated.at'' is another time than the metadata''s']
    WHEN 10 THEN ['''links'' are others than the metadata''s']
    WHEN 12 THEN ['''generated'' is no block with ''by'' and ''at''']
    WHEN 13 THEN ['{_missing('type')}']
    WHEN 14 THEN ['''generated.at'' is no ISO 8601 time with a zone']
    ELSE CASE WHEN n % 53 IN (11, 15) THEN ['{_missing('type')}', '{_missing('title')}', '{_missing('description')}',
        '{_missing('generated')}', '''sources'' lists nothing',
        '''links'' are others than the metadata''s'] ELSE [] END END) AS message
    FROM flawed WHERE n % 37 <> 0)"""


@query(
    "L11_L14_strict",
    f"WITH {corpus.SQL_BASE}, {_FLAWED}, {_STRICT} SELECT path, 'okf-strict' AS law, message FROM strict",
)
def strict_law(spark, sf_dir):
    """The rendered file alone, and against its projection."""
    n = F.col("n")
    good = _whole(spark, sf_dir)
    files = _flawed_files(spark, sf_dir)
    # every 37th projection of the flawed set has no source, so its file has none either
    return laws.strict_failures(
        files.where(n % 37 != 0).select("path", "content"), good.where(n % 37 != 0)
    )


def _coherence(spark, sf_dir):
    c = _flawed(spark, sf_dir)
    n = F.col("n")
    index = F.regexp_replace("path", r"overview\.md\z", "index.md")
    written = c.where(n % 9 != 0).select(F.when(n % 9 == 1, index).otherwise(F.col("path")).alias("path"))
    projected = c.where((n % 11 != 0) & (n % 9 != 1)).select("path")
    removed = c.where(n % 13 == 0).select("path")
    return written, projected, removed


_COHERENCE_SQL = """SELECT path, 'projection-coherence' AS law, 'file without checked metadata' AS message
      FROM flawed WHERE n % 9 NOT IN (0, 1) AND n % 11 = 0
    UNION ALL SELECT path, 'projection-coherence', 'metadata without a file'
      FROM flawed WHERE n % 11 <> 0 AND n % 9 = 0
    UNION ALL SELECT path, 'projection-coherence', 'one proposal writes and deletes this path'
      FROM flawed WHERE n % 9 NOT IN (0, 1) AND n % 13 = 0"""


@query("L10_coherence", _flaw_sql(_COHERENCE_SQL))
def coherence_law(spark, sf_dir):
    """J9 and U3."""
    return laws.coherence_failures(*_coherence(spark, sf_dir))


@query(
    "L15_gate",
    with_states(
        "SELECT law, count(*) AS failures FROM (SELECT 'x' AS law WHERE false) GROUP BY law"
    ),
)
def gate_clean(spark, sf_dir):
    """What assembly produces passes every law."""
    st = corpus.states(spark, sf_dir, with_text=True)
    made = settled(st.assembled)
    failures = laws.gate(
        cn.files_of(made), cn.projection_of(made), ch.removed_paths(st.changes), settled(st.known)
    )
    return failures.groupBy("law").agg(F.count(F.lit(1)).alias("failures"))


@query(
    "L15_gate_flawed",
    f"""WITH {corpus.SQL_BASE}, {_FLAWED}
    SELECT law, count(*) AS failures FROM (
      SELECT 'okf-type' AS law FROM flawed WHERE n % 31 = 0
      UNION ALL SELECT 'anchor-presence' FROM flawed WHERE n % 37 = 0
      UNION ALL SELECT 'freshness-legibility' FROM flawed WHERE n % 41 = 0
      UNION ALL SELECT law FROM ({_FACET_SQL}) UNION ALL SELECT law FROM ({_LINK_SQL})
      UNION ALL SELECT 'projection-coherence' FROM flawed
      UNION ALL SELECT 'vocabulary' FROM flawed WHERE n % 31 = 0) GROUP BY law""",
)
def gate_flawed(spark, sf_dir):
    """X11: all artifact laws and an added one, over projections without any file."""
    concepts = settled(_flawed(spark, sf_dir).drop("n"))
    none = concepts.where(F.lit(False)).select("path", F.lit("").alias("content"))
    types = spark.createDataFrame([("concept",)], "type string")
    failures = laws.gate(none, concepts, none.select("path"), none.select("path"), [laws.vocabulary_law(types)])
    return failures.groupBy("law").agg(F.count(F.lit(1)).alias("failures"))


@query(
    "X8_facet_survival",
    f"""WITH {corpus.SQL_BASE} SELECT {sql_path('did')} AS path, 'facet-survival' AS law,
      'source field ''' || unnest(['lang', 'n_chars']) || ''' did not become a facet' AS message FROM base""",
)
def facet_survival(spark, sf_dir):
    docs = ch.canonical_documents(corpus.base(spark, sf_dir))
    return laws.facet_survival_failures(docs, _flawed(spark, sf_dir))


@query(
    "X8_body_links",
    """SELECT DISTINCT 'concepts/p/' || page_id || '/overview.md' AS path, 'concepts/p/' || (page_id // 2) || '/overview.md' AS link
    FROM pages""",
)
def body_links(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "pages")
    half = F.floor(F.col("page_id") / 2).cast("string")
    path = F.concat(F.lit("concepts/p/"), F.col("page_id").cast("string"), F.lit("/overview.md"))
    content = F.concat(
        F.lit("---\ntype: x\n---\n\nsee [it](/concepts/p/"), half, F.lit("/overview.md#top) and [web]("),
        F.col("url"), F.lit(")"),
    )
    return laws.body_links(p.select(path.alias("path"), content.alias("content")))


def _sensitive_sql() -> str:
    parts = []
    for law, patterns in (("secrets", laws.SECRETS), ("personal-data", laws.PERSONAL)):
        for kind, pattern in patterns.items():
            parts.append(
                f"SELECT 'concepts/' || doc_id AS path, '{law}' AS law, 'text holds a {kind}' AS message "
                f"FROM documents WHERE regexp_matches(text, '{pattern}')"
            )
    return " UNION ALL ".join(parts)


@query("X11_sensitive_text", _sensitive_sql())
def sensitive_text(spark, sf_dir):
    """Both content laws over every whole text."""
    d = corpus.table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("concepts/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    secret = laws.content_law("secrets", laws.SECRETS)(files, files)
    return secret.unionByName(laws.content_law("personal-data", laws.PERSONAL)(files, files))


# ---------------------------------------------------------------- publication


@query(
    "P23_path_safety",
    """SELECT path, action, reason AS reject_reason FROM (
      SELECT unnest(CASE page_id % 5 WHEN 0 THEN [{'p': '', 'r': 'empty file path'}]
        WHEN 1 THEN [{'p': '/etc/' || page_id, 'r': 'absolute path not allowed'}]
        WHEN 2 THEN [{'p': 'a/../' || page_id, 'r': '''..'' not allowed in path'}] ELSE [] END) AS x,
        CASE WHEN page_id % 2 = 0 THEN 'write' ELSE 'remove' END AS action FROM pages),
      LATERAL (SELECT x.p AS path, x.r AS reason)""",
)
def path_safety(spark, sf_dir):
    k = F.col("page_id")
    s = k.cast("string")
    rows = corpus.table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("/etc/"), s))
        .when(k % 5 == 2, F.concat(F.lit("a/../"), s)).otherwise(F.concat(F.lit("a/..b/"), s)).alias("path"),
    )
    return publish.path_rejects(rows.where(k % 2 == 0), rows.where(k % 2 == 1))


@query(
    "P23_joined_paths",
    "SELECT page_id, 'kb/docs/p' || page_id || '.md' AS path FROM pages",
)
def joined_paths(spark, sf_dir):
    k = F.col("page_id").cast("string")
    raw = F.concat(F.lit("./docs//./p"), k, F.lit(".md"))
    return corpus.table(spark, sf_dir, "pages").select(
        "page_id", identity.joined_path("kb/", raw).alias("path")
    )


def _proposal(spark, sf_dir):
    n = F.col("doc_id")
    d = corpus.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("concepts/"), n.cast("string"), F.lit("/overview.md"))
    files = d.where(n % 3 == 0).select(path.alias("path"), F.col("text").alias("content"))
    removed = d.where(n % 3 == 1).select(path.alias("path"))
    state = d.where(n % 2 == 0).select(
        F.lit("main").alias("branch"), path.alias("path"), F.lit("old").alias("content")
    ).unionByName(
        d.where(n % 5 == 0).select(
            F.lit("sync/src1").alias("branch"), path.alias("path"), F.lit("open").alias("content")
        )
    )
    return files, removed, state


@query(
    "K5_action_plan",
    """SELECT 'concepts/' || doc_id || '/overview.md' AS path, CASE WHEN doc_id % 3 = 1 THEN 'delete'
        WHEN doc_id % 2 = 0 THEN 'update' ELSE 'create' END AS action,
      CASE WHEN doc_id % 3 = 0 THEN length(text) END AS n_content
    FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 2 = 0)""",
)
def action_plan(spark, sf_dir):
    files, removed, state = _proposal(spark, sf_dir)
    plan = publish.action_plan(files, removed, state.where(F.col("branch") == "main"))
    return plan.select("path", "action", F.length("content").alias("n_content"))


@query(
    "K6_accumulation",
    """SELECT 'sync/src1' AS branch, 'concepts/' || doc_id || '/overview.md' AS path,
      CASE WHEN doc_id % 3 = 0 THEN length(text) ELSE 4 END AS n_content
    FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 = 2 AND doc_id % 5 = 0)""",
)
def accumulation(spark, sf_dir):
    """An open proposal: the branch builds on itself, not on the default branch."""
    files, removed, state = _proposal(spark, sf_dir)
    proposals = spark.createDataFrame(
        [("sync/src1", "open", "r1")], "branch string, state string, run_id string"
    )
    base = publish.open_base(proposals, "sync/src1", "main")
    after = publish.accumulate(state, "sync/src1", base, files, removed)
    return after.select("branch", "path", F.length("content").alias("n_content"))


@query(
    "K8_partial_listings",
    "SELECT source AS branch FROM documents GROUP BY source HAVING NOT bool_and(n_chars > 120)",
)
def partial_listings(spark, sf_dir):
    listing = corpus.table(spark, sf_dir, "documents").select(
        F.col("source").alias("branch"), (F.col("n_chars") > 120).alias("complete")
    )
    return publish.listing_failures(listing)


_VALIDATED = r"""
WITH t AS (SELECT doc_id, text || ' ref ' || card || ', host ' || host || '. api_key = "' || token || '".' AS body, card, host, token
  FROM (SELECT doc_id, text,
      CASE doc_id % 4 WHEN 0 THEN '4539 5787 6362 1486' WHEN 1 THEN '4539578763621487' WHEN 2 THEN '378282246310005' ELSE '12345678901234567890' END AS card,
      CASE doc_id % 3 WHEN 0 THEN '10.0.255.1' WHEN 1 THEN '10.0.256.1' ELSE '1.2.3' END AS host,
      CASE doc_id % 5 WHEN 0 THEN 'aaaaaaaaaaaaaaaaaaaaaaaa' WHEN 1 THEN 'q7Zk2Lm9Xw4Rt8Vb1Nc6Yd3P' ELSE 'short' END AS token FROM documents))
SELECT 'files/' || doc_id AS path, 'validated-content' AS law, 'text holds 1 x ' || kind AS message
FROM (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 4 IN (0, 2) THEN 'card number' END,
    CASE WHEN doc_id % 3 = 0 THEN 'network address' END, CASE WHEN doc_id % 5 = 1 THEN 'random token' END],
    lambda x: x IS NOT NULL)) AS kind FROM t)"""


@query("X11_validated_plants", _VALIDATED)
def validated_plants(spark, sf_dir):
    """Numbers, addresses and tokens put into every text: valid ones are told from those that only look alike."""
    n = F.col("doc_id")

    def choice(modulus, *values):
        out = F.lit(values[-1])
        for k, v in enumerate(values[:-1]):
            out = F.when(n % modulus == k, F.lit(v)).otherwise(out)
        return out

    card = choice(4, "4539 5787 6362 1486", "4539578763621487", "378282246310005", "12345678901234567890")
    host = choice(3, "10.0.255.1", "10.0.256.1", "1.2.3")
    token = choice(5, "a" * 24, "q7Zk2Lm9Xw4Rt8Vb1Nc6Yd3P", "short")
    planted = F.concat(F.lit(" ref "), card, F.lit(", host "), host, F.lit('. api_key = "'), token, F.lit('".'))
    # the texts' own hits are the next query's
    text_ = F.regexp_replace("text", "[0-9]", "")
    files = corpus.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("files/"), n.cast("string")).alias("path"), F.concat(text_, planted).alias("content")
    )
    return laws.validated_law()(files, files)


@query(
    "X11_validated_addresses",
    r"""SELECT doc_id, len(list_filter(regexp_extract_all(regexp_replace(text, '([0-9.]+)', ' \1 ', 'g'), ' ([0-9]{1,3}(\.[0-9]{1,3}){3})\.* ', 1),
      lambda a: len(list_filter(string_split(a, '.'), lambda p: p::INT > 255)) = 0))::BIGINT AS addresses FROM documents""",
)
def validated_addresses(spark, sf_dir):
    """Network addresses of the texts as they are, each part in range."""
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(laws.validated(F.col("text"))["network address"]).cast("bigint").alias("addresses"))
