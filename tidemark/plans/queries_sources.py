"""Registered queries: sources, identity, response mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.operators.changes import canonical_documents
from tidemark.plans import corpus
from tidemark.plans.registry import query
from tidemark.session import settled
from tidemark.sources import commits, issues, markdown, responses

# ---------------------------------------------------------------- identity


def _esc(e: str) -> str:
    for c in identity.UNSAFE_CHARACTERS:
        e = f"replace({e}, '{c}', '%{ord(c):02X}')"
    return e


def _identity_sql(source: str) -> str:
    """The id rules for http(s) URLs and plain paths, in SQL."""
    return f"""parsed AS (
  SELECT raw_id, regexp_matches(raw_id, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS is_url,
    regexp_extract(raw_id, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) AS authority,
    CASE WHEN regexp_matches(raw_id, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')
      THEN regexp_extract(raw_id, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) ELSE raw_id END AS path,
    regexp_extract(raw_id, '^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*(\\?[^#]+)', 1) AS q,
    regexp_extract(raw_id, '^[A-Za-z][A-Za-z0-9+.-]*://[^#]*(#.+)$', 1) AS frag FROM {source}),
segs AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')) AS s FROM parsed),
lasts AS (SELECT *, CASE WHEN len(s) > 0
    THEN regexp_replace(s[-1], '(?i)\\.(md|markdown|mdx|txt|rst|adoc|asciidoc|htm|html|xhtml)$', '') END AS stem,
  CASE WHEN is_url THEN q || frag ELSE '' END AS tail FROM segs),
built AS (SELECT *, list_concat(CASE WHEN is_url THEN ['@' || {_esc('lower(authority)')}] ELSE [] END,
    list_transform(CASE WHEN len(s) > 0 THEN list_concat(s[1:len(s) - 1], [stem || tail]) WHEN tail <> '' THEN [tail]
      ELSE []::VARCHAR[] END, lambda x: regexp_replace({_esc('x')}, '\\.$', '%2E'))) AS pieces FROM lasts),
ids AS (SELECT raw_id, is_url,
  CASE WHEN raw_id = '' THEN 'document id is empty'
    WHEN len(list_filter(s, lambda x: regexp_matches(x, '(?i)^(\\.|%2e)(\\.|%2e)$'))) > 0 THEN 'document id escapes the bundle'
    WHEN stem = '' THEN 'document id has no content beyond its extension'
    WHEN len(pieces) = 0 THEN 'document id has no path content' END AS reason,
  regexp_replace(array_to_string(pieces, '/'), '\\.md$', '%2Emd') AS slug FROM built)"""


def _odd_ids(spark, sf_dir):
    """Page URLs, a plain-path form of each third one, and ids that must be refused."""
    p = corpus.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return p.select(
        F.when(k % 12 == 1, F.concat(F.lit("docs/"), k.cast("string"), F.lit(".md.md")))
        .when(k % 12 == 2, F.concat(F.lit("SPACE:page "), k.cast("string"), F.lit(".HTML")))
        .when(k % 12 == 3, F.concat(F.lit("a/%2E./"), k.cast("string")))
        .when(k % 12 == 4, F.concat(F.lit("./x//"), k.cast("string"), F.lit("/.md")))
        .when(k % 12 == 5, F.concat(F.lit("v"), k.cast("string"), F.lit(".")))
        .when(k % 12 == 6, bare)
        .when(k % 12 == 7, F.concat(F.upper("url"), F.lit("?x=a.md")))
        .when(k % 12 == 8, F.concat(F.repeat(F.lit("/"), (k % 3 + 1).cast("int"))))
        .otherwise(F.col("url"))
        .alias("raw_id")
    )


_ODD = """odd AS (SELECT CASE page_id % 12 WHEN 1 THEN 'docs/' || page_id || '.md.md'
  WHEN 2 THEN 'SPACE:page ' || page_id || '.HTML' WHEN 3 THEN 'a/%2E./' || page_id
  WHEN 4 THEN './x//' || page_id || '/.md' WHEN 5 THEN 'v' || page_id || '.'
  WHEN 6 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 7 THEN upper(url) || '?x=a.md'
  WHEN 8 THEN repeat('/', (page_id % 3 + 1)::INT) ELSE url END AS raw_id FROM pages)"""


@query(
    "P16_identity",
    f"WITH {_ODD}, {_identity_sql('odd')} SELECT raw_id, CASE WHEN reason IS NULL THEN slug END AS native_id, reason AS reject_reason, is_url FROM ids",
)
def identity_job(spark, sf_dir):
    return identity.with_identity(_odd_ids(spark, sf_dir))


@query(
    "A4_id_collisions",
    f"""WITH both_forms AS (SELECT url AS raw_id FROM pages
      UNION ALL SELECT replace(url, 'http://', 'https://') || CASE WHEN page_id % 2 = 0 THEN '' ELSE 'x' END FROM pages),
    {_identity_sql('both_forms')}
    SELECT slug AS native_id, min(raw_id) AS first_id, max(raw_id) AS last_id, count(*) AS ids FROM ids
    WHERE reason IS NULL GROUP BY slug HAVING count(*) > 1""",
)
def id_collisions(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "pages")
    secure = F.replace("url", F.lit("http://"), F.lit("https://"))
    twin = F.concat(secure, F.when(F.col("page_id") % 2 == 0, "").otherwise("x"))
    ids = p.select(F.col("url").alias("raw_id")).unionByName(p.select(twin.alias("raw_id")))
    return responses.id_collisions(ids)


@query(
    "S6_enumerated_refs",
    f"""WITH urls AS (SELECT url AS raw_id FROM pages), {_identity_sql('urls')}
    SELECT raw_id, slug AS native_id, raw_id AS url, NULL::VARCHAR AS title, NULL::VARCHAR AS reject_reason FROM ids""",
)
def enumerated(spark, sf_dir):
    return responses.enumerated(
        corpus.table(spark, sf_dir, "pages").select(F.col("url").alias("raw_id"))
    )


# ---------------------------------------------------------------- files


@query(
    "S2_ignore_globs",
    """SELECT page_id, p AS path FROM (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'a/.venv/lib/' || page_id || '.md'
        WHEN 1 THEN 'drafts/deep/' || page_id || '.md' WHEN 2 THEN 'notes/_draft' || page_id || '.md'
        WHEN 3 THEN 'my.venv/' || page_id || '.md' WHEN 4 THEN 'x/v1.tmp/' || page_id || '.md'
        ELSE 'docs/' || page_id || '.md' END AS p FROM pages)
    WHERE page_id % 7 NOT IN (0, 1, 2, 4)""",
)
def ignore_globs(spark, sf_dir):
    k = F.col("page_id")
    s = k.cast("string")

    def at(prefix):
        return F.concat(F.lit(prefix), s, F.lit(".md"))

    rows = corpus.table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(k % 7 == 0, at("a/.venv/lib/")).when(k % 7 == 1, at("drafts/deep/"))
        .when(k % 7 == 2, at("notes/_draft")).when(k % 7 == 3, at("my.venv/"))
        .when(k % 7 == 4, at("x/v1.tmp/")).otherwise(at("docs/")).alias("path"),
    )
    return rows.where(~markdown.is_ignored(F.col("path"), ["drafts/*", "_draft*", "v[0-9].*"]))


def _markdown_files(spark, sf_dir):
    """Documents as markdown files with front matter in several states of repair."""
    n = F.col("doc_id")
    s = n.cast("string")
    head = F.concat(
        F.lit("---\ntype: note\ntitle: Page "), s, F.lit("\nlang: "), F.col("lang"),
        F.lit("\nsize: "), F.col("n_chars").cast("string"), F.lit("\nsince: 2024-05-01\nrelations: ["),
        s, F.lit(".md, "), s, F.lit(".md, 7, b.md]\ngrounded_by:\n- other:"), s,
        F.lit("\n- bare\n- ':x'\nlinks: mine\n---\n\n"),
    )
    front = (
        F.when(n % 5 == 0, "")
        .when(n % 5 == 1, "---\na: b: c\n---\n")
        .when(n % 5 == 2, "---\nunclosed: yes\n")
        .when(n % 5 == 3, "---\n- a list\n---\n")
        .otherwise(head)
    )
    content = F.concat(F.when(n % 2 == 0, "﻿").otherwise(""), front, F.col("text"))
    crlf = F.when(n % 3 == 0, F.replace(content, F.lit("\n"), F.lit("\r\n"))).otherwise(content)
    return corpus.table(spark, sf_dir, "documents").select(
        F.concat(s, F.lit(".md")).alias("native_id"),
        F.timestamp_seconds(F.lit(1704067200) + n).alias("retrieved_at"),
        crlf.cast("binary").alias("payload"),
    )


@query(
    "P2_P6_front_matter",
    r"""SELECT 'local_files:' || doc_id || '.md' AS doc_id,
      CASE WHEN doc_id % 5 = 4 THEN 'Page ' || doc_id ELSE doc_id || '.md' END AS title,
      CASE WHEN doc_id % 5 = 4 THEN '{"lang":"' || lang || '","since":"2024-05-01","size":' || n_chars || '}' ELSE '{}' END AS structured,
      CASE WHEN doc_id % 5 = 4 THEN 'since' ELSE '' END AS opaque_keys,
      CASE WHEN doc_id % 5 = 4 THEN 'local_files:' || doc_id || '.md,local_files:' || doc_id || '.md,local_files:b.md' ELSE '' END AS relations,
      CASE WHEN doc_id % 5 = 4 THEN 'other:' || doc_id ELSE '' END AS grounded_by,
      1704067200 + doc_id AS retrieved_at,
      sha256(regexp_replace(CASE WHEN doc_id % 5 = 2 THEN '---' || chr(10) || 'unclosed: yes' || chr(10) || t ELSE t END,
        '^\s+|\s+$', '', 'g')) AS text_hash
    FROM (SELECT *, replace(text, chr(13), chr(10)) AS t FROM documents)""",
)
def front_matter(spark, sf_dir):
    """P2, P3, P5, P6 over a whole tree: split, parse, reserve, qualify."""
    d = markdown.normalize(_markdown_files(spark, sf_dir))
    return d.select(
        "doc_id", "title", "structured",
        F.array_join("opaque_keys", ",").alias("opaque_keys"),
        F.array_join("relations", ",").alias("relations"),
        F.array_join("grounded_by", ",").alias("grounded_by"),
        F.unix_timestamp("retrieved_at").alias("retrieved_at"),
        F.sha2("text", 256).alias("text_hash"),
    )


# ---------------------------------------------------------------- commit log


def _log(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    sep = F.lit(commits.FIELD_SEPARATOR)
    day = F.concat(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    sha = F.sha2(F.col("event_id").cast("string"), 256)
    fields = [
        sha, F.concat(F.lit("u"), F.col("user_id").cast("string")),
        F.concat(F.col("user_id").cast("string"), F.lit("@example.org")), day, day,
        F.when(F.col("event_id") % 10 == 0, "").otherwise(F.col("event_type")),
        F.concat(F.lit("\n"), F.col("props"), F.lit("\n")),
    ]
    whole = F.concat_ws(commits.FIELD_SEPARATOR, *fields)
    short = F.concat(sha, sep, F.lit("cut"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 25 == 3, short).when(F.col("event_id") % 25 == 4, " ").otherwise(whole).alias("record"),
    )


_COMMIT = """SELECT 'git_commits:' || sha256(event_id::VARCHAR) AS doc_id,
  CASE WHEN event_id % 10 = 0 THEN left(sha256(event_id::VARCHAR), 12) ELSE event_type END AS title, props AS text,
  '{"author":"u' || user_id || '","author_date":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00","author_email":"'
    || user_id || '@example.org"}' AS structured, epoch(date_trunc('second', ts))::BIGINT AS retrieved_at
FROM events WHERE event_id % 25 NOT IN (3, 4)"""


def _commit_docs(df):
    return commits.normalize(df).select(
        "doc_id", "title", "text", "structured", F.unix_timestamp("retrieved_at").alias("retrieved_at")
    )


@query("S3_commit_delta", _COMMIT + " AND event_id > (SELECT max(event_id) // 2 FROM events)")
def commit_delta(spark, sf_dir):
    """Only records after the watermark, here the middle of the log."""
    log = _log(spark, sf_dir)
    last = corpus.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 2
    return _commit_docs(commits.fetch(log, last_seq=last))


@query(
    "S5_backfill_bound",
    _COMMIT + " AND event_id IN (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100)",
)
def backfill_bound(spark, sf_dir):
    """The bound is the operator's own: the newest hundred on a first load."""
    return _commit_docs(commits.fetch(_log(spark, sf_dir), max_commits=100))


@query("P9_commits", _COMMIT)
def all_commits(spark, sf_dir):
    return _commit_docs(commits.fetch(_log(spark, sf_dir)))


@query(
    "A6_commit_watermark",
    "SELECT max(event_id) AS last_seq FROM events WHERE event_id % 25 NOT IN (3, 4)",
)
def commit_watermark(spark, sf_dir):
    return commits.watermark(commits.fetch(_log(spark, sf_dir)), None)


# ---------------------------------------------------------------- issues


def _landed_issues(spark, sf_dir, again=False):
    """One landing per order; `again` gives a later one, closed by then, of every third."""
    o = corpus.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp")
    if again:
        o = o.where(k % 3 == 0).withColumn("o_orderstatus", F.lit("F"))
        day = day + F.expr("interval 7 days")
    stamp = F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    pulled = F.when(k % 9 == 0, F.struct(F.lit("u").alias("url")))
    issue = F.struct(
        k.alias("number"),
        F.when(k % 8 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Order "), k.cast("string"))).alias("title"),
        F.concat(F.lit("\n total "), F.col("o_totalprice").cast("int").cast("string"), F.lit(" \n")).alias("body"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("state"),
        F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("login")).alias("user"),
        F.array(
            F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.lit("0-first").alias("name"))
        ).alias("labels"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        stamp.alias("updated_at"),
        F.concat(F.lit("https://x.example/"), k.cast("string")).alias("html_url"),
        (k % 17).alias("comments"),
        pulled.alias("pull_request"),
    )
    return settled(o.select(F.when(k % 100 == 1, "{broken").otherwise(F.to_json(issue)).alias("raw")))


_ISSUES = """issues AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state
  FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 100 <> 1)"""
_ISSUE_DOC = """SELECT 'github:acme/shop/issues/' || o_orderkey AS doc_id,
  CASE WHEN o_orderkey % 8 = 0 THEN 'acme/shop/issues/' || o_orderkey ELSE 'Order ' || o_orderkey END AS title,
  'total ' || trunc(o_totalprice)::BIGINT AS text, 'https://x.example/' || o_orderkey AS url,
  '{"author":"c' || o_custkey || '","created_at":"2024-01-01T00:00:00Z","labels":["0-first","' || o_orderpriority
    || '"],"state":"' || state || '"}' AS structured, epoch(o_orderdate)::BIGINT AS retrieved_at FROM issues"""


def _issue_docs(df):
    return issues.normalize(df).select(
        "doc_id", "title", "text", "url", "structured", F.unix_timestamp("retrieved_at").alias("retrieved_at")
    )


@query(
    "S4_updated_since",
    f"WITH {_ISSUES} {_ISSUE_DOC} WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND state = 'open'",
)
def updated_since(spark, sf_dir):
    got = issues.fetch(_landed_issues(spark, sf_dir), "acme/shop", "1997-06-01T00:00:00Z", "open")
    return _issue_docs(got)


@query("P7_issues", f"WITH {_ISSUES} {_ISSUE_DOC}")
def all_issues(spark, sf_dir):
    """Volatile fields excluded, labels sorted, other row kinds dropped."""
    return _issue_docs(issues.fetch(_landed_issues(spark, sf_dir), "acme/shop"))


@query(
    "P7_volatility",
    f"WITH {_ISSUES} SELECT count(*) AS issues, 0::BIGINT AS changed FROM issues",
)
def volatility(spark, sf_dir):
    """A later update stamp and a new comment count leave every hash as it was."""
    landed = _landed_issues(spark, sf_dir)
    later = landed.select(
        F.regexp_replace(
            F.regexp_replace("raw", r'"comments":\d+', '"comments":99'),
            r'"updated_at":"[^"]*"', '"updated_at":"2030-01-01T00:00:00Z"',
        ).alias("raw")
    )
    hashes = [
        issues.normalize(issues.fetch(df, "acme/shop")).select("doc_id", "content_hash")
        for df in (landed, later)
    ]
    old = hashes[0].withColumnRenamed("content_hash", "old_hash")
    both = hashes[1].join(old, "doc_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_if(~F.col("old_hash").eqNullSafe(F.col("content_hash"))).alias("changed"),
    )


@query(
    "A6_watermark",
    f"""WITH {_ISSUES} SELECT greatest(strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ'), '1997-06-01T00:00:00Z') AS since FROM issues""",
)
def watermark(spark, sf_dir):
    return issues.watermark(issues.fetch(_landed_issues(spark, sf_dir), "acme/shop"), "1997-06-01T00:00:00Z")


@query(
    "S4_rejects",
    "SELECT '{broken' AS raw, 'line does not parse as JSON' AS reject_reason FROM orders WHERE o_orderkey % 100 = 1",
)
def issue_rejects(spark, sf_dir):
    return issues.rejects(_landed_issues(spark, sf_dir))


@query(
    "S4_latest_landing",
    f"""WITH {_ISSUES} SELECT 'acme/shop/issues/' || o_orderkey AS native_id,
      strftime(o_orderdate + to_days(CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 0 END), '%Y-%m-%dT%H:%M:%SZ') AS updated_at,
      o_orderkey % 3 = 0 AS landed_again
    FROM issues WHERE CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE state END = 'closed'""",
)
def latest_landing(spark, sf_dir):
    """Every third issue lands again a week later, closed: only that landing counts, whatever its state was."""
    landed = _landed_issues(spark, sf_dir).union(_landed_issues(spark, sf_dir, again=True))
    got = issues.fetch(landed, "acme/shop", state="closed")
    number = F.regexp_extract("native_id", r"(\d+)$", 1).cast("long")
    return got.select("native_id", "updated_at", (number % 3 == 0).alias("landed_again"))


@query(
    "P10_key_order",
    "SELECT count(*) AS documents, 0::BIGINT AS changed FROM orders",
)
def key_order(spark, sf_dir):
    """One object in two key orders, at two depths, is one content."""
    o = corpus.table(spark, sf_dir, "orders")
    a, b = F.col("o_orderkey").alias("a"), F.col("o_orderpriority").alias("b")
    inner = F.struct(F.col("o_orderstatus").alias("x"), F.col("o_custkey").alias("y"))
    turned = F.struct(F.col("o_custkey").alias("y"), F.col("o_orderstatus").alias("x"))

    def docs(structured):
        return canonical_documents(
            o.select(
                F.lit("shop").alias("system"), F.col("o_orderkey").cast("string").alias("native_id"),
                F.to_json(structured).alias("structured"),
            )
        ).select("doc_id", "content_hash")

    one = docs(F.struct(a, b, inner.alias("c")))
    two = docs(F.struct(turned.alias("c"), b, a)).withColumnRenamed("content_hash", "other")
    return one.join(two, "doc_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("content_hash") != F.col("other")).alias("changed")
    )


# ---------------------------------------------------------------- responses

def _block(type_="resource", text=None, uri=None, name=None, title=None, r_uri=None, r_text=None,
           blob=None, mime=None):
    def s(v):
        return (F.lit(None) if v is None else v).cast("string")

    return F.struct(
        F.lit(type_).alias("type"), s(text).alias("text"), s(uri).alias("uri"), s(name).alias("name"),
        s(title).alias("title"),
        F.struct(s(r_uri).alias("uri"), s(r_text).alias("text"), s(blob).alias("blob"), s(mime).alias("mime_type")).alias(
            "resource"
        ),
    )


def _selections(spark, sf_dir):
    """Six kinds of selection response, one per page."""
    k = F.col("page_id")
    url = F.col("url")
    rows = F.to_json(F.struct(F.array(F.struct(url.alias("path"), F.concat(F.lit("P"), k.cast("string")).alias("title"))).alias("results")))
    none = F.array().cast(responses.BLOCKS)
    return corpus.table(spark, sf_dir, "pages").select(
        k.cast("string").alias("raw_id"),
        F.when(k % 8 == 0, rows).when(k % 8 == 1, '{"results":[]}').when(k % 8 == 2, '{"results":"x"}')
        .when(k % 8 == 3, '{"other":[1]}').when(k % 8 == 4, '{"results":[{"title":"t"}]}').alias("structured"),
        F.when(
            k % 8 == 5,
            F.array(_block("resource_link", uri=url, name=F.lit("n"), title=F.lit("T")), _block("text", text=F.lit("prose"))),
        ).when(k % 8 == 6, F.array(_block("resource_link", name=F.lit("n"))))
        .when(k % 8 == 7, F.array(_block("text", text=F.lit("just prose")))).otherwise(none)
        .cast(responses.BLOCKS).alias("content"),
    )


_URL_IDS = f"urls AS (SELECT page_id, url AS raw_id FROM pages), {_identity_sql('urls')}"
_PROSE = "selection holds no ids, neither links nor structure; name the ids in the configuration"


@query(
    "S7_S9_selection",
    f"""WITH {_URL_IDS} SELECT ids.raw_id, slug AS native_id, ids.raw_id AS url,
        CASE WHEN page_id % 8 = 0 THEN 'P' || page_id ELSE 'T' END AS title, NULL AS reject_reason
      FROM urls JOIN ids ON ids.raw_id = urls.raw_id WHERE page_id % 8 IN (0, 5)
    UNION ALL SELECT NULL, NULL, NULL, NULL, CASE page_id % 8
        WHEN 2 THEN '''results'' of the selection is no list' WHEN 3 THEN 'selection lacks ''results'''
        WHEN 4 THEN 'select result row has no ''path'' key' WHEN 6 THEN 'resource block carries no uri' ELSE '{_PROSE}' END
      FROM pages WHERE page_id % 8 IN (2, 3, 4, 6, 7)""",
)
def selection(spark, sf_dir):
    """S7-S9 with a mapping; an empty list gives no row and no error."""
    return responses.select_refs(_selections(spark, sf_dir), "results", "path", "title")


@query(
    "S8_S9_unmapped_selection",
    f"""WITH {_URL_IDS} SELECT ids.raw_id, slug AS native_id, ids.raw_id AS url, 'T' AS title, NULL AS reject_reason
      FROM urls JOIN ids ON ids.raw_id = urls.raw_id WHERE page_id % 8 = 5
    UNION ALL SELECT NULL, NULL, NULL, NULL, CASE WHEN page_id % 8 = 6 THEN 'resource block carries no uri'
        WHEN page_id % 8 = 7 THEN '{_PROSE}'
        ELSE 'selection is structured, and no setting says where its ids are' END
      FROM pages WHERE page_id % 8 <> 5""",
)
def unmapped_selection(spark, sf_dir):
    return responses.select_refs(_selections(spark, sf_dir))


def _reads(spark, sf_dir):
    """One read response per page in fourteen shapes; every 14th is missing."""
    k = F.col("page_id")
    url, html = F.col("url"), F.col("html")
    encoded = F.base64(F.encode(html, "UTF-8"))
    wrapped = F.regexp_replace(encoded, "(.{60})", "$1\n")
    texts = F.transform(
        F.split(html, "(?=<p>)"), lambda t: _block("text", text=t)
    )
    none = F.array().cast(responses.BLOCKS)
    link = _block("resource_link", uri=url)
    body = _block(r_uri=F.lit("repo://volatile"), r_text=html, mime=F.lit("text/html"))
    shape = k % 15
    content = (
        F.when(shape == 0, F.array(link, body))
        .when(shape == 1, F.array(_block(blob=wrapped)))
        .when(shape == 2, F.array(_block(blob=F.concat(encoded, F.lit("*")))))
        .when(shape == 3, F.array(_block(blob=F.base64(F.unhex(F.lit("FFFE00"))))))
        .when(shape == 4, F.array(_block(r_text=F.lit(" \n"))))
        .when(shape == 5, F.array(link, _block("text", text=F.lit("preamble"))))
        .when(shape == 6, F.array(body, body))
        .when(shape == 7, texts)
        .when(shape == 8, F.array(_block("text", text=F.lit(""))))
        .otherwise(none)
        .cast(responses.BLOCKS)
    )
    structured = (
        F.when(shape == 9, F.to_json(F.struct(html.alias("content"))))
        .when(shape == 10, '{"content":{"markdown":"x"}}')
        .when(shape == 11, '{"content":"  "}')
        .when(shape == 12, '{"content":0}')
    )
    return corpus.table(spark, sf_dir, "pages").where(shape != 14).select(
        k.alias("request"), url.alias("raw_id"), (shape == 13).alias("failed"), structured.alias("structured"), content.alias("content")
    )


def _requests(spark, sf_dir):
    """A request for each page; several pages may have one URL, and each is a request of its own."""
    return responses.enumerated(
        corpus.table(spark, sf_dir, "pages").select(F.col("page_id").alias("request"), F.col("url").alias("raw_id"))
    )


@query(
    "S10_S11_responses",
    f"""WITH {_URL_IDS}, shaped AS (SELECT p.page_id % 15 AS s, p.url, html, slug FROM pages p JOIN ids ON ids.raw_id = p.url)
    SELECT url AS raw_id, slug AS native_id, CASE s
        WHEN 2 THEN 'blob cannot be decoded as base64' WHEN 3 THEN 'blob is no UTF-8 text'
        WHEN 4 THEN 'the resource has no text'
        WHEN 5 THEN 'only links came back, and no text'
        WHEN 6 THEN 'more than one document came back for one id'
        WHEN 8 THEN 'the response is empty' WHEN 10 THEN '''content'' of the response is no text'
        WHEN 11 THEN 'response lacks ''content''' WHEN 13 THEN 'reading this id failed'
        WHEN 14 THEN 'nothing was returned for this id' END AS reject_reason,
      CASE WHEN s = 0 THEN 'text/html' WHEN s IN (1, 7, 9, 12) THEN 'text/plain' END AS media_type,
      sha256(CASE WHEN s IN (0, 1, 9) THEN html WHEN s = 7 THEN replace(html, '<p>', chr(10) || chr(10) || '<p>')
        WHEN s = 12 THEN '0' END) AS body_hash FROM shaped""",
)
def response_mapping(spark, sf_dir):
    """Three tiers and all reject reasons; a missing response is a reject, not a gap."""
    got = responses.read_records(_requests(spark, sf_dir), _reads(spark, sf_dir), "content")
    return got.select(
        "raw_id", "native_id", "reject_reason", "media_type", F.sha2("body", 256).alias("body_hash")
    )


@query(
    "S12_completeness",
    """SELECT count(*) AS requested, count(*) FILTER (page_id % 15 IN (2, 3, 4, 5, 6, 8, 10, 11, 13, 14)) AS rejected,
      count(*) FILTER (page_id % 15 IN (2, 3, 4, 5, 6, 8, 10, 11, 13, 14)) = 0 AS complete FROM pages""",
)
def completeness(spark, sf_dir):
    got = responses.read_records(_requests(spark, sf_dir), _reads(spark, sf_dir), "content")
    return responses.completeness(got, True)


@query(
    "P4_response_documents",
    r"""SELECT 'wiki:' || doc_id AS doc_id, doc_id::VARCHAR AS title,
      sha256(regexp_replace(replace(replace(text, chr(13), chr(10)), chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g')) AS text_hash
    FROM documents""",
)
def response_documents(spark, sf_dir):
    """Text blocks joined by a blank line, then canonicalised under the requested id."""
    d = corpus.table(spark, sf_dir, "documents")
    raw = F.col("doc_id").cast("string")
    blocks = F.transform(F.split("text", "\n"), lambda t: _block("text", text=t)).cast(responses.BLOCKS)
    reads = d.select(
        raw.alias("raw_id"), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("structured"),
        blocks.alias("content"),
    )
    refs = responses.enumerated(d.select(raw.alias("raw_id")))
    docs = responses.normalize(
        responses.read_records(refs, reads), F.lit("wiki"), F.timestamp_seconds(F.lit(1704067200))
    )
    return docs.select("doc_id", "title", F.sha2("text", 256).alias("text_hash"))
