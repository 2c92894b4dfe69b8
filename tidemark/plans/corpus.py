"""Two states of one corpus, derived from the `documents` table.

The mirror holds all documents but every 19th. The fetch holds the documents of ten of
the twenty systems but every 17th, with every 11th edited and every 13th tombstoned.
Links go to the same system's next document, to a hub page, and now and then to another
system. `SQL` states the same thing for the check tool.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changes as ch
from tidemark.operators import concepts as cn
from tidemark.operators import grounding as gr
from tidemark.session import settled

ACTOR = "tidemark/test"


@cache
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that comes as fewer splits than there are cores is dealt out
    first, as hashing and rendering would otherwise run on one of them; a large table
    has more splits than cores and is read as it is."""
    # the given stamps carry no zone and are read as UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text(c: Column) -> Column:
    return c.cast("string")


def page(n: Column) -> Column:
    """Qualified id of document n; documents are dealt to twenty systems in turn."""
    return F.concat(F.lit("src"), text(n % 20), F.lit(":docs/"), text(n), F.lit(".md"))


@cache
def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents normalised but for the state-dependent fields; `n` is the source key."""
    d = table(spark, sf_dir, "documents").withColumn("n", F.col("doc_id"))
    n = F.col("n")
    none = F.array().cast("array<string>")
    shared = (n % 10).isin(2, 3) | (n % 30).isin(0, 1)
    return d.select(
        "n",
        F.col("source").alias("system"),
        F.concat(F.lit("docs/"), text(n), F.lit(".md")).alias("native_id"),
        F.when(
            shared, F.concat(F.lit("https://kb.example.org/r/"), text(F.floor(n / 2)))
        ).alias("url"),
        F.timestamp_seconds(F.lit(1704067200) + n * 60).alias("retrieved_at"),
        F.concat(F.lit("Document "), text(n)).alias("title"),
        "text",
        F.to_json(F.struct("lang", "n_chars")).alias("structured"),
        F.concat(
            F.array(page(F.when(n % 23 == 0, n + 1).otherwise(n + 20))),
            F.when(n % 3 == 0, F.array(page(n % 20))).otherwise(none),
        ).alias("relations"),
        F.when(
            n % 5 == 0,
            F.concat(
                F.array(*[page(n + i) for i in range(1, 8)]),
                F.when(n % 25 == 0, F.array(page(n))).otherwise(none),
                F.when(
                    n % 35 == 0,
                    F.array(F.concat(F.lit("ghost:docs/"), text(n), F.lit(".md"))),
                ).otherwise(none),
            ),
        ).otherwise(none).alias("grounded_by"),
    )


@cache
def mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.canonical_documents(base(spark, sf_dir).where(F.col("n") % 19 != 0))


@cache
def fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return _revised(base(spark, sf_dir).where((n % 17 != 0) & (n % 20 < 10)))


@cache
def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a fetch would hold them."""
    return _revised(base(spark, sf_dir))


def _revised(rows: DataFrame) -> DataFrame:
    n = F.col("n")
    return ch.canonical_documents(
        rows.withColumn(
            "text", F.when(n % 11 == 0, F.concat("text", F.lit(" [rev 2]"))).otherwise(F.col("text"))
        ).withColumn("deleted", n % 13 == 0)
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.diff(fetch(spark, sf_dir), mirror(spark, sf_dir))


def light(df: DataFrame) -> DataFrame:
    return df.drop("text", "title", "structured", "opaque_keys")


@dataclass(frozen=True)
class States:
    """Mirror and fetch as written tables, the way a run finds them."""

    docs: DataFrame
    was: DataFrame

    @property
    def live(self) -> DataFrame:
        return self.docs.where(~F.col("deleted"))

    @property
    def systems(self) -> DataFrame:
        return ch.run_systems(self.docs)

    @property
    def changes(self) -> DataFrame:
        return ch.diff(self.docs, self.was)

    @property
    def targets(self) -> DataFrame:
        return ch.overlay(light(self.was), light(self.docs))

    @property
    def known(self) -> DataFrame:
        return ch.known_paths(self.was, self.docs, self.systems, self.changes)

    @property
    def kept(self) -> DataFrame:
        return gr.resolve(self.live, None, self.targets, settle=settled)[0]

    @property
    def recorded(self) -> DataFrame:
        """Lineage as an earlier run left it: resolved against the mirror alone, for owners
        whose number is no multiple of 15, with stale hashes for multiples of 40."""
        before = gr.as_recorded(gr.resolve(self.was, None, light(self.was), settle=settled)[0])
        n = F.regexp_extract("owner_id", r"docs/(\d+)\.md", 1).cast("bigint")
        return before.where(n % 15 != 0).select(
            "owner_id",
            F.when(n % 40 == 0, F.transform_values("current", lambda _, v: F.lit("stale")))
            .otherwise(F.col("current"))
            .alias("recorded"),
        )

    @property
    def assembled(self) -> DataFrame:
        return cn.assemble(self.live, None, self.known, ACTOR, self.kept, settle=settled)


def states(spark: SparkSession, sf_dir: str, with_text: bool = False) -> States:
    docs, was = fetch(spark, sf_dir), mirror(spark, sf_dir)
    if not with_text:
        docs, was = light(docs), light(was)
    return States(settled(docs), settled(was))


# ---------------------------------------------------------------- the same in SQL


def _page(n: str) -> str:
    return f"('src' || (({n}) % 20) || ':docs/' || ({n}) || '.md')"


def sql_hash(did: str = "did", text_: str = "text", deleted: str = "deleted") -> str:
    def lp(c: str) -> str:
        return f"(length({c}) || ':' || {c})"

    rel = "array_to_string(list_transform(list_sort(relations), lambda r: length(r) || ':' || r), '')"
    return (
        f"sha256({lp(did)} || {lp('title')} || {lp(text_)} || {lp('structured')} || "
        f"len(relations) || '|' || {rel} || CASE WHEN {deleted} THEN '1' ELSE '0' END)"
    )


def sql_path(did: str) -> str:
    native = f"substr({did}, instr({did}, ':') + 1)"
    return f"('concepts/' || trim(regexp_replace({native}, '\\.md$', ''), '/') || '/overview.md')"


SQL_BASE = f"""
base AS (
  SELECT doc_id AS n, source AS system, 'docs/' || doc_id || '.md' AS native_id,
    source || ':docs/' || doc_id || '.md' AS did,
    'Document ' || doc_id AS title, text, lang, n_chars,
    '{{"lang":"' || lang || '","n_chars":' || n_chars || '}}' AS structured,
    CASE WHEN doc_id % 10 IN (2, 3) OR doc_id % 30 IN (0, 1)
      THEN 'https://kb.example.org/r/' || (doc_id // 2) END AS url,
    1704067200 + doc_id * 60 AS retrieved,
    list_concat([CASE WHEN doc_id % 23 = 0 THEN {_page('doc_id + 1')} ELSE {_page('doc_id + 20')} END],
      CASE WHEN doc_id % 3 = 0 THEN [{_page('doc_id % 20')}] ELSE []::VARCHAR[] END) AS relations,
    CASE WHEN doc_id % 5 = 0 THEN list_concat(
      [{', '.join(_page(f'doc_id + {i}') for i in range(1, 8))}],
      CASE WHEN doc_id % 25 = 0 THEN [{_page('doc_id')}] ELSE []::VARCHAR[] END,
      CASE WHEN doc_id % 35 = 0 THEN ['ghost:docs/' || doc_id || '.md'] ELSE []::VARCHAR[] END)
      ELSE []::VARCHAR[] END AS grounded_by
  FROM documents)"""

SQL_STATES = SQL_BASE + f""",
v1 AS (SELECT *, false AS deleted FROM base WHERE n % 19 <> 0),
v2 AS (SELECT * REPLACE (CASE WHEN n % 11 = 0 THEN text || ' [rev 2]' ELSE text END AS text),
    n % 13 = 0 AS deleted FROM base WHERE n % 17 <> 0 AND n % 20 < 10),
mirror AS (SELECT *, {sql_hash()} AS content_hash FROM v1),
fetched AS (SELECT *, {sql_hash()} AS content_hash FROM v2),
changes AS (
  SELECT f.did, f.n, f.system,
    CASE WHEN f.deleted AND m.did IS NOT NULL THEN 'removed'
      WHEN f.deleted THEN 'ignored_tombstone'
      WHEN m.did IS NULL THEN 'added'
      WHEN m.content_hash <> f.content_hash THEN 'modified'
      ELSE 'unchanged' END AS kind
  FROM fetched f LEFT JOIN mirror m ON f.did = m.did),
live AS (SELECT * FROM fetched WHERE NOT deleted),
overlay AS (
  SELECT * FROM mirror WHERE did NOT IN (SELECT did FROM live)
  UNION ALL BY NAME SELECT * FROM live),
known AS (
  SELECT path FROM (
    SELECT {sql_path('did')} AS path FROM mirror WHERE system IN (SELECT system FROM fetched)
    UNION SELECT {sql_path('did')} FROM live)
  WHERE path NOT IN (SELECT {sql_path('did')} FROM changes WHERE kind = 'removed'))"""


def sql_resolution(owners: str, targets_: str, name: str = "res", limit: int | None = None) -> str:
    """CTEs for a grounding resolution of `owners` against `targets_`."""
    cut = f" WHERE rank <= {limit}" if limit else ""
    return f"""
{name}_declared AS (
  SELECT DISTINCT did AS owner_id, unnest(grounded_by) AS gid FROM {owners}),
{name}_found AS (
  SELECT d.owner_id, d.gid, t.content_hash, t.did AS hit,
    coalesce(nullif(t.url, ''), t.system || ':' || t.native_id) AS resource,
    coalesce(nullif(o.url, ''), o.system || ':' || o.native_id) AS own_resource
  FROM {name}_declared d JOIN {owners} o ON o.did = d.owner_id
  LEFT JOIN {targets_} t ON t.did = d.gid WHERE d.gid <> d.owner_id),
{name}_cited AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, resource ORDER BY gid) AS rr
    FROM {name}_found WHERE hit IS NOT NULL AND resource <> own_resource) WHERE rr = 1),
{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY gid) AS rank FROM {name}_cited),
{name}_kept AS (SELECT * FROM {name}_ranked{cut})"""


def with_states(select: str, *more: str) -> str:
    ctes = ",".join([SQL_STATES, *more])
    return f"WITH {ctes}\n{select}"
