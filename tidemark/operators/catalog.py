"""Read-side table jobs over published concepts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import facets as fx
from tidemark.functions import identity
from tidemark.operators.joins import skew_safe_join
from tidemark.operators.numbering import numbered
from tidemark.session import settled


def manifest_tombstones(manifest: DataFrame, current: DataFrame, complete: bool, selector: str) -> DataFrame:
    """Ids an enumerating selector once listed and no longer does.

    Only a complete selection may delete, and only within its own selector's scope.
    """
    scope = manifest.where(F.col("selector") == selector).select("doc_id")
    if not complete:
        return scope.where(F.lit(False))
    return scope.join(current.select("doc_id").distinct(), "doc_id", "left_anti").distinct()


def list_concepts(
    concepts: DataFrame,
    type_: str | None = None,
    tags: dict[str, str] | None = None,
    owner: str | None = None,
    updated_since: Column | None = None,
) -> DataFrame:
    """Faceted browse. Filters only, so they reach the scan."""
    out = concepts
    if type_ is not None:
        out = out.where(F.col("type") == type_)
    for key, value in (tags or {}).items():
        out = out.where(fx.facet_equals(F.col("facets"), key, value))
    if owner is not None:
        out = out.where(fx.facet_equals(F.col("facets"), "owner", owner))
    if updated_since is not None:
        out = out.where(F.col("generated_at") >= updated_since)
    return out


def related_concepts(concepts: DataFrame, path: str) -> DataFrame:
    """(path, relation) of one concept's neighbours by link or by shared anchor.

    A point query: it reads the concept's own links and resources, then filters the
    table against them. No pairs within a group are formed.
    """
    me = concepts.where(F.col("path") == path)
    out = me.select(F.explode("links").alias("path"), F.lit("links_to").alias("relation"))
    into = concepts.where(F.array_contains("links", path)).select(
        "path", F.lit("linked_from").alias("relation")
    )
    mine = me.select(F.explode("sources").alias("s")).select(F.col("s.resource").alias("resource")).distinct()
    theirs = concepts.where(F.col("path") != path).select(
        "path", F.explode("sources").alias("s")
    ).select("path", F.col("s.resource").alias("resource"))
    # one concept's own resources, as many as it cites
    shared = theirs.join(F.broadcast(mine), "resource", "left_semi").select(
        "path", F.lit("shares_source").alias("relation")
    )
    return out.unionByName(into).unionByName(shared).where(F.col("path") != path).distinct()


def stale_concepts(
    concepts: DataFrame, as_of: Column, default_days: int, policy: DataFrame | None = None,
    area: str | None = None,
) -> DataFrame:
    """Concepts older than their type's `stale_after` days at a given instant."""
    out = concepts
    if area is not None:
        out = out.where(F.col("path").startswith(area))
    days: Column = F.lit(default_days)
    if policy is not None:
        # one row per type: a policy is as small as the type vocabulary
        out = out.join(policy.select("type", "max_days").dropDuplicates(["type"]), "type", "left")
        days = F.coalesce("max_days", F.lit(default_days))
    age = F.unix_timestamp(as_of) - F.unix_timestamp("generated_at")
    return out.where(F.col("generated_at").isNull() | (age >= days * 86400)).select(
        "path", "type", F.floor(age / 86400).cast("long").alias("age_days")
    )


def occurrences(body: Column, term: str) -> Column:
    """How often a word stands in a text, letters and digits making up words."""
    return F.regexp_count(body, F.lit(_word(term)))


def _word(term: str) -> str:
    quoted = term.replace("\\E", "")
    return r"(?<![\p{L}\p{N}])\Q" + quoted + r"\E(?![\p{L}\p{N}])"


def search(bodies: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Lexical ranking by term frequency against document frequency, with a snippet.

    Only query terms leave the scan: each document is cut to one small row per matching
    term before anything is shuffled. `limit` is the feature, a top-k answer.
    """
    wanted = sorted({t.lower() for t in terms})
    lower = F.lower("body")
    # the stretch around the first hit of any term; case folding keeps positions near enough
    firsts = [F.nullif(F.regexp_instr(lower, F.lit(_word(t))), F.lit(0)) for t in wanted]
    start = F.greatest(F.lit(1), F.least(*firsts, F.lit(None)) - 30)
    lowered = bodies.select(
        "path", F.substr("body", start, F.lit(80)).alias("snippet"), lower.alias("body")
    )
    counts = lowered.select(
        "path",
        "snippet",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("term"), occurrences(F.col("body"), t).alias("tf"))
                    for t in wanted
                ]
            )
        ).alias("hit"),
    ).select("path", "snippet", "hit.*").where(F.col("tf") > 0)
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = bodies.agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    # one row per query term at most
    weights = frequency.withColumn("one", F.lit(1)).join(total, "one").select(
        "term", F.log1p(F.col("n") / F.col("df")).alias("weight")
    )
    return (
        counts.join(F.broadcast(weights), "term")
        .groupBy("path")
        .agg(
            F.round(F.sum(F.col("tf") * F.col("weight")), 6).alias("score"),
            F.min("snippet").alias("snippet"),
        )
        .orderBy(F.desc("score"), "path")
        .limit(limit)
    )


def similar_by_vector(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """Cosine similarity of stored vectors to one query vector, top k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform("embedding", lambda x: x.cast("double"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(v, lambda x: x * x))) * float(sum(x * x for x in query) ** 0.5)
    return (
        vectors.select("vec_id", F.round(dot / norm, 6).alias("cosine"))
        .orderBy(F.desc("cosine"), "vec_id")
        .limit(limit)
    )


def facet_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value) with one row per facet."""
    return docs.select(
        "doc_id",
        F.explode(fx.facets(F.col("structured"), F.col("opaque_keys"))).alias("key", "value"),
    )


def conflicts(rows: DataFrame) -> DataFrame:
    """(subject, key, value, docs) where a subject's documents disagree on a key.

    Counts are taken per value first, so a subject with very many documents is reduced
    to its distinct values before it meets a reducer.
    """
    per_value = rows.groupBy("subject", "key", "value").agg(F.count(F.lit(1)).alias("docs"))
    split = (
        per_value.groupBy("subject", "key")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        .where(F.col("lo") != F.col("hi"))
        .select("subject", "key")
    )
    # a subject may have very many values of one key: they are spread over tasks
    about = F.struct("subject", "key")
    wanted = split.select(F.to_json(about).alias("about"))
    return skew_safe_join(
        per_value.withColumn("about", F.to_json(about)), wanted, "about", "left_semi", ["value"]
    ).drop("about")


def conflict_items(found: DataFrame) -> DataFrame:
    """Summary items for conflicts, one per disputed value."""
    return found.select(
        F.concat("subject", F.lit(": "), "key", F.lit(" = "), "value", F.lit(" in "),
                 F.col("docs").cast("string"), F.lit(" document(s)")).alias("item")
    )


def facet_gaps(docs: DataFrame, required: list[str]) -> DataFrame:
    """(doc_id, key) for each required facet a document lacks. No shuffle."""
    want = F.array(*[F.lit(k) for k in required])
    have = F.map_keys(fx.facets(F.col("structured"), F.col("opaque_keys")))
    return docs.select("doc_id", F.explode(F.array_except(want, have)).alias("key"))


def gap_items(gaps: DataFrame) -> DataFrame:
    return gaps.select(
        F.concat(identity.concept_path(F.col("doc_id")), F.lit(": no "), "key").alias("item")
    )


def chunks(
    docs: DataFrame, partition: str, target: int, buckets: int = 256,
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(doc_id, partition, chunk) with at most `target` documents per chunk.

    Documents are mixed by a digest, so that a chunk is no run of neighbours, and numbered in that
    order by ranges with sampled bounds: a partition with most of the rows, or all of them, is
    numbered by many tasks, each with an even share, whatever the size. `buckets` only sets how far
    the digest mixes.
    """
    digest = F.conv(F.left(F.md5("doc_id"), F.lit(4)), 16, 10).cast("int")
    rows = docs.select(
        "doc_id", F.col(partition).alias("part"), F.pmod(digest, F.lit(buckets)).alias("bucket")
    )
    found = numbered(rows, ["bucket", "doc_id"], "part", settle or settled)
    return found.select(
        "doc_id", F.col("part").alias(partition), F.floor(F.col("rank") / target).cast("long").alias("chunk")
    )


def content_identity(docs: DataFrame) -> DataFrame:
    """For a source without stable ids, one identity per distinct content.

    (content_key, doc_id, copies): the smallest id stands for all exact copies.
    """
    key = F.sha2(F.concat_ws("\n", "title", "text"), 256)
    return docs.groupBy(key.alias("content_key")).agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")
    )
