"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, exact, jaccard, language, lexical, licenses, lines, merkle, packing, quality, substring, toxicity
from tidemark.llm.common import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


@query(
    "op10_exact_duplicates",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)
    """,
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def fold(modulus: int) -> Column:
    """The remainder that holds rows out."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def held_out(modulus: int, rest: int) -> Column:
    """Whether a row is kept from learning; a null id has no fold and is never learned from."""
    return F.coalesce(fold(modulus) == rest, F.lit(True))


@query("op7_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = quality.fit(docs, labels.where(fold(5) != 0), "quality", Scratch(spark, "quality"))
    scored = quality.score(docs.select("doc_id", "text"), rules)
    return scored.select(
        "doc_id",
        held_out(5, 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"),
    )


@query("op9_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(3) != 1), "toxic", Scratch(spark, "toxicity"))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out(3, 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "offending",
    )


@query("op3_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), size=3, percent=90)


_SUBSTRING = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
  g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS gram
    FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
  f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
  lost AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (
      SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (gram) WHERE first < g.doc_id) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' '), ''))
    AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)"""


@query("op6_substring_dedup", _SUBSTRING)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.substring_duplicates(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.duplicate_lines(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_lines",
        F.size("removed_lines").cast("long").alias("n_removed"),
        "removed_lines",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _license_sql() -> str:
    numbers, rules = licenses.known_sentences()
    keys = ", ".join(f"'{k}'" for k in numbers)
    texts = ["|" + "|".join(map(str, r)) + "|" for _, r in rules]
    found = []
    for (name, _), own in zip(rules, texts, strict=True):
        rest = "sequence"
        for other in texts:
            if own in other and len(other) > len(own):
                rest = f"replace({rest}, '{other}', '|')"
        found.append(f"CASE WHEN contains({rest}, '{own}') THEN '{name}' END")
    return rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(
      regexp_replace(coalesce(text, ''), '([.!?:;])[ \t]+', '\1' || chr(10), 'g'), chr(10)),
      lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS parts FROM documents),
  k AS (SELECT *, list_filter(list_transform(parts, lambda x: list_position([{keys}], x) - 1), lambda x: x >= 0) AS known FROM s),
  q AS (SELECT *, '|' || array_to_string(known, '|') || '|' AS sequence FROM k)
SELECT doc_id, len(parts)::BIGINT AS n_sentences, len(known)::BIGINT AS n_known,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(found)}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM q"""


@query("op8_license_scan", _license_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_known", F.array_join("licenses", ",").alias("licenses"))


def _merkle_sql(deep: int = 8) -> str:
    """Trees of up to ``deep`` levels, one relation for each; SQL has no CRC-32, so bits are folded in."""

    def coded(column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column} END"

    rest = " || ".join(coded(c) for c in merkle.FIELDS[:-1])

    def climb(name: str) -> str:
        """Levels of trees with rows (tree, pos, h); a run is the text of up to 16 digests."""
        steps = []
        for k in range(deep):
            steps.append(f"""{name}r{k} AS (SELECT tree, pos // 16 AS pos, string_agg(h, '' ORDER BY pos) AS run FROM {name}{k}
                WHERE tree IN (SELECT tree FROM {name}{k} WHERE pos = 1) GROUP BY tree, pos // 16)""")
            steps.append(f"{name}{k + 1} AS (SELECT tree, pos, sha256(run) AS h FROM {name}r{k})")
        last = " UNION ALL ".join(
            f"SELECT tree, any_value(h) AS h FROM {name}{k} GROUP BY tree HAVING count(*) = 1" for k in range(deep + 1)
        )
        return ", ".join([*steps, f"{name}_root AS ({last})"])

    def fold(name: str, rows: str, tree: str, pos: str) -> str:
        """Siblings and folded digest level by level; a level that a tree lacks changes nothing."""
        steps, before = [], rows
        for k in range(deep):
            at = f"(({pos} // {16**k}) % 16)"
            left, right = f"left(coalesce(run, ''), 64 * {at})", f"substr(coalesce(run, ''), 64 * {at} + 65)"
            steps.append(f"""{name}f{k} AS (SELECT w.* REPLACE (w.proof || {left} || {right} AS proof,
                CASE WHEN run IS NULL THEN w.folded ELSE sha256({left} || w.folded || {right}) END AS folded)
              FROM {before} w LEFT JOIN {name}r{k} r ON r.tree = w.{tree} AND r.pos = {pos} // {16 ** (k + 1)})""")
            before = f"{name}f{k}"
        return ", ".join(steps)

    return f"""
WITH b AS (SELECT *, list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k) & 1)::BIGINT)))),
      lambda s, x: xor(s >> 1, (xor(s, x) & 1) * 3988292384)) AS state FROM documents),
  t AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND xor(state, 4294967295) % 5 = 0
      THEN translate(text, '{merkle.UPPER}', '{merkle.LOWER}') ELSE text END AS other FROM b),
  d AS (SELECT doc_id, source, sha256({rest} || {coded("text")}) AS leaf, sha256({rest} || {coded("other")}) AS folded FROM t),
  s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM d)),
  m AS (SELECT d.*, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS proof, 0 AS top
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
  own0 AS (SELECT tree, pos, leaf AS h FROM m), {climb("own")},
  top0 AS (SELECT 0 AS tree, tree AS pos, h FROM own_root), {climb("top")},
  {fold("own", "m", "tree", "w.pos")}, {fold("top", f"ownf{deep - 1}", "top", "w.tree")}
SELECT doc_id, leaf, o.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM topf{deep - 1} w JOIN own_root o ON o.tree = w.tree CROSS JOIN top_root t"""


@query("op11_merkle_manifest", _merkle_sql())
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents"), merkle.lowered_in_fold()))


_LEXICAL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.PATTERN}') AS ts FROM documents),
  s AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS occurrences FROM d),
  f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.PATTERN}')) AS term FROM benchmark),
  c AS (SELECT item_id, r, doc_id,
      sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // occurrences))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM c WHERE score > 0)
WHERE rank <= 10"""


@query("op13_lexical_search", _LEXICAL)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out(5, 0)), Scratch(spark, "language"))
    return language.predict(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")
