"""A kept inverted index over published texts (X5): refreshed by segment, searched by bounds."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.operators.joins import guarded_broadcast
from tidemark.plans.state import CODEC, Snapshots, Version, new_run_id
from tidemark.session import settled

#: Documents of a segment before the segments double, and of a block.
SEGMENT_DOCS = 50_000
BLOCK_DOCS = 256
#: Words of new documents that are cut into blocks at once.
GROUP_WORDS = 4_000_000
#: Blocks that are scored first, for a floor under the k-th score.
FIRST_BLOCKS = 4

#: `docs` are numbers of documents in their block, `counts` how often the term is in each.
BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("most", T.LongType()),
        T.StructField("docs", T.ArrayType(T.ShortType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
    ]
)
PLACED = T.StructType([T.StructField("segment", T.IntegerType()), *BLOCKS.fields])
PATHS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("doc", T.ShortType()),
    ]
)


def words(body: Column) -> Column:
    """Words of letters and digits, in lower case, a blank between them."""
    return F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " "))


def _number(refresh: int, band, part, local):
    """A block's number: new with each refresh, and in it by band of lengths, part and place."""
    return (((refresh << 6) + band) * (1 << 16) + part) * (1 << 17) + local


def _cut(refresh: int, block_docs: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """One row for each block and term of a group of new documents `(path, length, words)`."""

    def cut(key: tuple, fresh: pa.Table) -> pa.Table:
        segment, band, part = (k.as_py() for k in key)
        order = pc.sort_indices(fresh, sort_keys=[("length", "descending"), ("path", "ascending")])
        lists = pc.split_pattern(fresh["words"].combine_chunks().take(order), " ")
        flat = pc.list_flatten(lists)
        real = pc.not_equal(flat, "")
        doc = pc.list_parent_indices(lists).filter(real).to_numpy().astype(np.int64)
        flat = flat.filter(real).dictionary_encode()
        # codes of a term, a block and a document of it in one number
        blocks = max(len(fresh) // block_docs + 1, 1)
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * blocks + doc // block_docs
        code, tf = np.unique(code * block_docs + doc % block_docs, return_counts=True)
        place, doc = np.divmod(code, block_docs)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        ends = np.r_[starts, len(place)]
        term, local = np.divmod(place[starts], blocks)
        n = len(starts)
        return pa.table(
            {
                "segment": pa.array(np.full(n, segment, np.int32)),
                "block": pa.array(_number(refresh, band, part, local)),
                "term": flat.dictionary.take(pa.array(term)),
                "n": pa.array(np.diff(ends).astype(np.int64)),
                "most": pa.array((np.maximum.reduceat(tf, starts) if n else tf).astype(np.int64)),
                "docs": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(doc.astype(np.int16))),
                "counts": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tf.astype(np.int32))),
            }
        )

    return cut


@dataclass(frozen=True)
class Found:
    """The answer, how many blocks hold a query term, and how many of them were read."""

    rows: DataFrame
    blocks: int
    read: int


class TextIndex(Snapshots):
    """Postings in blocks, each with the greatest count of a term in it.

    A document belongs to a segment by its path. The new documents of a refresh are cut into blocks by
    length, so that counts in a block are alike; a posting names its document by its number in the block.
    Documents that go leave their blocks, and blocks that are less than half full are put together, so that
    words are only looked at once. Tables are named `blocks/<segments>/<segment>` and
    `paths/<segments>/<segment>`, and a refresh writes the segments of the documents that changed.
    """

    def _segments(self, version: Version, kind: str) -> dict[int, str]:
        return {int(n.split("/")[2]): n for n in version.tables if n.startswith(f"{kind}/")}

    def _stored(self, version: Version, kind: str, schema: T.StructType, only: set[int] | None = None) -> DataFrame:
        parts = [
            self.spark.read.schema(schema).parquet(f"{self.root}/{version.tables[n]}").withColumn("segment", F.lit(s))
            for s, n in sorted(self._segments(version, kind).items()) if only is None or s in only
        ]
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*schema, T.StructField("segment", T.IntegerType())]))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _read(self, version: Version, kind: str, schema: T.StructType, only: set[int] | None = None) -> DataFrame:
        """A stored table; blocks also with `postings`, which name each document by its path."""
        rows = self._stored(version, kind, schema, only)
        if kind != "blocks":
            return rows
        names = self._stored(version, "paths", PATHS, only).groupBy("segment", "block").agg(
            F.sort_array(F.collect_list(F.struct("doc", "path"))).alias("names")
        )

        def posting(doc: Column, count: Column) -> Column:
            return F.struct(F.col("names")[doc.cast("int")]["path"].alias("path"), count.cast("long").alias("tf"))

        return rows.join(names, ["segment", "block"], "left").withColumn("postings", F.zip_with("docs", "counts", posting)).drop("names")

    def _tidy(self, write: Callable[[], None]) -> None:
        """What is written needs its shuffle files no more."""
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(name, "false")
        self.spark.conf.set(name, "true")
        try:
            write()
        finally:
            self.spark.conf.set(name, before)

    def refresh(self, docs: DataFrame) -> set[int]:
        """Take over documents `(path, body, deleted)`, each path once; returns the segments that were written.

        A deleted document leaves the index. NULL and empty bodies have no terms but count as documents.
        """
        version, run = self.current(), new_run_id()
        staged = f"staging/run={run}"

        def staging(df: DataFrame, name: str) -> DataFrame:
            self._tidy(lambda: self.write(f"{staged}/{name}", df))
            return self.read(f"{staged}/{name}", df.schema)

        rows = docs.select("path", F.coalesce("deleted", F.lit(False)).alias("deleted"), words(F.coalesce("body", F.lit(""))).alias("words"))
        blanks = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))
        rows = staging(rows.withColumn("length", F.when(F.col("words") == "", 0).otherwise(blanks + 1).cast("long")), "rows")
        changed = rows.count()
        have = sum(n for name, n in version.rows.items() if name.startswith("paths/"))
        before = next((int(n.split("/")[1]) for n in self._segments(version, "paths").values()), 1)
        segments = before
        while have + changed > 2 * segments * SEGMENT_DOCS:
            segments *= 2

        def home(count: int) -> Column:
            return F.pmod(F.xxhash64("path"), F.lit(count)).cast("int")

        touched = {r[0] for r in rows.select(home(segments)).distinct().collect()}
        old = touched
        if segments != before:
            touched, old = set(range(segments)), set(range(before))
        ids = guarded_broadcast(rows.select("path").distinct().withColumn("gone", F.lit(True)), changed)
        there = self._stored(version, "paths", PATHS, old).join(ids, "path", "left")
        there = staging(there.withColumn("to", F.when(F.col("gone").isNull(), home(segments))).drop("gone"), "there")
        moved = staging(self._moved(there), "moved")
        live = rows.where(~F.col("deleted")).drop("deleted").withColumns({"segment": home(segments), "band": F.length(F.bin("length"))})
        parts = live.groupBy("segment", "band").agg(F.ceil(F.greatest(F.sum("length"), F.lit(1)) / GROUP_WORDS).alias("parts"))
        live = live.join(guarded_broadcast(parts, segments * 64), ["segment", "band"])
        live = live.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "path"), "parts").cast("int")).drop("parts")
        paths = self._kept_paths(there, moved).unionByName(self._fresh_paths(live, version.number + 1))
        # the words of a new document travel once, as one text; kept blocks are rewritten where they lie
        fresh = live.groupBy("segment", "band", "part").applyInArrow(_cut(version.number + 1, BLOCK_DOCS), PLACED)
        blocks = self._kept_blocks(self._stored(version, "blocks", BLOCKS, old), there, moved).unionByName(fresh)
        folders = {}
        for kind, df, order in (("paths", paths, ["segment", "path"]), ("blocks", blocks, ["segment", "term", "block"])):
            folders[kind] = f"{kind}/run={run}"
            # sorted by term, so that a reader skips row groups of other terms
            done = df.sortWithinPartitions(*order).write.mode("error").option("compression", CODEC).partitionBy("segment")
            self._tidy(lambda done=done, kind=kind: done.parquet(f"{self.root}/{folders[kind]}"))
        gone = {n for kind in folders for s, n in self._segments(version, kind).items() if s in old or segments != before}
        tables = {n: f for n, f in version.tables.items() if n not in gone}
        sizes = {n: c for n, c in version.rows.items() if n not in gone}
        for kind, folder in folders.items():
            filled = {int(p.split("=", 1)[1]) for p in self.subfolders(folder)}
            tables |= {f"{kind}/{segments}/{s}": f"{folder}/segment={s}" for s in filled}
            if kind == "paths" and filled:
                counted = self.spark.read.schema(T.StructType([T.StructField("segment", T.IntegerType())])).parquet(f"{self.root}/{folder}")
                sizes |= {f"paths/{segments}/{r.segment}": r["count"] for r in counted.groupBy("segment").count().collect()}
        self.commit(version, tables, sizes)
        self._fs().delete(self._path(staged), True)
        return touched

    @staticmethod
    def _moved(there: DataFrame) -> DataFrame:
        """For each block and segment that it goes on in: the block it goes `into`, the first number there, and whether others do.

        Blocks that are less than half full go together, in turn, up to the size of a block.
        """
        half = BLOCK_DOCS // 2
        pieces = there.where("to is not null").groupBy("segment", "block", "to").agg(F.count("*").alias("n"))
        own = Window.partitionBy("to", "sparse")
        turn = own.orderBy("block", "segment").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.withColumn("sparse", F.col("n") < half)
        pieces = pieces.withColumn("ahead", F.when(F.col("sparse"), F.coalesce(F.sum("n").over(turn), F.lit(0))))
        pieces = pieces.withColumn("bundle", F.when(F.col("sparse"), F.floor(F.col("ahead") / half)).otherwise(F.col("block")))
        bundle = Window.partitionBy("to", "sparse", "bundle")
        return pieces.select(
            "segment", "block", "to",
            F.min("block").over(bundle).alias("into"),
            F.coalesce(F.col("ahead") - F.min("ahead").over(bundle), F.lit(0)).alias("first"),
            (F.count("*").over(bundle) > 1).alias("bundled"),
        )

    @staticmethod
    def _placed(there: DataFrame, moved: DataFrame) -> DataFrame:
        turn = Window.partitionBy("segment", "block", "to").orderBy("doc")
        placed = there.join(moved, ["segment", "block", "to"], "left")
        number = F.when(F.col("to").isNotNull(), F.col("first") + F.row_number().over(turn) - 1)
        return placed.withColumn("now", number.cast("smallint"))

    def _kept_paths(self, there: DataFrame, moved: DataFrame) -> DataFrame:
        kept = self._placed(there, moved).where("to is not null")
        return kept.select("path", "length", F.col("into").alias("block"), F.col("now").alias("doc"), F.col("to").alias("segment"))

    @staticmethod
    def _fresh_paths(live: DataFrame, refresh: int) -> DataFrame:
        turn = Window.partitionBy("segment", "band", "part").orderBy(F.col("length").desc(), "path")
        rank = live.select("path", "length", "segment", "band", "part", (F.row_number().over(turn) - 1).alias("rank"))
        local = F.floor(F.col("rank") / BLOCK_DOCS)
        block = _number(refresh, F.col("band").cast("long"), F.col("part"), local)
        return rank.select("path", "length", block.cast("long").alias("block"), (F.col("rank") % BLOCK_DOCS).cast("smallint").alias("doc"), "segment")

    def _kept_blocks(self, blocks: DataFrame, there: DataFrame, moved: DataFrame) -> DataFrame:
        """Stored blocks without the documents that are gone; only those that are put together are shuffled."""
        every = F.sort_array(F.collect_list(F.struct("doc", "to", "now")))
        numbers = self._placed(there, moved).groupBy("segment", "block").agg(every.alias("every"))
        moves = moved.join(numbers, ["segment", "block"]).withColumn(
            "now", F.transform("every", lambda d: F.when(d["to"] == F.col("to"), d["now"]))
        )
        moves = moves.select("segment", "block", "to", "into", "bundled", "now")

        def now(doc: Column, count: Column) -> Column:
            return F.struct(F.get(F.col("now"), doc.cast("int")).alias("doc"), count.alias("count"))

        left = F.filter(F.zip_with("docs", "counts", now), lambda p: p["doc"].isNotNull())
        rows = blocks.join(guarded_broadcast(moves, moved.count()), ["segment", "block"])
        # exploded from a list of one, so that it is worked out once for all that reads it
        rows = rows.select(F.col("to").alias("segment"), F.col("into").alias("block"), "term", "bundled", F.explode(F.array(left)).alias("left"))
        rows = rows.where(F.size("left") > 0).select(
            "segment", "block", "term", "bundled", F.col("left.doc").alias("docs"), F.col("left.count").alias("counts")
        )
        kept = rows.where(~F.col("bundled")).drop("bundled")
        if not moved.where("bundled").isEmpty():
            bundles = rows.where("bundled").groupBy("segment", "block", "term").agg(
                F.sort_array(F.collect_list(F.struct("docs", "counts"))).alias("parts")
            )
            kept = kept.unionByName(
                bundles.select("segment", "block", "term", F.flatten("parts.docs").alias("docs"), F.flatten("parts.counts").alias("counts"))
            )
        return kept.withColumns({"n": F.size("docs").cast("long"), "most": F.array_max("counts").cast("long")})

    def frequencies(self) -> DataFrame:
        """(term, df): documents that hold each term, from block counts alone."""
        blocks = self._stored(self.current(), "blocks", BLOCKS)
        return blocks.groupBy("term").agg(F.sum("n").alias("df"))

    def search(self, words: list[str], limit: int) -> Found:
        """The `limit` best documents by term frequency against document frequency.

        A block's greatest counts bound the score of every document in it. The blocks of the highest
        bounds are scored first; blocks whose bound stays below the k-th score found there are not read.
        """
        version = self.current()
        wanted = sorted({w.lower() for w in words})
        held = self._stored(version, "blocks", BLOCKS).where(F.col("term").isin(wanted))
        frequency = {r.term: r.df for r in held.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        if not frequency:
            return Found(self.spark.createDataFrame([], "path string, score double"), 0, 0)
        documents = sum(n for name, n in version.rows.items() if name.startswith("paths/"))
        weight = F.element_at(
            F.create_map(*[F.lit(x) for t, df in frequency.items() for x in (t, math.log1p(documents / df))]), F.col("term")
        )
        place = ["segment", "block"]
        bounds = settled(held.groupBy(*place).agg(F.sum(F.col("most") * weight).alias("bound")))
        total = bounds.count()

        def scored(chosen: DataFrame, rows: int) -> DataFrame:
            chosen = guarded_broadcast(chosen.select(*place), rows)
            mine = held.join(chosen, place, "left_semi")
            each = mine.select(*place, weight.alias("w"), F.explode(F.arrays_zip("docs", "counts")).alias("p"))
            each = each.groupBy(*place, F.col("p.docs").alias("doc")).agg(F.round(F.sum(F.col("p.counts") * F.col("w")), 6).alias("score"))
            paths = self._stored(version, "paths", PATHS).join(chosen, place, "left_semi")
            return each.join(paths, [*place, "doc"]).select("path", "score")

        best = [F.col("score").desc(), F.col("path")]
        first = bounds.orderBy(F.col("bound").desc(), *place).limit(FIRST_BLOCKS)
        top = scored(first, FIRST_BLOCKS).orderBy(*best).limit(limit).collect()
        # scores are rounded: a bound may fall short by as much
        floor = top[-1]["score"] - 1e-5 if len(top) == limit else 0.0
        open_ = bounds.where(F.col("bound") >= floor)
        read = open_.count()
        return Found(scored(open_, read).orderBy(*best).limit(limit), total, read)
