"""Shared helpers: tables, settled intermediates, batch slicing and vectorised word hashing."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: Bytes of text a task works on at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text``, so that further columns can't clash with an operator's own."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


class Scratch:
    """Intermediate tables below the shared folder.

    Each is written once and read back: it cuts lineage, and a lost executor costs one stage.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex[:12]}"
        self.made = 0

    def settle(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}"
        tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(tidy, "false")
        # what is written needs its shuffle files no more
        self.spark.conf.set(tidy, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(tidy, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, df: DataFrame) -> None:
        """Delete the files of a settled table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.root.split("://")[-1].lstrip("/") in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice has about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch[column].cast(pa.binary())).fill_null(0)
        cell = np.cumsum(np.asarray(sizes, dtype=np.int64)) // limit
        cuts = np.flatnonzero(np.diff(cell)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def mapper(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], column: str = "text"):
    """A ``mapInArrow`` function that applies ``fn`` to slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield from fn(part)

    return run


# --- word hashing -----------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            known = np.full(size, base, dtype=np.uint64)
            known[0] = 1
            known = np.multiply.accumulate(known)
        _POWERS[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 buffer."""
    data = np.frombuffer(buffer, dtype=np.uint8)
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    space = _SPACE[data]
    inside = np.concatenate(([False], ~space, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(starts):  # powers and products only for a bounded run of bytes
            base = starts[done]
            upto = max(done + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
            chunk = data[base : ends[upto - 1]]
            at = starts[done:upto] - base
            values = _BYTE[chunk] * _powers(_BASE, len(chunk))
            hashes[done:upto] = np.add.reduceat(values, at) * _powers(_INVERSE, len(chunk))[at]
            done = upto
    lengths = (ends - starts).astype(np.uint64)
    return mix(hashes + lengths), starts, ends


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(m, seed + n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xD1342543DE82EF95) + hashes[k : k + m] * np.uint64(2 * k + 3)
        return mix(out)


def nested_grams(hashes: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hash of each run of as many words, for each size; longer runs go on from shorter ones."""
    found, out = {}, np.zeros(len(hashes), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(max(sizes), len(hashes))):
            out = out[: len(hashes) - k]
            out *= np.uint64(0xD1342543DE82EF95)
            out += hashes[k:] * np.uint64(2 * k + 3)
            if k + 1 in sizes:
                found[k + 1] = mix(out + np.uint64(k + 1))
    return [found.get(n, np.zeros(0, dtype=np.uint64)) for n in sizes]


def joined(column: pa.Array, lower: bool = False) -> tuple[bytes, np.ndarray]:
    """All texts as one buffer, a line feed after each, and the start of each; null is empty."""
    parts = [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]
    if lower:
        parts = [x.lower() for x in parts]  # bytes.lower changes A-Z only
    starts = np.cumsum([0, *(len(x) + 1 for x in parts)])
    return b"\n".join([*parts, b""]), starts


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def cell_counts(df: DataFrame, cells: Callable[[pa.RecordBatch], np.ndarray], columns: list[str], bits: int) -> np.ndarray:
    """How often each of ``2**bits`` cells occurs over all rows: a sketch of fixed size.

    Each task counts in one array and sends it in blocks; blocks are added by a grouped sum. The
    driver gets ``4 * 2**bits`` bytes, however large the table.
    """

    def count(total: np.ndarray, at: np.ndarray) -> None:
        at, n = np.unique(at, return_counts=True)
        total[at] += n.astype(np.uint32)

    def add(blocks: list[np.ndarray]) -> np.ndarray:
        return np.minimum(sum(b.astype(np.uint64) for b in blocks), 0xFFFFFFFF).astype("<u4")

    return _cell_blocks(df, cells, columns, bits, np.dtype("<u4"), count, lambda part: part, add)


def cells_used(df: DataFrame, cells: Callable[[pa.RecordBatch], np.ndarray], columns: list[str], bits: int) -> np.ndarray:
    """Which of ``2**bits`` cells occur over all rows, eight to a byte as of ``np.packbits``.

    Gathered like the counts of ``cell_counts``, in one byte a cell of a task and one bit elsewhere.
    """

    def mark(total: np.ndarray, at: np.ndarray) -> None:
        total[at] = 1

    return _cell_blocks(df, cells, columns, bits, np.dtype("u1"), mark, np.packbits, np.bitwise_or.reduce)


def _cell_blocks(
    df: DataFrame, cells: Callable, columns: list[str], bits: int, kind: np.dtype, fill: Callable, pack: Callable, add: Callable
) -> np.ndarray:
    """Each task's cells, filled by ``fill`` and sent in blocks made by ``pack``; blocks meet in ``add``."""
    block = 1 << min(bits, 14)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, kind)
        for part in slices(batches, columns[0]) if columns[0] == "text" else batches:
            if part.num_rows:
                fill(total, cells(part))
        parts = total.reshape(-1, block)
        used = np.flatnonzero(parts.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 64)) if len(used) else ():
            rows = [zlib.compress(pack(parts[k]).tobytes(), 1) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some), binary(rows)], ["block", "cells"])

    def meet(batch: pa.Table) -> pa.Table:
        total = add([np.frombuffer(zlib.decompress(x), kind) for x in batch["cells"].to_pylist()])
        return pa.table({"block": pa.array([batch["block"][0].as_py()]), "cells": binary([total.tobytes()])})

    schema = "block bigint, cells binary"
    out = np.zeros(((1 << bits) // block, len(pack(np.zeros(block, kind)))), kind)
    for row in df.select(*columns).mapInArrow(count, schema).groupBy("block").applyInArrow(meet, schema).collect():
        out[row["block"]] = np.frombuffer(row["cells"], kind)
    return out.reshape(-1)
