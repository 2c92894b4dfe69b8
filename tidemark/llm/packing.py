"""Hierarchical packing of tokenised documents into sequences of several lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm import tokens
from tidemark.llm.common import binary, slices, texts

#: Context sizes, longest first. All are powers of two, so a full sequence needs no padding.
TIERS = (2048, 1024, 512, 256)
#: Tokens a task packs at once, and sequences of full length that make a step group.
WINDOW_TOKENS = 1 << 21
STEP_SEQUENCES = 8
END = 1

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint, tier bigint, step_group bigint, ids binary"
)


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of ``(document, start, length)``, for documents of these lengths.

    Whole windows of the longest tier are cut off first. What is left of a document goes to the
    shortest tier that holds it and seeds a sequence there; the gap behind it is filled from
    shorter tiers, largest fit first, the last filler being cut. A seed that finds no filler is
    cut at half the tier. The end of the shortest tier is cut into powers of two.
    """
    sequences, tail = [], []
    for d, n in enumerate(lengths):
        whole = n // tiers[0]
        sequences += [[(d, k * tiers[0], tiers[0])] for k in range(whole)]
        if n % tiers[0]:
            tail.append((n % tiers[0], d, whole * tiers[0]))
    pool = sorted(tail)
    for tier, shorter in zip(tiers[:-1], tiers[1:], strict=True):
        cut = bisect.bisect_right(pool, (shorter, 1 << 62, 0))
        seeds, pool = pool[cut:], pool[:cut]
        while seeds:
            n, d, at = seeds.pop()
            if n < tier and not pool:  # no filler left: cut, the rest fills others
                sequences.append([(d, at, shorter)])
                pool.append((n - shorter, d, at + shorter))
                continue
            sequence, gap = [(d, at, n)], tier - n
            while gap and pool:
                k = bisect.bisect_right(pool, (gap, 1 << 62, 0))
                n, d, at = pool.pop(k - 1 if k else 0)
                took = min(n, gap)
                sequence.append((d, at, took))
                if n > took:
                    bisect.insort(pool, (n - took, d, at + took))
                gap -= took
            if gap:  # the pool ran dry inside: give the pieces to shorter tiers
                pool = sorted((n, d, at) for d, at, n in sequence)
                over = [x for x in pool if x[0] > shorter]
                pool = [x for x in pool if x[0] <= shorter]
                for n, d, at in over:
                    sequences.append([(d, at, shorter)])
                    bisect.insort(pool, (n - shorter, d, at + shorter))
            else:
                sequences.append(sequence)
    last, room = [], tiers[-1]
    left = sum(n for n, _, _ in pool)
    room = _fit(left, tiers[-1])
    for n, d, at in sorted(pool, key=lambda x: (x[1], x[2])):
        while n:
            took = min(n, room)
            last.append((d, at, took))
            n, at, room, left = n - took, at + took, room - took, left - took
            if not room:
                sequences.append(last)
                last, room = [], _fit(left, tiers[-1])
    return sequences


def _fit(left: int, most: int) -> int:
    """The largest power of two that ``left`` tokens fill, ``most`` at most."""
    return min(most, 1 << max(left, 1).bit_length() - 1)


def step_groups(sizes: list[int], full: int, per_group: int = STEP_SEQUENCES) -> list[int]:
    """A group for each sequence, so that groups have about ``per_group * full`` tokens of all tiers."""
    groups = max(1, round(sum(sizes) / (full * per_group)))
    out = [0] * len(sizes)
    for rank, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        turn, at = divmod(rank, groups)
        out[i] = at if turn % 2 == 0 else groups - 1 - at
    return out


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence.

    Each task encodes its documents, ends each with id 1 and packs them window by window of
    bounded size, so no document moves and the plan has no shuffle. Sequences have a length that
    is a power of two: there is no padding. Sequence ids hold the partition, so a task that runs
    again gives the same ones.

    A null text counts as empty: one piece with the end id. Rows with a null ``doc_id`` and
    repeated rows are packed row by row. Long texts are encoded whole and cut into pieces. An
    empty table gives no pieces. Further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens.read_vocabulary(vocabulary))
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(shared.value)
        base, made, grouped = TaskContext.get().partitionId() << 36, 0, 0
        ids, encoded, held = [], [], 0
        for part in slices(batches):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids.append(doc_id)
                encoded.append(bpe.encode(text) + end)
                held += len(encoded[-1]) // 4
                if held >= window_tokens:
                    batch, n, g = _pieces(ids, encoded, base + made, base + grouped, tiers)
                    yield batch
                    ids, encoded, held, made, grouped = [], [], 0, made + n, grouped + g
        if ids:
            yield _pieces(ids, encoded, base + made, base + grouped, tiers)[0]

    return texts(docs).mapInArrow(run, PIECES)


def _pieces(ids, encoded, first: int, group: int, tiers) -> tuple[pa.RecordBatch, int, int]:
    sequences = plan([len(x) // 4 for x in encoded], tiers)
    sizes = [sum(n for _, _, n in s) for s in sequences]
    groups = step_groups(sizes, tiers[0])
    rows = []
    for k, (sequence, size) in enumerate(zip(sequences, sizes, strict=True)):
        offset = 0
        for d, at, n in sequence:
            piece = encoded[d][4 * at : 4 * (at + n)]
            rows.append(
                (ids[d], at, n, zlib.crc32(piece), len(encoded[d]) // 4, first + k, offset, size, group + groups[k], piece)
            )
            offset += n
    *columns, pieces = zip(*rows, strict=True)
    arrays = [pa.array(c, type=pa.int64()) for c in columns]
    names = [x.split()[0] for x in PIECES.split(",")]
    return pa.RecordBatch.from_arrays([*arrays, binary(list(pieces))], names), len(sequences), 1 + max(groups)
