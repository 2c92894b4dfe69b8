"""Families of near copies that resemble a base and not each other."""

import numpy as np
import pytest

from test_llm_operators import rows, similar
from tidemark.llm import jaccard
from tidemark.llm.common import Scratch


def _family(copies, words, changed, seed):
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(words)]
    table = [(10 * copies, " ".join(base))]
    for k in range(copies):
        own = list(base)
        for at in rng.choice(words, changed, replace=False):
            own[at] = f"c{k}x{at}"
        table.append((k, " ".join(own)))
    return table


class Counted(Scratch):
    """Keeps the row count of every settled table."""

    def __init__(self, *args):
        super().__init__(*args)
        self.counts = []

    def settle(self, df, codec="zstd"):
        out = super().settle(df, codec)
        self.counts.append((sorted(out.columns), out.count()))
        return out


@pytest.mark.parametrize("changed", [1, 2])
def test_copies_of_one_base_are_no_square(spark, changed):
    """600 copies: with one word changed each links with the base alone, with two words none does."""
    table = _family(600, 90, changed, 5)
    scratch = Counted(spark, "family")
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    found = {i: c for i, _, c in rows(jaccard.similar_documents(docs, 5, 80, scratch))}
    if changed == 1:
        assert set(found.values()) == {0}
    else:
        assert len(set(found.values())) > 300
    pairs = [n for columns, n in scratch.counts if columns[:2] == ["a", "b"]]
    assert max(pairs) < 10 * len(table)


def test_one_id_with_two_texts_of_one_size(spark):
    """Rows (1, A), (1, B), (2, A'), (3, B'): both neighbours of document 1 are found."""
    a, b = ([f"{c}{k}" for k in range(60)] for c in "ab")
    table = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "z"])), (3, " ".join([*b[:-1], "y"])), (4, "x")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    found = sorted((i, c) for i, _, c in rows(jaccard.similar_documents(docs, 5, 80)))
    assert found == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_marks_never_hide_a_link(spark):
    """Marks and sketches are upper bounds of the overlap, for sets that fill them too."""
    rng = np.random.default_rng(2)
    table = []
    for k, words in enumerate((30, 200, 3000)):
        base = [f"s{k}w{i}" for i in range(words)]
        for copy in range(12):
            own = list(base)
            for at in rng.choice(words, max(1, int(words * 0.004 * copy)), replace=False):
                own[at] = f"n{rng.integers(1 << 30)}"
            table.append((100 * k + copy, " ".join(own)))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert sorted(map(repr, rows(jaccard.similar_documents(docs, 5, 80)))) == similar(table, 5, 80)
