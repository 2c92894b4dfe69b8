"""Long documents that share passages and don't resemble each other meet at few places."""

import numpy as np

from test_llm_operators import rows, similar
from tidemark.llm import jaccard


def _woven(docs, words, shared, seed):
    """Each two documents have a passage of their own in common; sketches of such sets are full."""
    rng = np.random.default_rng(seed)
    parts = [[" ".join(f"o{d}x{k}" for k in range(words - shared * (docs - 1)))] for d in range(docs)]
    for a in range(docs):
        for b in range(a):
            passage = " ".join(f"p{a}y{b}z{k}" for k in range(shared))
            parts[a].append(passage)
            parts[b].append(passage)
    return [(d, " ".join(rng.permutation(p))) for d, p in enumerate(parts)]


def test_pairs_meet_where_their_overlap_may_begin(spark, monkeypatch):
    table = [*_woven(64, 4000, 5, 3), (100, " ".join(f"c{k}" for k in range(500)))]
    table.append((101, table[-1][1] + " one more"))
    met, cross = [], jaccard.cross_pairs

    def counted(*args):
        out = cross(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cross_pairs", counted)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = sorted(map(repr, rows(jaccard.similar_documents(docs, 5, 80))))
    assert got == similar(table, 5, 80)
    # 324 pairs have a common shingle in their prefixes, 165 of them one early enough; hubs take some of either
    assert met[0] < 120
