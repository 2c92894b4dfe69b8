"""Drift through the inverse of declarations against the scan of everything."""

import random
import shutil

from pyspark.sql import functions as F

from kit import GROUNDING, Rows, doc, go, path
from tidemark.operators import grounding as gr
from tidemark.plans.run import NoOp, Published
from tidemark.plans.state import State

SMAP = "owner_id string, grounding_id string"


def _library(rng, texts, urls):
    return [doc(f"t{k}", system="lib", text=texts[k], url=urls.get(k)) for k in sorted(texts)]


def _books(declared, edits=()):
    return [
        doc(f"o{k}", system="desk", text="new" if k in edits else "same", grounded_by=[f"lib:t{t}" for t in ids])
        for k, ids in sorted(declared.items())
    ]


def _lineage(spark, root):
    state = State(spark, str(root))
    return {r.owner_id: r.recorded for r in state.lineage(state.current()).collect()}


def _names(spark, root, kind):
    return {n: f for n, f in State(spark, str(root)).current().tables.items() if n.startswith(f"{kind}/")}


def test_few_owners_are_asked_and_none_is_missed(spark, tmp_path, monkeypatch):
    """Edits, removals, additions and moved addresses of what is cited; edited declarations and map rows."""
    monkeypatch.setattr(State, "bucket_rows", 5)
    rng = random.Random(11)
    texts = {k: f"text {k}" for k in range(40)}
    declared = {k: rng.sample(range(48), rng.randint(0, 4)) for k in range(60)}
    gmap = {f"desk:o{k}": [f"lib:t{k % 48}"] for k in range(0, 60, 7)}
    one, two = tmp_path / "inverse", tmp_path / "scan"
    go(spark, one, Rows(*_library(rng, texts, {}), name="lib"))
    first, _ = go(spark, one, Rows(*_books(declared), name="desk"), generator=GROUNDING, grounding=gmap)
    assert isinstance(first, Published)

    # the library moves on: a plain generator that knows nothing of owners
    moved = {k: texts[k] + "!" for k in (3, 4)} | {k: f"text {k}" for k in (41, 42)}
    changed = _library(rng, moved | {5: texts[5]}, {5: "https://x.example/5"})
    gone = [doc("t6", system="lib", deleted=True)]
    go(spark, one, Rows(*changed, *gone, name="lib"))
    shutil.copytree(one, two)

    declared[1], declared[2] = [7, 8], []
    gmap.pop("desk:o7")
    gmap["desk:o8"] = ["lib:t9", "lib:nowhere"]
    books = _books({k: declared[k] for k in range(0, 30)}, edits={0})
    facts = {}
    outcome, kept = go(spark, one, Rows(*books, name="desk"), generator=GROUNDING, grounding=gmap,
                       observer=lambda stage, f: facts.setdefault(stage, f))
    with monkeypatch.context() as patched:
        patched.setattr(State, "scanned_map", lambda *a: None)
        scanned, all_kept = go(spark, two, Rows(*books, name="desk"), generator=GROUNDING, grounding=gmap,
                               observer=lambda stage, f: facts.setdefault(f"scan {stage}", f))
    assert isinstance(outcome, Published) and outcome.counts == scanned.counts
    assert kept.last["files"] == all_kept.last["files"] and kept.notes == all_kept.notes
    assert facts["drift"]["drifted"] == facts["scan drift"]["drifted"] > 3
    assert facts["drift"]["candidates"] < facts["scan drift"]["candidates"] / 2
    assert _lineage(spark, one) == _lineage(spark, two)
    state = State(spark, str(one))
    inverse = {tuple(r) for r in state.cited(state.current()).collect()}
    other = State(spark, str(two))
    assert inverse == {tuple(r) for r in other.cited(other.current()).collect()}

    # nothing is left to do, and one edited owner rewrites one bucket of each table
    again, _ = go(spark, one, Rows(*books, name="desk"), generator=GROUNDING, grounding=gmap)
    assert isinstance(again, NoOp)
    before = {kind: _names(spark, one, kind) for kind in ("mirror", "lineage", "cited")}
    assert len(before["mirror"]) > 8 and len(before["lineage"]) > 4
    edit = doc("o59", system="desk", text="new", grounded_by=[f"lib:t{t}" for t in declared[59]])
    _, kept = go(spark, one, Rows(edit, name="desk"), generator=GROUNDING, grounding=gmap)
    assert list(kept.last["files"]) == [path("o59")]
    rewritten = {kind: [n for n, f in _names(spark, one, kind).items() if before[kind].get(n) != f] for kind in before}
    assert [len(rewritten[kind]) for kind in ("mirror", "lineage", "cited")] == [1, 1, 0]
    counts = State(spark, str(one)).current().rows
    assert sum(n for name, n in counts.items() if name.startswith("mirror/")) == 60 + 41


def test_inverse_advances_by_differences(spark):
    tracked = spark.createDataFrame(
        [("a", {"x": "1"}, ["x", "y"]), ("b", None, ["x"]), ("c", {}, [])],
        "owner_id string, recorded map<string,string>, declared array<string>",
    )
    news = spark.createDataFrame(
        [("a", True, None, None), ("b", False, None, ["y", "z"]), ("d", True, {"y": "2"}, ["y"]), ("c", True, None, [])],
        "owner_id string, decided boolean, recorded map<string,string>, declared array<string>",
    )
    for rows in (None, 4):
        after = {r.owner_id: (r.recorded, r.declared) for r in gr.advance_tracked(tracked, news, rows).collect()}
        assert after == {"a": (None, ["x", "y"]), "b": (None, ["y", "z"]), "d": ({"y": "2"}, ["y"])}
        moves = gr.edge_moves(tracked, news, rows)
        assert sorted(map(tuple, moves.collect())) == [("b", "x", -1), ("b", "y", 1), ("b", "z", 1), ("d", "y", 1)]
        cited = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "b")], "grounding_id string, owner_id string")
        now = gr.advance_cited(cited, moves, rows)
        assert sorted(map(tuple, now.collect())) == [("x", "a"), ("y", "a"), ("y", "b"), ("y", "d"), ("z", "b")]


def test_few_moved_ids_shuffle_no_inverse(spark):
    """The inverse is filtered where it lies; only hits travel."""
    cited = spark.range(1000).select(F.concat(F.lit("t"), "id").alias("grounding_id"), F.lit("s:o").alias("owner_id"))
    moved = spark.createDataFrame([("t5",)], "doc_id string")
    plan = gr.citing(cited, moved, 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
