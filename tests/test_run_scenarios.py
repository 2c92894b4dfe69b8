"""Multi-run scenarios over one state folder."""

from __future__ import annotations

import pytest

from kit import DROPS_A, GROUNDING, Keep, Rows, doc, go, path
from tidemark.plans.run import Aborted, FetchContractError, NoOp, Published
from tidemark.plans.state import ConcurrentRunError, State


def ids(spark, root):
    state = State(spark, str(root))
    return sorted(r.doc_id for r in state.mirror(state.current()).collect())


def lineage(spark, root):
    state = State(spark, str(root))
    return {r.owner_id: r.recorded for r in state.lineage(state.current()).collect()}


def test_publish_then_replay_is_noop_and_writes_nothing(spark, tmp_path):
    outcome, kept = go(spark, tmp_path, Rows(doc("a.md"), doc("b.md")))
    assert isinstance(outcome, Published) and outcome.counts["added"] == 2
    assert kept.last["branch"] == "sync/sys"
    before = State(spark, str(tmp_path)).current()
    again, silent = go(spark, tmp_path, Rows(doc("a.md"), doc("b.md")))
    assert isinstance(again, NoOp) and silent.last is None
    assert State(spark, str(tmp_path)).current() == before


@pytest.mark.slow
def test_absence_is_no_deletion_and_unchanged_docs_refresh(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("a.md"), doc("b.md")))
    outcome, kept = go(spark, tmp_path, Rows(doc("a.md", text="new")))
    assert isinstance(outcome, Published)
    assert ids(spark, tmp_path) == ["sys:a.md", "sys:b.md"]
    assert list(kept.last["files"]) == [path("a")]


def test_tombstone_removes_file_and_keeps_referrers_other_links(spark, tmp_path):
    first = Rows(doc("gone.md"), doc("other.md"),
                 doc("ref.md", relations=["sys:gone.md", "sys:other.md"]))
    _, kept = go(spark, tmp_path, first)
    assert kept.last["concepts"][path("ref")].links == [path("gone"), path("other")]
    outcome, kept = go(spark, tmp_path, Rows(doc("gone.md", deleted=True)))
    assert isinstance(outcome, Published)
    assert kept.last["removed"] == [path("gone")]
    assert kept.last["concepts"][path("ref")].links == [path("other")]
    assert any(path("ref") in n and "this run removes" in n for n in kept.notes)
    assert ids(spark, tmp_path) == ["sys:other.md", "sys:ref.md"]


@pytest.mark.slow
def test_deletion_only_run_names_the_removed_system_branch(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("a.md")))
    _, kept = go(spark, tmp_path, Rows(doc("a.md", deleted=True)))
    assert kept.last["branch"] == "sync/sys" and not kept.last["files"]


def test_fetch_contract(spark, tmp_path):
    with pytest.raises(FetchContractError, match="more than one record claims this id: sys:a.md"):
        go(spark, tmp_path, Rows(doc("a.md"), doc("a.md", text="x")))
    with pytest.raises(FetchContractError, match="deletion reported by a partial fetch: sys:a.md"):
        go(spark, tmp_path, Rows(doc("a.md", deleted=True), complete=False))
    with pytest.raises(FetchContractError, match="visible source id"):
        go(spark, tmp_path, Rows(doc("​")))
    assert State(spark, str(tmp_path)).current().number == 0


def test_failed_publisher_moves_nothing(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("a.md")))
    before = State(spark, str(tmp_path)).current()
    with pytest.raises(RuntimeError, match="down"):
        go(spark, tmp_path, Rows(doc("a.md", text="new")), Keep(fail=True))
    assert State(spark, str(tmp_path)).current() == before
    outcome, _ = go(spark, tmp_path, Rows(doc("a.md", text="new")))
    assert isinstance(outcome, Published)


def test_path_collision_across_systems_aborts(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("readme")))
    outcome, kept = go(spark, tmp_path, Rows(doc("readme", system="plant")))
    assert isinstance(outcome, Aborted) and kept.last is None
    assert any(law == "bundle-path-collision" and "plant:readme" in m for _, law, m in outcome.failures)
    assert ids(spark, tmp_path) == ["sys:readme"]


@pytest.mark.slow
def test_removing_and_adding_one_path_in_one_run_aborts(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("policy")))
    outcome, _ = go(spark, tmp_path, Rows(doc("policy", deleted=True), doc("policy.md")))
    assert isinstance(outcome, Aborted)


def test_cross_system_relation_aborts(spark, tmp_path):
    outcome, _ = go(spark, tmp_path, Rows(doc("a", relations=["plant:b"])))
    assert isinstance(outcome, Aborted)
    assert any(law == "cross-system-relation" and "plant:b" in m for _, law, m in outcome.failures)


@pytest.mark.slow
def test_link_is_not_rescued_by_another_system(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("b", system="plant")))
    _, kept = go(spark, tmp_path, Rows(doc("a", relations=["sys:b"])))
    assert kept.last["concepts"][path("a")].links == []


@pytest.mark.slow
def test_other_systems_referrer_stays_out(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("gone"), doc("ref", relations=["sys:gone"])))
    go(spark, tmp_path, Rows(doc("x", system="plant", text="x")))
    _, kept = go(spark, tmp_path, Rows(doc("gone", deleted=True)))
    assert list(kept.last["files"]) == [path("ref")]
    assert kept.last["branch"] == "sync/sys"


# ---------------------------------------------------------------- grounding


def _ground(spark, root, generator=GROUNDING, text="manual"):
    go(spark, root, Rows(doc("pump-7", system="plant", text=text)))
    return go(spark, root, Rows(doc("a")), generator=generator, grounding={"sys:a": ["plant:pump-7"]})


def test_grounded_concept_cites_owner_first_and_replay_is_noop(spark, tmp_path):
    _, kept = _ground(spark, tmp_path)
    assert [s.id for s in kept.last["concepts"][path("a")].sources] == ["sys:a", "plant:pump-7"]
    assert list(lineage(spark, tmp_path)["sys:a"]) == ["plant:pump-7"]
    outcome, _ = go(spark, tmp_path, Rows(doc("a")), generator=GROUNDING, grounding={"sys:a": ["plant:pump-7"]})
    assert isinstance(outcome, NoOp)


def test_drift_reopens_the_owner_on_its_own_next_run(spark, tmp_path):
    _ground(spark, tmp_path)
    _, kept_b = go(spark, tmp_path, Rows(doc("pump-7", system="plant", text="v2")), generator=GROUNDING,
                   grounding={"sys:a": ["plant:pump-7"]})
    assert path("a") not in kept_b.last["files"]
    outcome, kept = go(spark, tmp_path, Rows(doc("a")), generator=GROUNDING, grounding={"sys:a": ["plant:pump-7"]})
    assert isinstance(outcome, Published) and path("a") in kept.last["files"]
    assert any("another system" in n for n in kept.notes)


def test_drift_is_found_when_the_fetch_is_empty(spark, tmp_path):
    _ground(spark, tmp_path)
    go(spark, tmp_path, Rows(doc("pump-7", system="plant", text="v2"), name="b"))
    outcome, kept = go(spark, tmp_path, Rows(), generator=GROUNDING, grounding={"sys:a": ["plant:pump-7"]})
    assert isinstance(outcome, Published) and list(kept.last["files"]) == [path("a")]
    state = State(spark, str(tmp_path))
    assert state.cursor(state.current(), "rows", {}).systems == ["sys"]


def test_emptied_grounding_settles_after_one_rebuild(spark, tmp_path):
    _ground(spark, tmp_path)
    rebuilt, kept = go(spark, tmp_path, Rows(doc("a")), generator=GROUNDING)
    assert isinstance(rebuilt, Published) and len(kept.last["concepts"][path("a")].sources) == 1
    assert lineage(spark, tmp_path) == {}
    settled, _ = go(spark, tmp_path, Rows(doc("a")), generator=GROUNDING)
    assert isinstance(settled, NoOp)


@pytest.mark.slow
def test_unresolvable_id_is_recorded_empty_and_picked_up_later(spark, tmp_path):
    gmap = {"sys:a": ["plant:pump-7"]}
    _, kept = go(spark, tmp_path, Rows(doc("a")), generator=GROUNDING, grounding=gmap)
    assert any("names no document here" in n for n in kept.notes)
    assert lineage(spark, tmp_path) == {"sys:a": {}}
    again, _ = go(spark, tmp_path, Rows(doc("a")), generator=GROUNDING, grounding=gmap)
    assert isinstance(again, NoOp)
    go(spark, tmp_path, Rows(doc("pump-7", system="plant", text="s"), name="b"))
    found, kept = go(spark, tmp_path, Rows(), generator=GROUNDING)
    assert isinstance(found, NoOp)  # without the map nothing is declared
    found, kept = go(spark, tmp_path, Rows(), generator=GROUNDING, grounding=gmap)
    assert isinstance(found, Published)
    assert [s.id for s in kept.last["concepts"][path("a")].sources] == ["sys:a", "plant:pump-7"]


@pytest.mark.slow
def test_grounded_by_edit_alone_rebuilds(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("pump-7", system="plant", text="s")))
    go(spark, tmp_path, Rows(doc("a"), doc("b", text="b")), generator=GROUNDING)
    edited = Rows(doc("a", grounded_by=["plant:pump-7"]))
    outcome, kept = go(spark, tmp_path, edited, generator=GROUNDING)
    assert isinstance(outcome, Published)
    assert [s.id for s in kept.last["concepts"][path("a")].sources] == ["sys:a", "plant:pump-7"]
    settled, _ = go(spark, tmp_path, edited, generator=GROUNDING)
    assert isinstance(settled, NoOp)


@pytest.mark.slow
def test_tombstoned_owner_leaves_no_lineage(spark, tmp_path):
    _ground(spark, tmp_path)
    go(spark, tmp_path, Rows(doc("a", deleted=True)), generator=GROUNDING, grounding={"sys:a": ["plant:pump-7"]})
    assert lineage(spark, tmp_path) == {}


def test_rebuild_by_a_plain_generator_clears_lineage(spark, tmp_path):
    _ground(spark, tmp_path)
    _, kept = go(spark, tmp_path, Rows(doc("a", text="v2")))
    assert len(kept.last["concepts"][path("a")].sources) == 1
    assert lineage(spark, tmp_path) == {}


@pytest.mark.slow
def test_document_the_generator_dropped_keeps_its_lineage(spark, tmp_path):
    _ground(spark, tmp_path)
    before = lineage(spark, tmp_path)
    outcome, kept = go(spark, tmp_path, Rows(doc("a", text="v2"), doc("b", text="b")), generator=DROPS_A,
                       grounding={"sys:a": ["plant:pump-7"]})
    assert isinstance(outcome, Published) and path("a") not in kept.last["files"]
    assert lineage(spark, tmp_path) == before


@pytest.mark.slow
def test_drift_and_referrer_render_once(spark, tmp_path):
    gmap = {"sys:a": ["plant:pump-7"]}
    go(spark, tmp_path, Rows(doc("pump-7", system="plant", text="s"), name="b"))
    go(spark, tmp_path, Rows(doc("a", relations=["sys:gone"]), doc("gone", text="g")), generator=GROUNDING, grounding=gmap)
    go(spark, tmp_path, Rows(doc("pump-7", system="plant", text="v2"), name="b"))
    _, kept = go(spark, tmp_path, Rows(doc("gone", deleted=True)), generator=GROUNDING, grounding=gmap)
    assert kept.last["sources"].count("sys:a") == 1
    assert len(kept.notes) == 2


# ---------------------------------------------------------------- state


def test_two_configurations_keep_two_cursors(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("a"), payload={"at": 1}), config={"which": "one"})
    second = Rows(doc("x", system="plant"), payload={"at": 2})
    go(spark, tmp_path, second, config={"which": "two"})
    assert second.seen_cursor is None
    third = Rows(doc("a"))
    go(spark, tmp_path, third, config={"which": "one"})
    assert third.seen_cursor.payload == {"at": 1} and third.seen_cursor.systems == ["sys"]


def test_noop_discards_its_cursor(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("a"), payload={"at": 1}))
    go(spark, tmp_path, Rows(doc("a"), payload={"at": 2}))
    third = Rows(doc("a"))
    go(spark, tmp_path, third)
    assert third.seen_cursor.payload == {"at": 1}


def test_the_slower_of_two_writers_fails(spark, tmp_path):
    go(spark, tmp_path, Rows(doc("a")))
    state = State(spark, str(tmp_path))
    base = state.current()
    go(spark, tmp_path, Rows(doc("a", text="v2")))
    with pytest.raises(ConcurrentRunError):
        state.commit(base, dict(base.tables))
    assert state.current().number == 2


@pytest.mark.slow
def test_runs_table_and_observer(spark, tmp_path):
    seen = []
    go(spark, tmp_path, Rows(doc("a")), observer=lambda stage, facts: seen.append((stage, facts)))
    assert [s for s, _ in seen][:3] == ["fetch", "fetch_laws", "diff"]
    assert dict(seen)["diff"]["added"] == 1
    state = State(spark, str(tmp_path))
    row = state.runs(state.current()).first()
    assert row.outcome == "published" and row.added == 1
