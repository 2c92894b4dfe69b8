"""Feeds that land a record more than once, and state that must outlive a bad run."""

import json

import pytest

from kit import Keep, Rows, doc, go
from tidemark.plans.bindings import IssueFeed, ToolResponses
from tidemark.plans.run import Published
from tidemark.plans.state import State
from tidemark.sources import issues
from tidemark.streaming.micro_batches import run_stream


def line(number, day, title="t", **more):
    return json.dumps(
        {"number": number, "title": title, "body": "b", "state": "open", "updated_at": f"2025-03-{day:02d}T00:00:00Z"} | more
    )


def texts(spark, root):
    state = State(spark, str(root))
    return {r.native_id: r.title for r in state.mirror(state.current()).collect()}


def test_an_issue_that_lands_again_is_one_record(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    config = {"repo": "ship/yard", "path": str(landing)}
    (landing / "1").write_text("\n".join([line(1, 1), line(2, 1), line(2, 3, "newer"), "{broken", "[1]", '{"title":"x"}']))
    source = IssueFeed()
    fetch = source.fetch(spark, config, None)
    assert not fetch.complete and fetch.rejects.count() == 3
    outcome, _ = go(spark, tmp_path / "state", source, config=config)
    assert isinstance(outcome, Published) and outcome.counts["added"] == 2
    assert texts(spark, tmp_path / "state") == {"ship/yard/issues/1": "t", "ship/yard/issues/2": "newer"}
    (landing / "2").write_text(line(1, 5, "later"))
    outcome, _ = go(spark, tmp_path / "state", source, config=config)
    assert isinstance(outcome, Published) and outcome.counts["modified"] == 1
    assert texts(spark, tmp_path / "state")["ship/yard/issues/1"] == "later"


def test_state_filter_looks_at_the_latest_landing(spark):
    landed = spark.createDataFrame([(line(4, 1),), (line(4, 2, state="closed"),)], "raw string")
    assert issues.fetch(landed, "ship/yard", state="open").count() == 0
    assert issues.fetch(landed, "ship/yard", state="closed").count() == 1


def test_stream_takes_the_later_of_two_updates_and_trusts_no_old_checkpoint(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    config = {"repo": "ship/yard", "path": str(landing)}

    def drain(checkpoint):
        raw = spark.readStream.text(str(landing)).withColumnRenamed("value", "raw")
        run_stream(
            issues.fetch(raw, "ship/yard"), IssueFeed(), Keep(), config=config, state_root=str(tmp_path / "state"),
            checkpoint=str(tmp_path / checkpoint), check_stability=False, run_id="same",
        ).awaitTermination()

    (landing / "1").write_text(line(1, 1) + "\n" + line(1, 2, "second"))
    drain("first")
    assert texts(spark, tmp_path / "state") == {"ship/yard/issues/1": "second"}
    (landing / "2").write_text(line(2, 4, "new"))
    drain("another")  # counts its batches from 0 again
    assert set(texts(spark, tmp_path / "state")) == {"ship/yard/issues/1", "ship/yard/issues/2"}


def test_a_run_id_used_twice_harms_nothing(spark, tmp_path):
    for text in ("one", "two"):
        outcome, _ = go(spark, tmp_path, Rows(doc("m.md", text=text)), run_id="fixed")
        assert isinstance(outcome, Published)
    state = State(spark, str(tmp_path))
    assert [r.text for r in state.mirror(state.current()).collect()] == ["two"]


@pytest.mark.parametrize(("ids", "said"), [(["docs/ok", "../up"], "cannot be used"), (["docs/a", "docs/a.md"], "several spellings")])
def test_configured_ids_are_checked_before_any_read(spark, tmp_path, ids, said):
    spark.createDataFrame([(i,) for i in ids], "raw_id string").write.parquet(str(tmp_path / "ids"))
    config = {"system": "s", "responses": "unread", "retrieved_at": "2025-01-01T00:00:00Z", "ids": str(tmp_path / "ids")}
    assert any(said in p for p in ToolResponses().problems(config))


def test_a_small_run_rewrites_one_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(State, "bucket_rows", 4)
    many = [doc(f"d{k}.md", text=str(k)) for k in range(40)]
    go(spark, tmp_path, Rows(*many))
    state = State(spark, str(tmp_path))
    first = {n: f for n, f in state.current().tables.items() if n.startswith("mirror/")}
    assert len(first) > 4
    outcome, _ = go(spark, tmp_path, Rows(doc("d7.md", text="changed")))
    assert isinstance(outcome, Published)
    second = {n: f for n, f in state.current().tables.items() if n.startswith("mirror/")}
    assert set(second) == set(first) and sum(second[n] != first[n] for n in first) == 1
    rows = {r.native_id: r.text for r in state.mirror(state.current()).collect()}
    assert len(rows) == 40 and rows["d7.md"] == "changed" and rows["d8.md"] == "8"
    go(spark, tmp_path, Rows(doc("d7.md", text="changed")))
    assert [r.outcome for r in state.outcomes().collect()] == ["no-op"]
    assert state.runs(state.current()).count() == 2
    assert any(f.startswith("staging/") for f in state.expire())
    assert state.mirror(state.current()).count() == 40


def test_review_tree_shares_untouched_buckets_with_its_base(spark, tmp_path, monkeypatch):
    """A proposal rewrites the buckets of its own paths; the others keep the folders they had."""
    from tidemark.plans import publishers
    from tidemark.plans.run import Proposal

    monkeypatch.setattr(publishers, "BUCKET_FILES", 10)
    review = publishers.ReviewBranches(spark, str(tmp_path))

    def propose(branch, files, removed=(), base="main"):
        none = spark.createDataFrame([], "section string, item string")
        proposal = Proposal(
            f"run{len(files)}", branch, spark.createDataFrame(files, "path string, content string"),
            spark.createDataFrame([(p,) for p in removed], "path string"), none, none, none,
        )
        review.publish(proposal, {"base": base})
        return {n: f for n, f in review.store.current().tables.items() if n.startswith("tree/")}

    first = propose("one", [(f"p{k}", "a") for k in range(200)])
    assert len(first) > 8
    second = propose("one", [("p7", "b"), ("new", "n")], ["p9", "never"])
    changed = [n for n in second if first.get(n) != second[n]]
    assert 1 <= len(changed) <= 4  # one for each path of the proposal
    tree = {r.path: r.content for r in review.tree("one").collect()}
    assert len(tree) == 200 and tree["p7"] == "b" and tree["new"] == "n" and "p9" not in tree
    # another branch on top of the first names its folders
    third = propose("two", [("p1", "z")], base="one")
    shared = set(third.values()) & set(second.values())
    assert len([n for n in third if n not in second]) == len(second) and len(shared) == len(second)
    other = {r.path: r.content for r in review.tree("two").collect()}
    assert other == tree | {"p1": "z"} and {r.path: r.content for r in review.tree("one").collect()} == tree


def test_a_plan_asks_for_a_whole_listing(spark, tmp_path):
    """A listing that says it is partial stops the plan; a whole one says what is an update."""
    from tidemark.operators import publish as pb
    from tidemark.plans.publishers import ReviewBranches
    from tidemark.plans.run import Proposal

    review = ReviewBranches(spark, str(tmp_path))
    none = spark.createDataFrame([], "section string, item string")
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    gone = spark.createDataFrame([("c",), ("d",)], "path string")
    proposal = Proposal("r", "work", files, gone, none, none, none)
    for schema, rows in (("branch string, complete boolean", [("main", False)]), ("branch string, path string, complete boolean", [("main", "a", False)])):
        with pytest.raises(pb.PartialListingError):
            review.publish(proposal, {"listing": spark.createDataFrame(rows, schema)})
    assert review.store.current().number == 0
    whole = spark.createDataFrame([("main", "a", True), ("main", "c", True), ("other", "d", False)], "branch string, path string, complete boolean")
    plan = pb.action_plan(files, gone, review.listing(review.tree("main"), "main", {"listing": whole}))
    assert sorted((r.path, r.action) for r in plan.collect()) == [("a", "update"), ("b", "create"), ("c", "delete")]
    review.publish(proposal, {"listing": whole})
    assert sorted(r.path for r in review.tree("work").collect()) == ["a", "b"]


def test_unsafe_paths_are_all_kept(spark):
    from tidemark.operators import publish as pb

    files = spark.createDataFrame([(f"../{k}", "x") for k in range(20)] + [("fine", "x")], "path string, content string")
    with pytest.raises(pb.PathError, match="20 unsafe paths") as caught:
        pb.require_safe_paths(files, files.select("path").limit(0))
    assert caught.value.rows.count() == 20
    listing = spark.createDataFrame([(f"b{k}", k > 8) for k in range(12)], "branch string, complete boolean")
    with pytest.raises(pb.PartialListingError, match="9 branches") as caught:
        pb.require_complete_listing(listing)
    assert caught.value.rows.count() == 9


def test_a_stream_drops_records_that_come_again(spark, tmp_path):
    """The same line in two files of one batch and in a later batch is run once."""
    landing = tmp_path / "in"
    landing.mkdir()
    config = {"repo": "ship/yard", "path": str(landing)}
    seen = []

    class Watching(IssueFeed):
        def normalize(self, records):
            seen.append(sorted(int(r[0].rsplit("/", 1)[1]) for r in records.select("native_id").collect()))
            return super().normalize(records)

    def drain():
        schema = spark.createDataFrame([], "raw string, landed timestamp").schema
        raw = spark.readStream.schema(schema).parquet(str(landing / "*"))
        records = issues.fetch(raw, "ship/yard")
        again = (["native_id", "updated_at"], "updated_at", "30 days")
        run_stream(
            records, Watching(), Keep(), config=config, state_root=str(tmp_path / "state"), checkpoint=str(tmp_path / "check"),
            replays=again, check_stability=False,
        ).awaitTermination()

    def land(name, *lines):
        spark.createDataFrame([(x, None) for x in lines], "raw string, landed timestamp").coalesce(1).write.parquet(str(landing / name))

    land("a", line(1, 1), line(2, 1))
    land("b", line(1, 1))
    drain()
    land("c", line(2, 1), line(3, 2))
    drain()
    assert [s for s in seen if s] == [[1, 2], [3]]  # a batch that only moves the watermark is empty
