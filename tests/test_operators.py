"""Operators on small fixtures, skew above all."""

import os

import pytest
from pyspark.sql import functions as F

from kit import GROUNDING, Keep, Rows, doc, go, path
from tidemark.operators import catalog, concepts, publish
from tidemark.operators import grounding as gr
from tidemark.operators.changes import canonical_documents
from tidemark.operators.joins import hot_keys, skew_safe_join
from tidemark.plans.bindings import CommitLog, IssueFeed, MarkdownTree
from tidemark.plans.publishers import DryRun, ReviewBranches
from tidemark.sources import markdown
from tidemark.streaming.keyed_changes import classify_log
from tidemark.streaming.micro_batches import run_drift, run_stream


def test_hot_key_is_found_salted_and_joined_exactly(spark):
    """One key holds a third of the rows; every join kind keeps its rows."""
    n = 30_000
    left = spark.range(n).select(
        F.col("id").alias("owner"),
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("key"),
    )
    right = left.select("key").distinct().where(F.col("key") != "k7").withColumn("v", F.length("key"))
    hot = {r.key: r["__salts"] for r in hot_keys(left, "key", 8).collect()}
    assert list(hot) == ["hub"] and hot["hub"] >= 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            got = skew_safe_join(left, right, "key", how, ["owner"], 8)
            want = left.join(right, "key", how)
            assert got.exceptAll(want.select(*got.columns)).isEmpty() and got.count() == want.count()
        spread = skew_safe_join(left, right, "key", "inner", ["owner"], 8).where("key = 'hub'")
        assert spread.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_owner_with_many_declarations_keeps_every_id(spark):
    """A limit keeps the first five and has a note for each of the rest; without one all are kept."""
    n = 2_500
    owner = canonical_documents(spark.createDataFrame([("sys", "a")], "system string, native_id string"))
    targets = canonical_documents(
        spark.range(n).select(F.lit("o").alias("system"), F.format_string("%05d", F.col("id")).alias("native_id"))
    )
    smap = targets.select(F.lit("sys:a").alias("owner_id"), F.col("doc_id").alias("grounding_id"))
    ids = [f"o:{i:05d}" for i in range(n)]
    kept, notes = gr.resolve(owner, smap, targets, max_docs=5)
    assert [r.grounding_id for r in kept.orderBy("rank").collect()] == ids[:5]
    wanted = [f"{path('a')}: grounding {i} is beyond the limit of 5" for i in ids[5:]]
    assert sorted(r.note for r in notes.collect()) == wanted
    kept, notes = gr.resolve(owner, smap, targets)
    assert [r.grounding_id for r in kept.orderBy("rank").collect()] == ids and notes.isEmpty()


def test_log_classes_match_a_plain_walk_for_one_heavy_key(spark):
    import random

    rng = random.Random(3)
    rows = [("hub" if i % 3 == 0 else f"k{i % 40}", i * 977 % 400_000, i, rng.choice("abc")) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, s int, event_id long, content string").withColumn(
        "ts", F.timestamp_seconds("s")
    )
    got = {r.event_id: r.kind for r in classify_log(df).collect()}
    last, want = {}, {}
    for key, s, i, c in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = "added" if key not in last else "unchanged" if last[key] == c else "modified"
        last[key] = c
    assert got == want


def test_chunks_bound_their_size_and_lose_nothing(spark):
    df = spark.range(5000).select(
        F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("part")
    )
    sizes = catalog.chunks(df, "part", 100).groupBy("part", "chunk").count().collect()
    assert sum(r["count"] for r in sizes) == 5000 and max(r["count"] for r in sizes) == 100


def test_summary_sections_in_order(spark):
    changes = spark.createDataFrame([("s:b", "added"), ("s:a", "added"), ("s:c", "removed")], "doc_id string, kind string")
    notes = spark.createDataFrame([("n1",)], "note string")
    lines = publish.summary_lines(concepts.summary(changes, [notes])).orderBy("section_rank", "line_rank", "line")
    assert [r.line for r in lines.collect()] == [
        "# Proposed change", "", "## Added", "- concepts/a/overview.md", "- concepts/b/overview.md",
        "", "## Removed", "- concepts/c/overview.md", "", "## Notes", "- n1",
    ]


# ---------------------------------------------------------------- files and publishers


def put(root, rel, body):
    full = os.path.join(root, rel)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as handle:
        handle.write(body)


def test_markdown_tree(spark, tmp_path):
    root = str(tmp_path / "kb notes")
    put(root, "a.md", b"\xef\xbb\xbf---\r\ntitle: A\r\nowner: x\r\nsince: 2024-05-01\r\nrelations: [sub/b.md]\r\n---\r\n\r\nbody\r\n")
    put(root, "sub/b.md", b"---\nbad: yaml: here\n---\nplain")
    put(root, ".venv/lib/c.md", b"no")
    put(root, "drafts/d.md", b"no")
    put(root, "e.txt", b"no")
    records = markdown.read(spark, {"path": root, "ignore_globs": ["drafts/*"]})
    docs = {r.native_id: r for r in markdown.normalize(records).collect()}
    assert sorted(docs) == ["a.md", "sub/b.md"]
    a = docs["a.md"]
    assert (a.title, a.text, a.relations) == ("A", "body", ["local_files:sub/b.md"])
    assert a.structured == '{"owner":"x","since":"2024-05-01"}' and a.opaque_keys == ["since"]
    assert docs["sub/b.md"].text == "plain" and docs["sub/b.md"].title == "sub/b.md"


def test_dry_run_writes_and_deletes_files(spark, tmp_path):
    tree, out, state = str(tmp_path / "t"), str(tmp_path / "out"), tmp_path / "state"
    put(tree, "a.md", b"hello")
    go(spark, state, MarkdownTree(), DryRun(), config={"path": tree}, publish_config={"out_dir": out})
    file = os.path.join(out, "sync-local_files", path("a"))
    with open(file, encoding="utf-8") as handle:
        assert handle.read().endswith("# a.md\n\nhello\n")
    files = spark.createDataFrame([], "path string, content string")
    gone = spark.createDataFrame([(path("a"),), (path("never"),)], "path string")
    none = spark.createDataFrame([], "section string, item string")
    publish.write_bundle_files(files, gone, none, os.path.join(out, "sync-local_files"))
    assert not os.path.exists(file)


def test_review_branch_accumulates_until_closed(spark, tmp_path):
    branches = ReviewBranches(spark, str(tmp_path / "review"))
    go(spark, tmp_path / "s", Rows(doc("a"), doc("b")), branches)
    go(spark, tmp_path / "s", Rows(doc("a", deleted=True), doc("c", text="c")), branches)
    assert sorted(r.path for r in branches.tree("sync/sys").collect()) == [path("b"), path("c")]
    assert [tuple(r)[:2] for r in branches.proposals().collect()] == [("sync/sys", "open")]


def test_commit_log_moves_its_watermark(spark, tmp_path):
    log = str(tmp_path / "log")
    sep = "\x1f"

    def record(i):
        day = "2024-01-01T00:00:00+00:00"
        return (i, sep.join([f"{i:040d}", "me", "m@x", day, day, f"commit {i}", f"body {i}\n"]))

    spark.createDataFrame([record(i) for i in range(5)], "seq long, record string").write.parquet(log)
    config = {"log": log, "max_commits": 3}
    _, kept = go(spark, tmp_path / "s", CommitLog(), config=config)
    assert len(kept.last["files"]) == 3  # the bound holds for the first load
    spark.createDataFrame([record(i) for i in range(5, 10)], "seq long, record string").write.mode("append").parquet(log)
    _, kept = go(spark, tmp_path / "s", CommitLog(), config=config)
    assert len(kept.last["files"]) == 5  # and not for a delta


# ---------------------------------------------------------------- streaming


def issue(number, updated, body="b", **more):
    import json

    return json.dumps({"number": number, "title": f"I{number}", "body": body, "state": "open", "user": {"login": "u"},
                       "labels": [], "created_at": "2024-01-01T00:00:00Z", "updated_at": updated, "comments": 1, **more})


def test_stream_of_issues_publishes_once_per_change(spark, tmp_path):
    from tidemark.sources import issues

    landing = tmp_path / "in"
    landing.mkdir()
    state, check = tmp_path / "state", str(tmp_path / "check")

    def drain():
        kept = Keep()
        raw = spark.readStream.text(str(landing)).withColumnRenamed("value", "raw")
        query = run_stream(issues.fetch(raw, "acme/shop"), IssueFeed(), kept, config={"repo": "acme/shop", "path": str(landing)},
                           state_root=str(state), checkpoint=check, check_stability=False)
        query.awaitTermination()
        return kept.last

    (landing / "1.txt").write_text(issue(1, "2024-01-02T00:00:00Z") + "\n" + issue(2, "2024-01-02T00:00:00Z", pull_request={}))
    assert list(drain()["files"]) == ["concepts/acme/shop/issues/1/overview.md"]
    (landing / "2.txt").write_text(issue(1, "2024-02-02T00:00:00Z", comments=7))
    assert drain() is None  # only volatile fields moved


def test_drift_job_runs_without_new_records(spark, tmp_path):
    gmap = {"sys:a": ["plant:x"]}
    go(spark, tmp_path, Rows(doc("x", system="plant")))
    go(spark, tmp_path, Rows(doc("a", text="a")), generator=GROUNDING, grounding=gmap)
    go(spark, tmp_path, Rows(doc("x", system="plant", text="v2"), name="b"))
    kept = Keep()
    smap = spark.createDataFrame([("sys:a", "plant:x")], "owner_id string, grounding_id string")
    source = Rows(doc("a"))
    run_drift(spark, source, source.fetch(spark, {}, None).records, kept, config={}, state_root=str(tmp_path),
              generator=GROUNDING, subject_map=smap)
    assert list(kept.last["files"]) == [path("a")]


# ---------------------------------------------------------------- numbering, manifests, checks


def test_one_partition_with_all_rows_is_numbered_by_many_tasks(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("doc_id"), F.lit("only").alias("part"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        written = []

        def settle(rows):
            from tidemark.session import settled

            written.append(settled(rows))
            return written[-1]

        sizes = catalog.chunks(df, "part", 300, settle=settle).groupBy("chunk").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted(r["count"] for r in sizes) == sorted([300] * 66 + [200])
    shares = [r["count"] for r in written[0].groupBy(F.shiftright("__id", 33)).count().collect()]
    assert len(shares) == 8 and max(shares) < 20_000 / 4


def test_manifest_reads_only_buckets_that_differ(spark, tmp_path, monkeypatch):
    from tidemark.plans import manifests

    monkeypatch.setattr(manifests, "BUCKET_ROWS", 50)
    ids = spark.range(1000).select(F.format_string("x:%04d", "id").alias("doc_id"))
    store = manifests.Manifests(spark, str(tmp_path))
    store.replace("all", ids)
    store.replace("other", ids.limit(3))
    gone, odd, buckets = store.compare("all", ids.where("doc_id not in ('x:0007', 'x:0500')"))
    assert buckets == 16 and 1 <= len(odd) <= 2
    assert sorted(r.doc_id for r in gone.collect()) == ["x:0007", "x:0500"]
    assert len({f.split("/bucket=")[1].split("/")[0] for f in gone.inputFiles() if "bucket=" in f}) <= 2
    written = store.replace("all", ids.where("doc_id <> 'x:0007'"))
    assert len(written) == 1 and store.listed("all").count() == 999 and store.listed("other").count() == 3
    # an incomplete listing deletes nothing and is not kept
    assert manifests.tombstones(spark, str(tmp_path), "all", ids.limit(10), False).isEmpty()
    assert store.listed("all").count() == 999
    assert manifests.tombstones(spark, str(tmp_path), "all", ids.limit(0), True).count() == 999


def test_cards_addresses_and_tokens_are_checked(spark):
    import random

    from tidemark.operators import laws

    def valid(digits):
        total = 0
        for k, c in enumerate(reversed(digits)):
            d = int(c) * (1 + k % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    rng = random.Random(1)
    numbers = ["".join(rng.choices("0123456789", k=rng.randint(13, 19))) for _ in range(300)]
    df = spark.createDataFrame([(n,) for n in numbers], "d string")
    found = {r.d: r.ok for r in df.select("d", laws.luhn(F.col("d")).alias("ok")).collect()}
    assert found == {n: valid(n) for n in numbers} and 10 < sum(found.values()) < 60
    texts = ["4111 1111 1111 1111", "4111111111111112", "x4111-1111-1111-1111y", "41111111111111111111111", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "key: aaaaaaaaaaaaaaaaaaaaaaaaaa",
             "secret='Zx81kfQp03LmWe72VbNt'", "", None]
    kinds = laws.validated(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*(F.size(F.coalesce(v, F.array())).alias(k) for k, v in kinds.items())).collect()
    assert [r["card number"] for r in rows] == [1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0]
    assert [r["network address"] for r in rows] == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert [r["random token"] for r in rows] == [0] * 8 + [1, 0, 0]
