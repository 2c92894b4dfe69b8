"""Scenario kit: document rows, a source that returns them, a publisher that keeps them."""

from __future__ import annotations

import datetime as dt

from tidemark.operators.changes import canonical_documents
from tidemark.operators.prose import Generator
from tidemark.plans.run import Fetch, run

ROW = (
    "system string, native_id string, url string, retrieved_at timestamp, title string, text string, "
    "structured string, relations array<string>, grounded_by array<string>, deleted boolean"
)
THEN = dt.datetime(2024, 1, 1)


def doc(native_id, system="sys", text="body", title="T", relations=(), grounded_by=(), deleted=False,
        url=None, structured="{}", at=THEN):
    return (system, native_id, url, at, title, text, structured, list(relations), list(grounded_by), deleted)


class Rows:
    """A source that returns fixed rows."""

    def __init__(self, *docs, complete=True, name="rows", payload=None):
        self.docs, self.complete, self.name = list(docs), complete, name
        self.payload = payload or {}
        self.seen_cursor = None

    def problems(self, config):
        return []

    def fetch(self, spark, config, cursor):
        self.seen_cursor = cursor
        return Fetch(spark.createDataFrame(self.docs, ROW), self.payload, self.complete)

    def normalize(self, records):
        return canonical_documents(records)


class Keep:
    """A publisher that collects the last proposal."""

    def __init__(self, fail=False):
        self.last = None
        self.fail = fail

    def problems(self, config):
        return []

    def publish(self, proposal, config):
        if self.fail:
            raise RuntimeError("the review system is down")
        self.last = {
            "branch": proposal.branch,
            "files": {r.path: r.content for r in proposal.files.collect()},
            "removed": sorted(r.path for r in proposal.removed.collect()),
            "concepts": {r.path: r for r in proposal.concepts.collect()},
            "summary": sorted((r.section, r.item) for r in proposal.summary.collect()),
            "sources": [r.doc_id for r in proposal.sources_changed.collect()],
        }
        return "kept://1"

    @property
    def notes(self):
        return [i for s, i in self.last["summary"] if s == "Notes"]


def _write(batch):
    return batch.assign(title=batch["doc_id"], description="d", body="b")


def _write_but_a(batch):
    return _write(batch[batch["doc_id"] != "sys:a"])


GROUNDING = Generator(write=_write, model="vendor/small")
DROPS_A = Generator(write=_write_but_a, model="vendor/small")


def go(spark, root, source, publisher=None, grounding=None, **kw):
    publisher = publisher or Keep()
    subject_map = None
    if grounding is not None:
        pairs = [(k, v) for k, vs in grounding.items() for v in vs]
        subject_map = spark.createDataFrame(pairs, "owner_id string, grounding_id string")
    config = kw.pop("config", {})
    kw.setdefault("check_stability", False)
    outcome = run(spark, source, publisher, config=config, state_root=str(root), subject_map=subject_map, **kw)
    return outcome, publisher


def path(native):
    return f"concepts/{native.removesuffix('.md')}/overview.md"
