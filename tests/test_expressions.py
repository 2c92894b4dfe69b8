"""Scalar rules against plain Python on small inputs."""

import base64
import random
import unicodedata

import pytest
import yaml
from pyspark.sql import functions as F

from tidemark.functions import facets, frontmatter, identity, instants, text
from tidemark.sources import responses


def column(spark, values, expr, ddl="i int, v string"):
    df = spark.createDataFrame(list(enumerate(values)), ddl)
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_blank_is_judged_on_visible_content(spark):
    samples = ["", " \t", "​", " ⁠", " ", "࢐\U00013439", "a", "​x", None, "́"]
    want = [
        v is None or not "".join(c for c in v if unicodedata.category(c) not in ("Cf", "Zs", "Cc")).strip()
        for v in samples
    ]
    assert column(spark, samples, text.is_blank) == want


def test_blank_over_every_format_and_space_character(spark):
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF
           and unicodedata.category(chr(c)) in ("Cf", "Cc", "Zs", "Zl", "Zp")]
    assert all(column(spark, odd, text.is_blank))


def test_strip_removes_what_unicode_calls_whitespace(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert column(spark, [s + "x" + s for s in spaces], text.strip) == ["x"] * len(spaces)


def test_canonical_text_forgets_encoding(spark):
    forms = ["a\nb", "﻿a\r\nb", " a\rb\n\n", "a\nb "]
    assert column(spark, forms, text.canonical_text) == ["a\nb"] * 4


def test_aware_instants(spark):
    stamps = ["2024-05-01T10:00:00Z", " 2024-05-01T10:00:00+00:00 ", "2024-05-01T12:00+0200",
              "2024-05-01T10:00:00", "2024-05-01", "soon", None, "2024-13-01T00:00:00Z"]
    got = column(spark, stamps, lambda c: F.unix_timestamp(instants.aware_instant(c)))
    assert got[0] is not None and got[:3] == [got[0]] * 3 and got[3:] == [None] * 5


def told_apart():
    """Ids that differ in one thing each, made by rule: none may share a path with another."""
    hosts = ["north.example", "south.example", "north.example:90", "me@north.example", "ME@north.example"]
    tails = ["", "/wing/room", "/wing/room?k=1", "/wing/room?k=2", "/wing/room?k=/1", "/wing/room#k", "?k=1", "#k"]
    seps = ["/", ":", "-", "%3A", "|", "\\", "\t", " "]
    ends = ["", ".pdf", ".md.md", ".", "%2E", "-1.0", "-1.1"]
    urls = [f"https://{h}{t}" for h in hosts for t in tails]
    return urls + [f"wing{s}room" for s in seps] + [f"hall{e}" for e in ends] + ["hall room", "hall%20room"]


DISTINCT = told_apart()


def final_paths(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "raw_id string")
    did = identity.doc_id(F.lit("s"), F.col("native_id"))
    rows = identity.with_identity(df).select(
        "raw_id", "reject_reason", identity.joined_path("kb", identity.concept_path(did)).alias("path")
    )
    return {r.raw_id: (r.reject_reason, r.path) for r in rows.collect()}


def test_distinct_ids_never_share_a_published_path(spark):
    rng = random.Random(7)
    pool = ["a", "B", ".", "/", ":", "%", "?", "#", "@", "\\", " ", "~", "2E", ".md", "é", "\x01"]
    noise = {"".join(rng.choices(pool, k=rng.randint(2, 7))).strip() for _ in range(400)}

    def same_document(i):
        """The deliberate equivalences of a plain id, stated directly."""
        segments = [s for s in i.split("/") if s not in ("", ".")]
        stem, dot, ext = segments[-1].rpartition(".") if segments else ("", "", "")
        if dot and ext.lower() == "md":
            segments[-1] = stem
        return "/".join(segments)

    plain = {}
    for i in sorted(noise):
        if i:
            plain.setdefault(same_document(i), i)
    ids = list(dict.fromkeys([*DISTINCT, *(v for k, v in plain.items() if k not in {same_document(d) for d in DISTINCT})]))
    kept = [p for reason, p in final_paths(spark, ids).values() if reason is None]
    assert len(kept) == len(set(kept)) and len(kept) > 250
    assert not any(".." in p.split("/") for p in kept)


def test_equivalent_ids_meet_and_bad_ones_are_refused(spark):
    same = ["http://A.com/docs/x.md", "https://a.com/docs/x", "https://a.com//docs/./x.HTML ", "https://A.COM/docs/x.txt"]
    assert len({p for _, p in final_paths(spark, same).values()}) == 1
    bad = {"../x": "escapes", "a/%2e%2E/b": "escapes", "https://a.com/../x": "escapes", "": "empty", " \n": "empty",
           "docs/.md": "extension", "/": "path content"}
    got = final_paths(spark, list(bad))
    assert all(why in got[i][0] for i, why in bad.items())


NASTY = ["plain", 'q"uo\\te', "colon: #hash", "\x07\x7f\x85  ﻿", "- list", "é\U0001f600", "a\nb\tc", "null", "---"]


def test_rendered_front_matter_survives_yaml(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(NASTY)], "i int, v string")
    v = F.col("v")
    source = F.array(F.struct(v.alias("id"), v.alias("resource"), v.alias("content_hash")))
    head = frontmatter.head(
        type_=v, title=v, description=v, generated_by=v,
        generated_at=F.timestamp_seconds(F.lit(1704067200)),
        facets=F.create_map(v, facets.json_string(v)), sources=source, links=F.array(v),
    )
    rows = df.withColumn("h", head).select(
        "i", frontmatter.rendered(F.col("h"), F.lit("t"), F.lit("body")).alias("out")
    )
    for row in rows.collect():
        front, want = yaml.safe_load(row.out.split("---\n\n# ")[0][4:]), NASTY[row.i]
        assert front["title"] == want and front[want] == want and front["links"] == [want]
        assert front["sources"] == [{"id": want, "resource": want, "content_hash": want}]
        assert front["generated"]["at"].startswith("2024-01-01T00:00:00")


def test_facets_keep_zero_and_drop_the_empty(spark):
    raw = '{"zero":0,"no":false,"none":null,"e":"","l":[],"o":{},"deep":{"a":1},"tags":["a",1],"hole":["a",null],"type":"x"}'
    got = column(spark, [raw], lambda c: facets.facets(c))[0]
    assert got == {"zero": "0", "no": "false", "tags": '["a",1]'}
    types = column(spark, [raw, '{"type":0}', '{"type":true}', "{}", None], facets.concept_type)
    assert types == ["x", "concept", "True", "concept", "concept"]


@pytest.mark.parametrize(
    ("blob", "ok"),
    [(base64.b64encode(b"hello").decode(), True), ("aGVs\nbG8=", True), ("aGVsbG8", False), ("aGVs*G8=", False)],
)
def test_base64_is_strict_but_for_whitespace(spark, blob, ok):
    block = {"type": "resource", "text": None, "uri": None, "name": None, "title": None,
             "resource": {"uri": "u", "text": None, "blob": blob, "mime_type": None}}
    reads = spark.createDataFrame([("a", False, None, [block])], responses.LANDED)
    refs = responses.enumerated(spark.createDataFrame([("a",)], "raw_id string"))
    row = responses.read_records(refs, reads).first()
    assert (row.body == "hello") == ok and (row.reject_reason is None) == ok
