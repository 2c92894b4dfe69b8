"""Heads in the form this package renders, read line by line as YAML reads them; fences by position."""

import random
import re
import time

import yaml
from pyspark.sql import functions as F

from tidemark.functions.frontmatter import rendered_head, split_front_matter

HEAD = """
type: "Document"
title: "Ünï: # 'x' [a]"
description: ""
generated:
  by: "tidemark/test"
  at: "2024-01-01T00:00:00Z"
"lang": "de"
"n_chars": 120
sources:
- id: "src1:docs/1.md"
  resource: "https://kb.example.org/r/1"
  content_hash: "ab"
- id: "src2:docs/2.md"
  resource: "r"
  content_hash: "0"
links:
- "concepts/a/overview.md"
- "concepts/b/overview.md\""""


def _yaml(head):
    try:
        return yaml.load(head, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError):
        return "refused"


def test_a_rendered_head_is_what_yaml_reads():
    assert rendered_head(HEAD) == _yaml(HEAD)
    assert rendered_head(HEAD.replace("ab", "a\\u00e9b")) is None


def test_changed_heads_are_read_alike_or_left_to_yaml():
    rng = random.Random(5)
    lines = HEAD.strip("\n").split("\n")
    odd = ["sources: []", "links:", "  at: 2024-01-01", "- 7", "  7", "on: 1", '"on": 1', "title: 007", 'title: "a" # b', "title: [1]",
           '"<<": 3', "", " by: 1", "- - 1", "---", "type:", "- by: 2", 'title: "a\tb"', 'title: "\u2028"', "title: 2024-01-01", "  by: []",
           'title: "\U0001f600"', "type", "- id:", "generated: 5", "%x", '"": 1', 'title: "\x85"']
    read = 0
    for _ in range(6000):
        some = list(lines)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(some))
            match rng.randrange(3):
                case 0:
                    some.insert(at, rng.choice(odd + lines))
                case 1:
                    some.pop(at)
                case _:
                    some[at] = rng.choice(odd + lines)
        head = "\n" + "\n".join(some)
        found = rendered_head(head)
        if found is not None:
            read += 1
            assert found == _yaml(head), head
    assert read > 500


def test_rendered_heads_take_a_fraction_of_yaml():
    started = time.process_time()
    for _ in range(300):
        _yaml(HEAD)
    slow = time.process_time() - started
    started = time.process_time()
    for _ in range(300):
        rendered_head(HEAD)
    assert (time.process_time() - started) * 4 < slow


def test_fences_by_position_are_those_of_the_pattern(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["---", "\n", "\n---", "a", "é", "-", " ", "\r\n"], k=rng.randint(0, 9))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: (r.s.head, r.s.body) for r in df.select("t", split_front_matter(F.col("t")).alias("s")).collect()}

    def plain(t):
        found = re.search(r"(?s)^---(.*?)\n---(.*)\Z", t)
        return (found[1], found[2].lstrip("\n")) if found else (None, t)

    assert got == {t: plain(t) for t in texts} | {None: (None, None)}
    assert sum(h is not None for h, _ in got.values()) > 40
