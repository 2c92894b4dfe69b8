"""A batch of YAML heads is parsed head by head, so that its objects are never all in memory."""

import tracemalloc

import pandas as pd

from tidemark.functions.frontmatter import parse_head


def test_objects_of_a_batch_are_not_held():
    lines = "".join(f"- id: s{j}\n  resource: r{j}\n" for j in range(20))
    heads = pd.Series([f"title: t{i}\nsince: 2024-05-01\nsources:\n{lines}" for i in range(400)] + [None, "a: b: c"])
    parse_head.func(heads[:2])
    tracemalloc.start()
    out = parse_head.func(heads)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(out["opaque"][:2]) == [["since"], ["since"]] and list(out["front"][-2:]) == ["{}", "{}"]
    # the answer itself is its text and little more
    assert peak < 3 * sum(map(len, out["front"]))
