"""Operators against brute force on small tables, with the odd rows each has to bear."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)
from tokenizers import Tokenizer

from tidemark.llm import ann, bpe, exact, jaccard, licenses, lines, packing, quality, substring, tokens, toxicity
from tidemark.llm.common import Scratch, grams, words
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"
CLASH = ["n", "key", "ids", "component", "marks", "node", "score", "tkey", "text_sha256", "kept", "leaf"]
SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), *(StructField(c, StringType()) for c in CLASH)]
)

BASE = " ".join(f"w{i} x{i % 7}" for i in range(60))
ODD = [
    (1, BASE),
    (2, BASE),
    (2, BASE),
    (3, BASE + " tail"),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b "),
    (7, "one"),
    (8, "one two"),
    (9, "ONE two"),
    (None, BASE),
    (None, None),
    (10, "é " * 30000 + BASE),
    (11, "Een  twee\n\n drie <|endoftext|> vier　vijf"),
    (12, "one two"),
    (13, BASE.upper()),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *("clash",) * len(CLASH)) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


# --- BPE ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_vocabulary())


@pytest.fixture(scope="module")
def own():
    return tokens.Bpe(tokens.read_vocabulary())


PARTS = ["<|endoftext|>", " ", "a", "\n", "'s", "  ", "\x85", "\x1d", "9", "é", "　", ".", "_", "日", "\t"]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=20) | st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_encoding_is_the_librarys(text):
    own, library = test_encoding_is_the_librarys.pair
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.fixture(autouse=True, scope="module")
def _pair(own, library):
    test_encoding_is_the_librarys.pair = (own, library)


def test_bpe_round_trip(odd, none, library):
    found = rows(bpe.decode(bpe.encode(odd)).select("doc_id", "n_tokens", "ids", "decoded"))
    want = []
    for i, text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), text or ""))
    assert sorted(map(repr, ((a, b, bytes(c), d) for a, b, c, d in found))) == sorted(map(repr, want))
    assert rows(bpe.decode(bpe.encode(none))) == []


def test_word_table_forgets_without_effect(monkeypatch, own, library):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    for text in ("a b c d e f g", "f g h a", "b c"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


# --- packing --------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6000), min_size=1, max_size=40))
def test_plan_places_every_token_once_without_padding(lengths):
    seen = defaultdict(list)
    for sequence in packing.plan(lengths):
        size = sum(n for _, _, n in sequence)
        assert size <= 2048 and size & (size - 1) == 0
        for d, at, n in sequence:
            seen[d].append((at, n))
    for d, length in enumerate(lengths):
        end = 0
        for at, n in sorted(seen[d]):
            assert at == end and n > 0
            end += n
        assert end == length


def test_step_groups_are_even():
    sizes = [2048] * 30 + [1024] * 20 + [256] * 40
    groups = packing.step_groups(sizes, 2048)
    totals = np.bincount(groups, sizes)
    assert len(totals) > 1 and totals.max() - totals.min() <= 2048


def test_pack(odd, none, library):
    found = packing.pack(odd, window_tokens=5000).collect()
    texts = defaultdict(list)
    for i, t in ODD:
        texts[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    total = defaultdict(int)
    for r in found:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        assert any(x[r.start : r.start + r.length].tobytes() == bytes(r.ids) for x in texts[r.doc_id])
        total[r.doc_id] += r.length
    assert total == {i: sum(map(len, x)) for i, x in texts.items()}
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
    for pieces in sequences.values():
        end = 0
        for offset, n, tier in sorted(pieces):
            assert offset == end
            end += n
        assert end == tier and tier & (tier - 1) == 0
    assert rows(packing.pack(none)) == []


# --- exact ----------------------------------------------------------------------------------


def test_exact(odd, none):
    found = rows(exact.exact_duplicates(odd, capacity=1))
    groups = defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    want = []
    for i, t in ODD:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert rows(exact.exact_duplicates(none)) == []


def test_directory_splits_until_buckets_fit(spark, corpus):
    index = exact.build(corpus, Scratch(spark, "test"), capacity=4)
    buckets = index.directory.collect()
    keys = [r.key for r in index.entries.select("key").distinct().collect()]
    assert sum(b.entries for b in buckets) == index.entries.count()
    assert max(b.entries for b in buckets) <= 4 and max(b.bits for b in buckets) <= index.depth
    for b in buckets:
        low = b.first_key & (2**64 - 1)
        held = [k for k in keys if low <= k & (2**64 - 1) < low + (1 << 64 - b.bits)]
        assert len(held) == b.entries


# --- similarity join ------------------------------------------------------------------------


def similar(table, size, percent):
    sets = {}
    for i, t in table:
        sets.setdefault(i, shingles(t, size))
    parent = {i: i for i in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                a1, b1 = sorted((root(a), root(b)))
                parent[b1] = a1
    return sorted(repr((i, len(shingles(t, size)), None if i is None else root(i))) for i, t in table)


def test_jaccard_odd_rows(odd, none):
    assert sorted(map(repr, rows(jaccard.similar_documents(odd, 3, 90)))) == similar(ODD, 3, 90)
    assert rows(jaccard.similar_documents(none)) == []


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_families(spark, size, percent):
    rng = np.random.default_rng(size)
    table = []
    for family in range(4):
        base = [f"f{family}w{rng.integers(400)}" for _ in range(90)]
        for _ in range(9):
            own = list(base)
            for k in rng.integers(0, 90, rng.integers(0, 5)):
                own[k] = f"z{rng.integers(1000)}"
            table.append((len(table) * 3 % 101, " ".join(own[: 90 - rng.integers(0, 6)])))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert sorted(map(repr, rows(jaccard.similar_documents(docs, size, percent)))) == similar(table, size, percent)


def test_jaccard_links_inside_an_isolated_group(spark, monkeypatch):
    """Equal size and prefix, a prefix no other group has, and a head that links to neither member."""
    monkeypatch.setattr(jaccard, "ORDER_BITS", (1, 1))

    def group(seed, first):
        a = [f"s{seed}w{k}" for k in range(22)]
        b = [*a[:20], "y1", "y2"]
        return [(first, " ".join(a)), (first + 1, " ".join(b)), (first + 2, " ".join([*b[:21], "y3"]))]

    def alike(table):
        found = jaccard._prefixes(spark.createDataFrame(table, "doc_id long, text string"), 3, 90)
        return len({(r.n, tuple(r.prefix)) for r in found.collect()}) == 1

    groups = [g for g in (group(seed, 10 * seed) for seed in range(12)) if alike(g)]
    assert len(groups) > 1
    for table in (groups[0], sum(groups, [])):
        docs = spark.createDataFrame(table, "doc_id long, text string")
        want = similar(table, 3, 90)
        assert len({eval(r)[2] for r in want}) == 2 * len(table) // 3
        assert sorted(map(repr, rows(jaccard.similar_documents(docs, 3, 90)))) == want


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 1), (3, 7), (7, 1), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15)]
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    want = dict.fromkeys((1, 2, 3, 7), 1) | dict.fromkeys((4, 5), 4) | dict.fromkeys(range(10, 16), 10)
    assert dict(rows(found)) == want
    assert rows(components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"))) == []


@given(st.binary(max_size=200))
@settings(max_examples=100, deadline=None)
def test_words_are_those_of_split(data):
    hashes, starts, ends = words(data)
    want = data.split()
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == want
    assert len(set(hashes.tolist())) == len(set(want))
    assert len(grams(hashes, 3)) == max(0, len(want) - 2)


# --- substring ------------------------------------------------------------------------------


def cut(table, window):
    first = {}
    for i, t in sorted((i, t) for i, t in table if i is not None):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, t in table:
        w = (t or "").encode().split()
        lost = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                lost[k : k + window] = [True] * window
        kept = b" ".join(x for x, y in zip(w, lost, strict=True) if not y).decode()
        out.append(repr((i, len(w), sum(lost), kept)))
    return sorted(out)


def test_substring(spark, odd, none):
    def found(df):
        return sorted(map(repr, rows(substring.substring_duplicates(df).select("doc_id", "n_words", "n_removed", "kept"))))

    table = [(i, (t or "").replace("é", "e") or t) for i, t in ODD]
    assert found(spark.createDataFrame(table, "doc_id long, text string")) == cut(table, 13)
    assert rows(substring.substring_duplicates(none)) == []
    carried = substring.substring_duplicates(odd, extra=["n", "kept"]).select("doc_id", "rest.n", "rest.kept")
    assert {r[1:] for r in rows(carried)} == {("clash", "clash")}


def test_substring_spans_point_at_their_source(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(80)]
    table = []
    for i in range(12):
        own = [f"v{rng.integers(10**6)}" for _ in range(50)]
        a, b = sorted(rng.integers(0, 80, 2))
        at = rng.integers(0, 50)
        table.append((i, " ".join(own[:at] + passage[a:b] + own[at:])))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    found = substring.substring_duplicates(docs)
    assert sorted(map(repr, rows(found.select("doc_id", "n_words", "n_removed", "kept")))) == cut(table, 13)
    texts = {i: t.split() for i, t in table}
    spans = [(r.doc_id, s) for r in found.select("doc_id", "spans").collect() for s in r.spans]
    assert spans
    for i, s in spans:
        assert s.source_doc < i
        assert texts[i][s.start : s.start + s.words] == texts[s.source_doc][s.source_start : s.source_start + s.words]


# --- lines ----------------------------------------------------------------------------------


def simhash(text):
    hashes = [xxhash.xxh64(w, seed=42).intdigest() for w in text.split(" ")]
    return sum(1 << k for k in range(63) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_is_the_majority(spark):
    texts = ["a", "a b", "a b c d e f", " ".join(f"w{i}" for i in range(255)), " ".join(f"w{i}" for i in range(700))]
    found = rows(spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines.simhash(lines.word_hashes(F.col("t")))))
    assert dict(found) == {t: simhash(t) for t in texts}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark, none):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    table = [
        (1, f"{long}\nfirst line here\n\n***"),
        (2, f"{long.upper()}!\nFirst, line: here\n\n***"),
        (3, long.replace("wordaa", "wordab")),
        (3, long.replace("wordaa", "wordab")),
        (4, None),
        (5, ""),
        (6, "page 12 of 90\nother"),
        (7, "page 34 of 71"),
        (None, "other"),
        (8, "de de de de\n" + "de " * 300),
        (9, "de de de de de"),
        *((20 + k, " ".join([*long.split()[:k], "zz", *long.split()[k + 1 :]])) for k in range(0, 40, 3)),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in table], "doc_id long, text string, norm string")
    found = rows(lines.duplicate_lines(docs).select("doc_id", "removed_lines", "kept"))

    import re

    def normal(line):
        return re.sub(r"[^a-z]+", " ", line.lower()).strip()

    where = defaultdict(set)
    for i, t in table:
        for k, line in enumerate((t or "").split("\n")):
            if normal(line):
                where[normal(line)].add((-1 if i is None else i, k))
    names = sorted(where)
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sims = {n: simhash(n) for n in names}
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if (sims[a] ^ sims[b]).bit_count() <= 3 and distance(a, b) <= 0.2 * max(len(a), len(b)):
                parent[root(a)] = root(b)
    groups = defaultdict(set)
    for n in names:
        groups[root(n)] |= where[n]
    gone = {x for g in groups.values() for x in g - {min(g)}}
    want = []
    for i, t in table:
        own = (t or "").split("\n")
        lost = [k for k in range(len(own)) if (-1 if i is None else i, k) in gone]
        want.append((i, lost, "\n".join(x for k, x in enumerate(own) if k not in lost)))
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert sum(len(w[1]) for w in want) > 8
    assert rows(lines.duplicate_lines(none)) == []


def test_every_block_plan_finds_all_pairs():
    for count in (1, 10**4, 10**7, 10**10, 10**13):
        parts, kept = lines.block_plan(count)
        assert parts - kept == lines.RADIUS


# --- licences -------------------------------------------------------------------------------


def test_licenses(spark, odd, none):
    text = {k: v for k, v in licenses.SENTENCES.items()}
    table = [
        (1, "Prose first. " + text["apache-notice"] + " More prose."),
        (2, "\n".join([text["bsd-grant"], text["bsd-source"], "An own remark.", text["bsd-binary"], text["bsd-name"]])),
        (3, "\n".join([text["bsd-source"], text["bsd-grant"]])),
        (4, (text["mit-grant"] + "\n" + text["mit-notice-kept"] + "\n" + text["mit-as-is"]).upper()),
        (5, text["cc-by-nc-notice"] + "\n" + text["gpl3-notice"]),
        (6, "  released under the   MIT license!!  "),
        (7, None),
        (8, text["cc-by-nc-notice"].replace("NC", "ND")),
    ]
    found = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert found == {
        1: ["Apache-2.0"], 2: ["BSD-3-Clause"], 3: [], 4: ["MIT"], 5: ["CC-BY-NC-4.0", "GPL-3.0-only"], 6: ["MIT"], 7: [], 8: [],
    }
    assert licenses.scan(odd).count() == len(ODD) and rows(licenses.scan(none)) == []


def test_licenses_wrapped_and_commented(spark):
    import textwrap

    text = licenses.SENTENCES | licenses.MORE_SENTENCES

    def header(mark, *keys, gap="\n"):
        return "\n".join(f"{mark}{x}" for x in gap.join("\n".join(textwrap.wrap(text[k], 72)) for k in keys).split("\n"))

    bsd = ["bsd-grant", "bsd-source", "bsd-binary"]
    table = [
        (1, header("", "mit-grant", "mit-notice-kept", "mit-as-is", gap="\n\n"), "MIT"),
        (2, "/*\n" + header(" * ", *bsd, "bsd-name") + "\n */\nint x;", "BSD-3-Clause"),
        (3, header("# ", *bsd, gap="\n\n").replace("\n", "\r\n"), "BSD-2-Clause"),
        (4, "A title\nCopyright 2020 Somebody\n" + header("// ", "apache-grant"), "Apache-2.0"),
        (5, header("", "gpl-share", "gpl-hope"), "GPL-3.0-or-later"),
        (6, header("# ", "gpl2-share"), "GPL-2.0-or-later"),
        (7, header("# ", "lgpl21-share"), "LGPL-2.1-or-later"),
        (8, header("; ", "agpl3-share"), "AGPL-3.0-or-later"),
        (9, "# SPDX-License-Identifier: (MIT OR CC-BY-ND-4.0)\nx = 1", "CC-BY-ND-4.0,MIT"),
        (10, "Released under\nthe MIT License\nand more prose", "MIT"),
        (11, "Released under\n\nthe MIT License.", ""),
        (12, "Not released under the MIT License.\nOr", ""),
        (13, header("", "zlib-as-is", "zlib-grant"), "Zlib"),
        (14, header("", "lgpl3-share", "unlicense-grant"), "LGPL-3.0-or-later,Unlicense"),
        (15, "\n * " * 50000 + "Released under the\n * MIT License.", "MIT"),
    ]
    docs = spark.createDataFrame([t[:2] for t in table], "doc_id long, text string")
    assert {r.doc_id: ",".join(r.licenses) for r in licenses.scan(docs).collect()} == {i: want for i, _, want in table}


# --- classifiers ----------------------------------------------------------------------------


def test_quality(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    rules = quality.fit(docs, labels.where(fold != 0), "quality", Scratch(spark, "test"))
    assert rules.weighted
    held = quality.score(docs, rules).join(labels.where(fold == 0), "doc_id").select("score", "quality").collect()
    right = sum((r.score >= quality.ACCEPT) == bool(r.quality) for r in held)
    assert len(held) > 30 and right / len(held) > 0.9
    scored = quality.score(odd, rules).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(none, rules).count() == 0
    one = labels.where("quality = 1")
    assert not quality.fit(docs, one, "quality", Scratch(spark, "test")).weighted
    assert quality.fit(none, none.withColumn("quality", F.lit(1)), "quality", Scratch(spark, "test")).intercept == 0


def test_paths_of_printed_trees():
    debug = "Tree 0 (weight 1.0):\n  If (feature 0 <= 0.5)\n   If (feature 1 > 2.0)\n    Predict: 1.0\n   Else (feature 1 <= 2.0)\n    Predict: 0.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0"
    assert set(quality.paths(debug, ["a", "b"])) == {
        (("a", False, 0.5),),
        (("a", True, 0.5),),
        (("a", False, 0.5), ("b", True, 2.0)),
        (("a", False, 0.5), ("b", False, 2.0)),
    }


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(5)
    table, marks = [], []
    for i in range(300):
        sentences = [" ".join(f"w{rng.integers(300)}" for _ in range(8)) for _ in range(rng.integers(1, 9))]
        bad = i % 4 == 0
        if bad:
            sentences[rng.integers(len(sentences))] += " GRUMPF"
        table.append((i, ". ".join(sentences) + "."))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame(marks[:200], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", Scratch(spark, "test"))
    for r in toxicity.score(docs, model).collect():
        assert (r.score >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0)
        text = dict(table)[r.doc_id].encode()
        assert all(b"GRUMPF" in text[s.start : s.start + s.length] for s in r.offending)
        assert bool(r.offending) == (r.doc_id % 4 == 0)
    found = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert found[5] == 0 and all(0 <= x <= 1 for x in found.values())
    assert toxicity.score(none, model).count() == 0
    calm = toxicity.fit(docs, labels.where("toxic = 0"), "toxic", Scratch(spark, "test"))
    assert all(r.score < 0.1 for r in toxicity.score(docs, calm).collect())
    toxicity.fit(none, none.withColumn("toxic", F.lit(1)), "toxic", Scratch(spark, "test"))


# --- neighbours -----------------------------------------------------------------------------

VECTORS = StructType(
    [StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("leaf", IntegerType()), StructField("ids", DoubleType())]
)


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8)).astype("float32")
    x[100:160] = x[3]
    table = [(i, [float(v) for v in row], 0, 0.0) for i, row in enumerate(x)]
    odd = [(1000, None, 0, 0.0), (1050, [0.0] * 8, 0, 0.0), (1100, [float("nan")] * 8, 0, 0.0), (None, table[0][1], 0, 0.0),
           (1150, [None] * 8, 0, 0.0), (1200, [float("inf")] * 8, 0, 0.0), table[7]]
    df = spark.createDataFrame(table + odd, VECTORS)
    found = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(range(0, 400, 50))
    unit = x.astype(float)
    norm = np.linalg.norm(unit, axis=1)
    hits = 0
    for q, got in found.items():
        score = unit @ unit[q] / (norm * norm[q])
        score[q] = -9
        best = np.lexsort((np.arange(400), -score.round(12)))[:5]
        hits += len({int(b) for b in best} & {v for v, _ in got})
        assert len(got) == 5 and all(abs(s - score[v]) < 1e-12 for v, s in got)
    assert hits / 40 >= 0.9
    few = ann.search(df.where("vec_id in (0, 1, 50)"), F.col("vec_id") % 50 == 0)
    assert sorted((r.query_id, r.vec_id) for r in few.collect()) == [(0, 1), (0, 50), (50, 0), (50, 1)]
    assert rows(ann.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0)) == []


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    scratch = Scratch(spark, "test")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = docs.collect()
        docs = scratch.settle(stage(spark, docs, SF))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            junk = {r.doc_id for r in labels.where("quality = 0").collect()}
            fine = {r.doc_id for r in labels.where("quality = 1").collect()}
            left = {r.doc_id for r in after}
            assert len(fine - left) <= 2 and len(junk & left) <= 2
        if k == 1:
            last = {}
            for r in before:
                last[r.text] = max(r.doc_id, last.get(r.text, -1))
            assert {r.doc_id for r in after} == set(last.values())
        if k == 2:
            want = similar([(r.doc_id, r.text) for r in before], 5, 80)
            assert sorted(r.doc_id for r in after) == sorted(r[0] for r in map(eval, want) if r[0] == r[2])
        if k == 3:
            want = cut([(r.doc_id, r.text) for r in before], 13)
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            texts = {r.doc_id: r.text for r in before}
            for i, _, gone, kept in map(eval, want):
                own = next(r for r in after if r.doc_id == i)
                assert own.text == (kept if gone else texts[i]) and own.n_chars == len(own.text)
        if k == 4:
            assert sum(r.length for r in after) == sum(dict((r.doc_id, r.doc_tokens) for r in after).values())
    assert [name for name, _ in pipeline.STAGES][0].startswith("quality")
