"""Fitted operators against plain loops, and tables that fits must bear."""

import hashlib
import math

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import ann, quality, tokens, toxicity
from tidemark.llm.common import Scratch, mix, words
from tidemark.llm.queries import QUERIES, held_out

SF = "/root/testdata/sf0.001"


def _statistics(text):
    t = text or ""
    n = max(len(t), 1)
    split = regex.split(r"[ \n]+", t.strip(" "))
    lines = t.split("\n")
    w = max(len(split), 1)

    def share(pattern):
        return len(regex.sub(pattern, "", t)) / n

    return {
        "log_chars": math.log(n),
        "word_length": len(t) / w,
        "distinct_words": len(set(split)) / w,
        "distinct_scaled": len(set(split)) / w**0.7,
        "symbols": share(r"[\p{L}\p{N}\s.,;:'\"?()-]+"),
        "upper": share(r"[^\p{Lu}]+"),
        "digits": share(r"[^0-9]+"),
        "stops": share(r"[^.,]+"),
        "distinct_lines": len(set(lines)) / len(lines),
        "words_per_line": w / len(lines),
        "repeats": sum(a.lower() == b.lower() for a, b in zip(split, split[1:])) / w,
    }


def test_compiled_rules_are_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "A\n\nA a"), (-4, "x " * 500)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    rules = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality", Scratch(spark, "t"))
    assert rules.weighted
    scores = {r.doc_id: r.score for r in quality.score(every, rules).collect()}
    for doc_id, text in every.collect():
        own = _statistics(text)
        z = rules.intercept
        for weight, rule in rules.weighted:
            z += weight * all((own[name] > at) == above for name, above, at in rule)
        assert scores[doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def _sentences(text):
    """Sentences with a word, by byte offsets, and the features of each."""
    data, out, begin = (text or "").encode().lower() + b"\n", [], 0
    for end, c in enumerate(data):
        if c in b".!?\n":
            part = bytes(x if x >= 0x80 or chr(x).isalnum() else 0x20 for x in data[begin:end])
            features = []
            for word in part.split():
                features.append(int(words(word)[0][0]))
                head = np.zeros(1, np.uint64)
                for k, byte in enumerate(word[: max(toxicity.HEADS)]):
                    head = mix(head ^ np.uint64(byte))
                    if k + 1 in toxicity.HEADS:
                        features.append((int(head[0]) + k) % (1 << 64))
            cells = [int(mix(np.array([f], np.uint64))[0]) >> 64 - toxicity.BITS for f in features]
            if cells:
                out.append((begin, end - begin, cells))
            begin = end + 1
    return out


def test_noisy_or_and_offsets(spark):
    rng = np.random.default_rng(6)
    parts = ["ab", "abcdefgh", "É", ".", "!", "\n", " ", "?x", "9z", "--", "ünder"]
    table = [(k, "".join(rng.choice(parts, rng.integers(0, 30)))) for k in range(60)] + [(90, None), (91, ""), (None, "ab. ab")]
    model = toxicity.Model(-1.0, rng.normal(size=1 << toxicity.BITS).astype(np.float32))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for doc_id, text in table:
        clean, offending = 1.0, []
        for begin, length, cells in _sentences(text):
            p = 1 / (1 + math.exp(-(-1.0 + sum(float(model.weights[c]) for c in cells))))
            clean *= 1 - p
            if p >= 0.5:
                offending.append((begin, length, pytest.approx(p, abs=1e-5)))
        assert found[doc_id].score == pytest.approx(1 - clean, abs=1e-5)
        assert [(s.start, s.length, s.score) for s in found[doc_id].offending] == offending


@pytest.mark.parametrize("known", [False, True])
def test_labels_of_both_kinds_without_their_documents(spark, known):
    """No documents, or none that is labelled: a model all the same, for both fits."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1)], "doc_id long, toxic int, quality int")
    rows = [(70, "some words here."), (None, "ab")] if known else []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        model = module.fit(docs, labels, label, Scratch(spark, "t"))
        scores = [r.score for r in module.score(docs, model).collect()]
        assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(k, [float(k % 7 + 1), 1.0, float(k)]) for k in range(30)] + [(50, [1.0, 2.0]), (100, [1.0]), (7000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 5 == 0).collect()}
    assert {q for q, _ in found} == {0, 5, 10, 15, 20, 25} and all(v < 30 for _, v in found)


def test_null_ids_are_held_out(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long")
    for modulus, rest in ((5, 0), (3, 1)):
        flags = [r[0] for r in df.select(held_out(modulus, rest)).collect()]
        assert flags[0] is True and None not in flags


def test_query_digests_are_the_librarys(spark):
    library = Tokenizer.from_file(tokens.default_vocabulary())
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    found = QUERIES["op1_bpe_round_trip"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
