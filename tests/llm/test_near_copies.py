"""Near copies of the pipeline against all pairs."""

import itertools
import random
import re

import pytest
from test_methods import LOWER, plain_fingerprint

import corpus_pipeline
from weftline.llm import near_copies as N


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_first(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both, any_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * both >= 4 * any_:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def texts(r):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(3, 400))]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(out)] + [(1000, ""), (1001, None), (1002, "One two"), (1003, "one  two")]


@pytest.mark.parametrize("bounds", [{}, {"tile": 500}, {"shard_rows": 4}])
def test_classes_are_those_of_all_pairs(spark, bounds):
    docs = texts(random.Random(4))
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **bounds).collect()
    assert {tuple(r) for r in got} == set(plain_first(docs).items()) and len(got) == len(docs)


def test_classes_of_the_documents(spark, data):
    """Recall and precision against all pairs, on the table itself."""
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in rows.collect()]
    got = N.near_duplicates(rows).collect()
    assert {tuple(r) for r in got} == set(plain_first(docs).items()) and len(got) == len(docs)


def test_stage_unites_what_three_bits_do_not(spark, data):
    docs = texts(random.Random(4))
    want = plain_first(docs)
    bits = {i: plain_fingerprint(t) for i, t in docs}
    assert any(bin(bits[i] ^ bits[c]).count("1") > 3 for i, c in want.items())
    kept = corpus_pipeline.near(spark, spark.createDataFrame(docs, "doc_id long, text string"), data)
    assert {r.doc_id for r in kept.collect()} == set(want.values())
