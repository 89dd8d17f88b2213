"""Each method against a brute-force version, an exact round trip, or held-out accuracy."""

import base64
import hashlib
import itertools
import math
import random
import re
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import decontaminate as W
from weftline.llm import language_id as L
from weftline.llm import line_dedup
from weftline.llm import quality_model as M
from weftline.llm import queries as Q
from weftline.llm import simhash as S
from weftline.llm import substring_dedup as B
from weftline.llm.bpe_codec import Codec
from weftline.llm.token_counts import Counter

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = Codec(open(RANKS, "rb").read(), P.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(r) for a, r in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
COUNT = Counter(open(P.path("byte_bpe_50k.json"), "rb").read(), memo=50)
TOK = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
PIECES = ["the", " and", "tion", "é", "ß", "  ", "\n", "\x1c", "\x85", "123", "!!", "<|endoftext|>", "'s", "中文", "zz", "\u00a0", "a" * 40, "thein" * 30]
TEXTS = st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=20).map("".join))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_codec_is_the_library(text):
    ids = CODEC.encode(text)
    assert ids == TIK.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_are_the_library(text):
    assert COUNT.count(text) == len(TOK.encode(text, add_special_tokens=False).ids)


def test_tree_joins_long_pieces():
    r = random.Random(0)
    for n in (2, 9, 100, 1000, 5000):
        for letters in ("theinaros", "a", "ab", "é中a"):
            s = "".join(r.choice(letters) for _ in range(n))
            assert CODEC.encode(s) == TIK.encode_ordinary(s)


def test_every_piece_is_joined(data):
    """Pre-tokens that are no whole rank go through the tree, as the query sets it."""
    codec, joins = Codec(open(RANKS, "rb").read(), P.PATTERN), []
    plain = codec.join
    codec.join = lambda a, b: joins.append(len(a) + len(b)) or plain(a, b)
    for t in pd.read_parquet(f"{data}/documents.parquet")["text"]:
        assert codec.encode(t) == TIK.encode_ordinary(t or "")
    inner = sum(p.encode() not in codec.ranks for p in codec.memo)
    assert inner > 1000 and len(joins) >= inner


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def contamination(text, items):
    find = lambda t: WORDS.findall((t or "").translate(LOWER))
    w, hit, who = find(text), set(), set()
    for name, item in items:
        p = find(item)
        m = min(13, len(p))
        for s in range(len(p) - m + 1) if m else ():
            for k in range(len(w) - m + 1):
                if w[k : k + m] == p[s : s + m]:
                    hit |= set(range(k, k + m))
                    who.add(name)
    return len(w), len(hit), sorted(who)


@pytest.mark.parametrize("seed", range(60))
def test_wu_manber(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "é", "C", "d1", "Ü"][: r.randint(1, 6)]
    make = lambda n: "".join(r.choice(vocab) + r.choice([" ", "-", "\n", " . "]) for _ in range(n))
    docs = [make(r.randint(0, 80)) for _ in range(5)] + [None, ""]
    items = [(str(i), r.choice([make(r.randint(0, 20)), docs[0][:60]])) for i in range(6)] + [("9", None)]
    mm = W.build(items)
    for t in docs:
        n, spans, who = W.scan(t, mm)
        assert (n, sum(spans[1::2]) - sum(spans[::2]), who) == contamination(t, items)


def test_long_items_are_cut_without_loss():
    r = random.Random(6)
    text = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(900))
    parts = W.pieces(text, 600, 13)
    windows = lambda t: {tuple(t.split()[i : i + 13]) for i in range(len(t.split()) - 12)}
    assert len(parts) > 3 and set().union(*map(windows, parts)) == windows(text) and all(len(p.split()) >= 13 for p in parts)
    assert W.pieces(None, 10, 13) == [None] and W.pieces("a b", 100, 13) == ["a b"]


def test_equal_patterns_are_one():
    same = " ".join(f"w{i}" for i in range(20))
    (m,) = W.build([(str(i), same) for i in range(50)])
    assert len(m.starts) == 8 and len(m.owner) == 400
    assert W.scan("x " + same, [m])[1:] == ([1, 21], sorted(map(str, range(50))))


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints():
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice(["A", "b é", "\x1c", "\xa0", " ", "\n", "\x85", "foo "]) for _ in range(r.randint(0, 30)))
        assert S.fingerprint(t) == signed(plain_fingerprint(t))


def plain_classes(values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def clustered(seed=0, centres=4, members=400, others=100):
    rng = np.random.default_rng(seed)
    mid = rng.integers(0, 1 << 63, centres, dtype=np.uint64)
    flips = lambda: sum(1 << b for b in set(rng.integers(0, 63, rng.integers(0, 8)).tolist()))
    near = {signed(int(mid[rng.integers(centres)]) ^ flips()) for _ in range(members)} | {signed(int(x)) for x in rng.integers(0, 1 << 63, others, dtype=np.uint64)}
    return sorted(near | {0, 1, -1})


# one tree for all; trees of many shards; longer keys; and rings and tiles where all levels are too full
@pytest.mark.parametrize("bounds", [{}, {"tree_rows": 40}, {"shard_rows": 60}, {"shard_rows": 60, "levels": 2}, {"shard_rows": 20, "levels": 1}, {"tree_rows": 1, "levels": 3}])
def test_vantage_point_classes(spark, bounds):
    near = clustered()
    df = spark.createDataFrame(pd.DataFrame({"fp": near}))
    got = {r.node: r.root for r in S.components(S.links(df, leaf=4, **bounds)).collect()}
    assert {v: got.get(v, v) for v in near} == plain_classes(near)


def test_long_keys_are_reached(spark):
    """More rows than one block's bits can tell apart start on a later level; every level is exact."""
    near = clustered(3, centres=40, members=300)
    df = spark.createDataFrame(pd.DataFrame({"fp": near}))
    for level in (1, 2, 3, 4):
        at = S.shards(df, level, 64, 3).toPandas()
        ok = {tuple(sorted((a, b))) for _, g in at.groupby(["choice", "key"]) for a, b in itertools.combinations(g["fp"], 2)}
        want = {(a, b) for a, b in itertools.combinations(near, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
        assert want and want <= ok


@pytest.mark.parametrize("radius", [3, 10, 21])
def test_trees_split_and_prune(radius):
    values = np.array(clustered(1, 3, 300, 900), np.int64).view(np.uint64)
    seen = {}
    member, root = S.local_stars(values, None, radius, 4, seen)
    found = dict(zip(member.tolist(), root.tolist()))
    want = {v: v for v in sorted(values.tolist())}
    for a, b in itertools.combinations(sorted(want), 2):
        if bin(a ^ b).count("1") <= radius:
            x, y = a, b
            while want[x] != x:
                x = want[x]
            while want[y] != y:
                y = want[y]
            want[max(x, y)] = min(x, y)

    def top(v):
        while want[v] != v:
            v = want[v]
        return v

    assert {v: found.get(v, v) for v in want} == {v: top(v) for v in want}
    if radius == 3:  # most of the pairs are never compared
        assert seen["splits"] > 10 and seen["compared"] < len(values) ** 2 / 4
    else:
        assert seen.get("balls", 0) + seen.get("splits", 0) + seen.get("flat", 0) > 0
    half = len(values) // 2
    side = np.arange(len(values)) % 2
    assert half and set(S.local_stars(values, side, radius, 4)[0].tolist()) <= set(member.tolist())


def test_winnowing_selects_fewer_lines(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = docs.select("doc_id", F.explode(line_dedup.fingerprints(F.col("text"), line_dedup.MIN_WORDS)).alias("f")).select("doc_id", "f.*")
    lines = sum(1 for r in docs.select("text").collect() for x in (r.text or "").split("\n") if x.strip())
    n, windows = found.agg(F.count("*"), F.sum(F.size("wins"))).first()
    assert 0 < n < lines and n < windows


def test_hot_lines_and_repeats_within(spark):
    r = random.Random(8)
    line = lambda n: " ".join(r.choice("abcdefg") * 3 + str(r.randint(0, 9)) for _ in range(n))
    hot, block = line(12), [line(r.randint(1, 30)) for _ in range(9)]
    docs = []
    for i in range(60):
        own = [line(r.randint(0, 40)) for _ in range(r.randint(0, 6))]
        at, n = r.randint(0, 6), r.randint(1, 9)
        docs.append((i, "\n".join([hot, *own, *block[at : at + n], hot, "", *block[at : at + n], hot, *[hot] * r.randint(0, 9)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.kept for x in line_dedup.dedup_lines(df).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    sql = {a: (n, h) for a, _, n, h in con.execute(line_dedup.oracle()).fetchall()}
    assert sum(n for n, _ in sql.values()) > 100
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()} == {i: h for i, (_, h) in sql.items()}


def plain_removal(docs, size=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if b[s : s + size] in seen:
                gone[s : s + size] = b"\1" * size
            seen.add(b[s : s + size])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("task_rows", [40_000, 30])
def test_repeated_strings(spark, task_rows):
    r = random.Random(5)
    pool = ["".join(r.choice("abcdé ") for _ in range(r.randint(50, 300))) for _ in range(12)]
    piece = lambda: r.choice(pool + ["x" * 300, "zz " * 60, r.choice(pool)[:90], "".join(r.choice("abc") for _ in range(40))])
    docs = [(i, "".join(piece() for _ in range(r.randint(0, 6)))) for i in range(80)] + [(200, None), (201, ""), (202, "y" * 500), (203, "y" * 5000)]
    got = B.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), digest=True, task_rows=task_rows)
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == plain_removal(docs)


def test_windows_of_equal_hash_are_compared(monkeypatch):
    """Even if all hashes collide, only equal windows count as seen (the one before of equal hash is looked at)."""
    r = random.Random(3)
    ctx = [bytes(r.choice(b"ab") for _ in range(130)) for _ in range(4)]
    pdf = pd.DataFrame({"ctx": [ctx[0], ctx[1], ctx[1], ctx[0] + ctx[2]], "h": [1, 2, 2, 1], "lo": [0, 5, 9, 3]})
    row, start, _, seen = B.compare(pdf, 100)
    text, want, before = [bytes(x) for x in pdf["ctx"]], [], set()
    for i, s in zip(row, start - pdf["lo"].to_numpy()[row]):
        w = text[i][s : s + 100]
        want.append(w in before)
        before.add(w)
    assert seen.tolist() == want and sum(want) == 62
    monkeypatch.setattr(B, "mix", lambda x: x * np.uint64(0))
    row, start, _, seen = B.compare(pdf, 100)
    at = [text[i][s : s + 100] for i, s in zip(row, start - pdf["lo"].to_numpy()[row])]
    assert all(at[i] == at[i - 1] for i in np.nonzero(seen)[0])


def test_forward_backward():
    rng = np.random.default_rng(3)
    size = np.array([4, 3, 1])
    e, start, move = rng.normal(size=(3, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    post, both = L.forward_backward(e, size, start, move, True)
    pairs = np.zeros((3, 3))
    for i, n in enumerate(size):
        want, total, pair = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            p = np.exp(start[y[0]] + sum(e[i, t, y[t]] for t in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total += p
            for t in range(n):
                want[t, y[t]] += p
            for a, b in zip(y, y[1:]):
                pair[a, b] += p
        pairs += pair / total
        assert np.allclose(post[i, :n], want / total) and not post[i, n:].any()
    assert np.allclose(both, pairs)


def test_code_switched_lines():
    en, de = "the and that with from".split(), "der und nicht mit von".split()
    r = random.Random(2)
    text = lambda v, n: "\n".join(" ".join(r.choice(v) for _ in range(8)) for _ in range(n))
    m = L.Model(["de", "en"], {})
    m.train([(L.chains(text(de, 4)), 0) for _ in range(60)] + [(L.chains(text(en, 4)), 1) for _ in range(60)])
    got = m.predict([text(en, 3) + "\n" + text(de, 1), text(de, 3) + "\n" + text(en, 1), "", "123"])
    assert [g[0] for g in got] == ["en", "de", "und", "und"] and 0.6 < got[0][1] < 0.9


def test_switches_within_a_line():
    en, de = "the and that with from".split(), "der und nicht mit von".split()
    r = random.Random(2)
    line = lambda v, n: " ".join(r.choice(v) for _ in range(n))
    m = L.Model(["de", "en"], {})
    m.train([(L.chains("\n".join(line(v, 8) for _ in range(4))), y) for _ in range(60) for y, v in enumerate((de, en))])
    stay = np.diag(m.move).mean() - (m.move.sum() - np.trace(m.move)) / 2
    assert 0 < stay < 20  # words mostly stay in a language, but switches are learned from
    text = line(en, 500) + " " + line(de, 500)
    got = m.tag(text)
    assert len(got) == 1000 and [w for w, _, _ in got] == text.split()
    assert sum(x == ("en" if i < 500 else "de") for i, (_, x, _) in enumerate(got)) > 990
    assert m.tag(None) == [] and m.predict([text])[0][1] < 0.6


def test_batches_change_no_posterior(monkeypatch):
    r = random.Random(4)
    texts = ["\n".join(" ".join(r.choice(["the", "der", "xyz" * 20]) for _ in range(r.choice([1, 5, 300]))) for _ in range(6)) for _ in range(5)]
    m = L.Model(["de", "en"], {})
    m.train([(L.chains(t), i % 2) for i, t in enumerate(texts)])
    one = m.predict(texts)
    monkeypatch.setattr(L, "CELLS", 10)
    assert [a for a, _ in m.predict(texts)] == [a for a, _ in one] and np.allclose([b for _, b in m.predict(texts)], [b for _, b in one])


def test_no_language_is_left_out(monkeypatch, spark):
    monkeypatch.setattr(L, "SAMPLE", 6)
    rows = [(i, f"{chr(97 + i % 6) * 5} " * 4, f"l{i % 6}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit(docs).langs == [f"l{i}" for i in range(6)]


def test_ftrl_against_a_plain_version():
    r = random.Random(9)
    rows = [(" ".join(r.choice(["good", "bad", "word", "Xx", "7!"]) for _ in range(r.randint(0, 30))), i % 2) for i in range(30)] + [(None, 1)]
    got = M.train(rows, 2)
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= M.L1 else -(zi - math.copysign(M.L1, zi)) / ((M.BETA + math.sqrt(n.get(i, 0.0))) / M.ALPHA + M.L2)

    for _ in range(2):
        for text, y in rows:
            f = M.features(text, M.Words()).tolist()
            x = {i: f.count(i) * M.SCALE / max(1, len(f)) for i in set(f)} | {0: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            w = {i: weight(i) for i in x}
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / M.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert {i for i, w in enumerate(got) if w} <= set(z) and np.allclose([got[i] for i in z], [weight(i) for i in z], atol=1e-6)
    for text, _ in rows:
        f = M.features(text, M.Words()).tolist()
        dot = weight(0) + sum(weight(i) * M.SCALE / len(f) for i in f)
        assert abs(M.score(text, got, M.Words()) - 1 / (1 + math.exp(-dot))) < 1e-6


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    same(spark, data, Q.queries()[name], Q.oracle_sql()[name])


def test_quality_on_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    got = Q.op1_quality_classifier(spark, data).where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").select("predicted", "quality", "score").collect()
    assert len(got) > 40 and sum(r.predicted == r.quality for r in got) / len(got) > 0.9
    good, bad = [[r.score for r in got if r.quality == q] for q in (1, 0)]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_languages_on_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    got = Q.op7_language_id(spark, data).where("held_out").join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").select("lang", "lang_pred").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_queries_against_libraries(spark, data):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in Q.op9_bpe_codec(spark, data).collect():
        ids = TIK.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))
    for r in Q.op10_token_counts(spark, data).collect():
        n = len(TOK.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_queries_against_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    mine = {r.doc_id: r for r in Q.op2_decontamination(spark, data).collect()}
    for i in sorted(docs)[:60]:
        n, hit, who = contamination(docs[i], items)
        r = mine[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(who), hashlib.sha256(",".join(who).encode()).hexdigest())
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    classes = plain_classes(sorted(set(fps.values())))
    least = {}
    for i, v in sorted(fps.items()):
        least.setdefault(classes[v], i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in Q.op6_simhash(spark, data).collect()} == {(i, f"{v:016x}", least[classes[v]]) for i, v in fps.items()}
    assert {r.doc_id: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in Q.op8_substring_dedup(spark, data).collect()} == plain_removal(docs.items())


def test_held_out_rows(spark, data):
    for r in Q.op7_language_id(spark, data).collect():
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
