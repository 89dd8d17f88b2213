"""The pipeline against a plain version of all five stages."""

import base64
import hashlib
import re

import public_tokenizers as P
import tiktoken
from test_methods import contamination
from test_near_copies import plain_first

import corpus_pipeline

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def bad(text):
    w = BLANK.findall(text or "")
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = {}
    for x in wins:
        count[x] = count.get(x, 0) + 1
    hit = {j for i, x in enumerate(wins) if count[x] > 1 for j in range(i, i + 8)}
    return len(w) < 20 or 100 * len(hit) > 30 * len(w)


def quality(docs):
    fails, n = {}, {}
    for _, t, s in docs:
        n[s] = n.get(s, 0) + 1
        fails[s] = fails.get(s, 0) + bad(t)
    rates = [fails[s] / n[s] for s in n if s is not None]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    weight = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1.0
    out = {s for s in n if s is not None and (fails[s] + m * weight) / (n[s] + weight) > 0.5}
    return [d for d in docs if not bad(d[1]) and d[2] not in out]


def lines(docs, least=50):
    place, spans = {}, {}
    for i, t, _ in sorted(docs):
        u = [(k, x, len(BLANK.findall(x))) for k, x in enumerate(t.split("\n"))]
        u = [x for x in u if x[2]]
        found = set()
        for a in range(len(u)):
            for order in (range(a, len(u)), range(a, -1, -1)):
                total = 0
                for b in order:
                    total += u[b][2]
                    if total >= least:
                        found.add((min(a, b), max(a, b)))
                        break
        for a, b in sorted(found):
            key = tuple(x[1] for x in u[a : b + 1])
            if place.setdefault(key, (i, u[a][0])) != (i, u[a][0]):
                spans.setdefault(i, set()).update(range(u[a][0], u[b][0] + 1))
    out = []
    for i, t, s in docs:
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in spans.get(i, ()))
        if i not in spans or BLANK.search(kept):
            out.append((i, kept, s))
    return out


def near(docs):
    first = plain_first([(i, t) for i, t, _ in docs])
    return [d for d in docs if first[d[0]] == d[0]]


def test_run(spark, data):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = []
    for d in near(lines(quality(docs))):
        n, hit, _ = contamination(d[1], items)
        if not (hit > 0 and 20 * hit >= n):
            kept.append(d)
    ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {(i, hashlib.sha256(",".join(map(str, tik.encode_ordinary(t))).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in kept}
    got = corpus_pipeline.run(spark, data).select("doc_id", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "decontamination", "byte-level BPE"]
