"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 benchmark words (shorter items are one window). Patterns of one length m are searched
together: a shift table over blocks of two words says how far the window may move on, so most words of a clean text are
never looked at; where the shift is 0, the suffix block's bucket, then its prefix block, select the few patterns that
are compared directly. Tables are flat arrays of a few tens of bytes a pattern: the shift table is indexed by block hashes (a collision can only
shorten a shift), buckets are ranges of patterns sorted by suffix and prefix hash, equal patterns are one.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of any character beyond ASCII. Null or empty texts have no
words and no hits. Null item texts have no window. Repeated item rows and windows that several items share count for each
item. An empty benchmark leaves every document clean. Null ids are returned as they are.

Items are broadcast in passes of at most PASS_BYTES of text, which a worker makes tables of once. One pass covers a benchmark of that size. A larger one takes
several passes over the documents, whose hits are united by id and text hash. Longer items are cut into pieces that overlap, so that no window is lost.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bytes, map_texts, per_process, slices, workers

WINDOW = 13
#: Bytes of item text searched for in one pass over the documents.
PASS_BYTES = 32 << 20

_KEEP = b"abcdefghijklmnopqrstuvwxyz0123456789"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP or c >= 0x80 else 32 for c in range(256))
SCHEMA = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
DDL = "n_words long, spans array<long>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WuManber:
    """All patterns of one length, in words. ids: item words as numbers into `vocab`; starts: where patterns start in it; owner: their items' numbers."""

    def __init__(self, m: int, vocab: list[bytes], ids: np.ndarray, starts: np.ndarray, owner: np.ndarray, names: list[str]):
        self.m, self.block = m, min(2, m)
        self.vocab, self.ids, self.names = vocab, ids, names
        word = np.fromiter(map(hash, vocab), np.int64, len(vocab))
        at = lambda q: word[ids[starts + q]]
        mix = (lambda q: at(q - 1) * 3 ^ at(q)) if self.block == 2 else at
        self.mask = (1 << max(10, (4 * len(starts) - 1).bit_length())) - 1
        shift = np.full(self.mask + 1, m - self.block + 1, np.uint8 if m < 256 else np.int64)
        for q in range(self.block - 1, m):  # ever smaller shifts overwrite larger ones
            shift[mix(q) & self.mask] = m - 1 - q
        self.shift = shift.tobytes() if m < 256 else shift.tolist()
        self.low = 0xFFFFFFFF
        key = (mix(m - 1) & self.low) << 32 | mix(self.block - 1) & self.low  # suffix block, prefix block
        whole = np.zeros(len(starts), np.int64)
        for q in range(m):
            whole = whole * 0x100000001B3 + at(q)
        order = np.lexsort((owner, whole, key))
        key, whole, self.starts, owner = key[order], whole[order], starts[order], owner[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])])
        for q in range(m):  # equal hashes of different words stay apart
            w = ids[self.starts + q]
            new[1:] |= w[1:] != w[:-1]
        first = np.nonzero(new)[0]
        self.key, self.starts, self.owner = key[first], self.starts[first], owner
        self.end = np.append(first, len(owner))

    def search(self, words: list[bytes]):
        """Yield (start, pattern) of every occurrence."""
        m, shift, mask, n = self.m, self.shift, self.mask, len(words)
        two = self.block == 2
        i = m - 1
        while i < n:
            tail = hash(words[i - 1]) * 3 ^ hash(words[i]) if two else hash(words[i])
            s = shift[tail & mask]
            if s:
                i += s
                continue
            start = i - m + 1
            head = hash(words[start]) * 3 ^ hash(words[start + 1]) if two else tail
            k = (tail & self.low) << 32 | head & self.low
            k = k - (1 << 64) if k >> 63 else k
            at = int(np.searchsorted(self.key, k))
            if at < len(self.key) and self.key[at] == k:
                here = words[start : i + 1]
                while at < len(self.key) and self.key[at] == k:
                    p = int(self.starts[at])
                    if [self.vocab[w] for w in self.ids[p : p + m].tolist()] == here:
                        yield start, at
                    at += 1
            i += 1

    def items(self, pattern: int) -> list[str]:
        return [self.names[o] for o in self.owner[self.end[pattern] : self.end[pattern + 1]].tolist()]


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    known: dict[bytes, int] = {}
    ids, by_length, names, at = array("i"), defaultdict(list), [], 0
    for item, text in items:
        w = words_of(text)
        m = min(window, len(w))
        if m:
            ids.extend([known.setdefault(x, len(known)) for x in w])
            by_length[m].append((at, len(w) - m + 1, len(names)))
            names.append("" if item is None else item)
            at += len(w)
    flat, vocab, out = np.array(ids, np.int32), list(known), []
    for m, rows in sorted(by_length.items()):
        low, n, who = (np.array(x, np.int64) for x in zip(*rows))
        starts = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        out.append(WuManber(m, vocab, flat, starts, np.repeat(who, n).astype(np.int32), names))
    return out


def scan(text: str | None, matchers: list[WuManber]) -> tuple[int, list[int], list[str]]:
    """Number of words, hit spans as flat sorted [start, end, ...), items with an occurrence."""
    words = words_of(text)
    spans, items = [], set()
    for mm in matchers:
        seen = set()
        for start, pattern in mm.search(words):
            spans.append((start, start + mm.m))
            seen.add(pattern)
        for pattern in seen:
            items.update(mm.items(pattern))
    return len(words), unite(spans), sorted(items)


def unite(spans) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def pieces(text: str | None, most: int, window: int) -> list[str | None]:
    """The text, or if it is longer than `most` bytes parts of it that hold all its windows."""
    if not text or len(text) * 4 <= most or len(text.encode("utf-8", "surrogatepass")) <= most:
        return [text]
    words, out, low = [w.decode("utf-8", "surrogatepass") for w in words_of(text)], [], 0
    while low < len(words):
        high, size = low, 0
        while high < len(words) and (size <= most or high - low < 2 * window):
            size += len(words[high]) * 4 + 1
            high += 1
        if len(words) - high < window:
            high = len(words)
        out.append(" ".join(words[low:high]))
        low = high if high == len(words) else high - window + 1
    return out


def passes(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> list:
    """For every pass a function that gives a worker its matchers. The driver holds one pass of at most about `most` bytes at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total * 2 // most)) if total > most else 1
    out = []
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else items
        block, size = [], 0
        for r in rows.toLocalIterator():
            for part in pieces(r["text"], most, window):
                if size + len(part) * 4 > most and block and size + len(part.encode("utf-8", "surrogatepass")) > most:
                    out.append(_shared(spark, block, window))
                    block, size = [], 0
                block.append((r["item"], part))
                size += len(part.encode("utf-8", "surrogatepass")) + 16
        if block:
            out.append(_shared(spark, block, window))
    return out


def _shared(spark, block, window: int):
    """Broadcast a block of items; the function returned gives a worker its matchers."""
    blob = pickle.dumps(block)
    shared, key = broadcast_bytes(spark, blob, "a block of benchmark items"), hashlib.sha256(blob).hexdigest()
    return lambda: per_process(("wm", key, window), lambda: build(pickle.loads(shared.value), window), alone=True)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_cols: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Return id columns, n_words, spans (flat [start, end) word offsets of hits), items for every row of `docs`."""
    loads = passes(benchmark, item_col, item_text_col, window, pass_bytes)

    def one(load, keep, source):
        def run(texts):
            found = [scan(t, load() if load else []) for t in texts]
            return {n: [f[i] for f in found] for i, n in enumerate(SCHEMA.names)}

        return map_texts(source, run, SCHEMA, DDL, keep=keep, text_col=text_col)

    if len(loads) < 2:
        return one(loads[0] if loads else None, id_cols, docs)
    keyed = docs.select(*[docs[c].alias(f"_id{i}") for i, c in enumerate(id_cols)], F.xxhash64(docs[text_col]).alias("_k"), docs[text_col].alias(text_col))
    ids = [f"_id{i}" for i in range(len(id_cols))]
    out = None
    for load in loads:
        part = one(load, (*ids, "_k"), keyed)
        out = part if out is None else out.unionByName(part)
    out = out.groupBy(*ids, "_k").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count("*").alias("n"))
    # repeated rows were counted once a pass
    out = out.withColumn("_again", F.explode(F.sequence(F.lit(1), (F.col("n") / len(loads)).cast("int"))))
    return out.select(*[F.col(i).alias(c) for i, c in zip(ids, id_cols)], "n_words", united(F.col("spans")).alias("spans"), "items")


def united(spans):
    """Flat spans of several passes as disjoint ones in order."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(spans) / 2).cast("int") - 1), lambda i: F.struct(F.get(spans, 2 * i).alias("a"), F.get(spans, 2 * i + 1).alias("b"))))
    none = F.expr("cast(array() as array<long>)")
    add = lambda acc, p: F.when(
        (F.size(acc) > 0) & (p["a"] <= F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), p["b"])))
    ).otherwise(F.concat(acc, F.array(p["a"], p["b"])))
    return F.when(F.size(spans) > 0, F.aggregate(pairs, none, add)).otherwise(none)


def with_verdict(found: DataFrame) -> DataFrame:
    """Add n_hit and contaminated (a twentieth of the words or more are hit)."""
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.when(i % 2 == 0, -F.get("spans", i)).otherwise(F.get("spans", i)))
    out = found.withColumn("n_hit", F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """The rows of `docs` that are not contaminated, columns as they are."""
    workers(docs.sparkSession)
    loads = passes(benchmark, item_col, item_text_col, window, pass_bytes)
    if len(loads) > 1:
        row = docs.select(F.struct("*").alias("d"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("k"), F.col(text_col).alias("text"))
        found = find_contamination(row, benchmark, id_cols=("id", "k"), item_col=item_col, item_text_col=item_text_col, window=window, pass_bytes=pass_bytes)
        bad = with_verdict(found).where("contaminated").select(F.col("id").alias("id2"), F.col("k").alias("k2")).distinct()
        return row.join(bad, F.col("id").eqNullSafe(F.col("id2")) & (F.col("k") == F.col("k2")), "left_anti").select("d.*")
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for part in slices(b, at):
                found = [scan(t, loads[0]() if loads else []) for t in part.column(at).to_pylist()]
                hits = [(n, sum(s[1::2]) - sum(s[::2])) for n, s, _ in found]
                yield part.filter(pa.array([not (h > 0 and 20 * h >= n) for n, h in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
