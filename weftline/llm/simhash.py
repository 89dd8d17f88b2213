"""SimHash near-duplicates with vantage-point trees.

A text's fingerprint has a bit set where over half of its shingles' hashes have it set. Distinct fingerprints within `radius` differing
bits are linked, and the links' connected components are the classes.

Shards: the word is cut into radius + 1 blocks. Two fingerprints within the radius agree on one of them, so they are at distance 0 in that
block's bits and meet in its shard: the shards overlap just enough that no link is lost. A shard's key takes as few bits of its block
as give shards of about `tree_rows` rows. Shards with more than `shard_rows` rows go on to the next level, where the word has one block
more and the key one block more; what is too large on the last level is cut by the distance to a vantage point (its least member) into rings,
rows near a ring's lower edge also being sent to the ring below, and rings are tiled: rows are salted, and every two salts meet in one task.
So no task gets an unbounded group, whatever the skew, and every level is exact.
Within a shard a vantage-point tree is joined with itself: all rows within the radius of a node's vantage point are linked to it, the others split
by the median distance, and by the triangle bound only rows within `radius` of the boundary can link across it. A task returns a
spanning star of each local class, never all pairs. Components are then found by star contraction over these edges, with checkpoints.

Null and empty texts have no shingle: their fingerprint is zero, linked like any other. Rows of a null id belong to classes, but a class's
component_id is its least non-null id (null if it has none). Repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts

BITS = 64
RADIUS = 3
SHINGLE = 3
#: Rows of a shard, or of a pair of tiles, that one task may get.
SHARD_ROWS = 16_384
#: Rows of a shard of the first level, on average.
TREE_ROWS = 4_096
#: Levels of ever longer keys before rings and tiles.
LEVELS = 4
RING = 8
#: Rows of a tree's leaf.
LEAF = 64
SCHEMA = pa.schema([("fp", pa.int64())])

_SPACES = b" \t\n\x0b\x0c\r"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _SPACES else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    ends = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts, ends)), np.uint64, len(ends))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed integer."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):  # whole texts, in slices that bound memory
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash as a signed integer."""
    return majority(shingle_hashes(text, shingle))


def near(a: np.ndarray, b: np.ndarray, radius: int):
    """Index pairs within the radius, by direct comparison."""
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


class Forest:
    """Union-find over positions, the least position as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def unite(self, left, right) -> None:
        a, b = self.up[left], self.up[right]
        new = a != b
        if not new.any():
            return
        for pair in np.unique(a[new] << 32 | b[new]).tolist():
            x, y = self.root(pair >> 32), self.root(pair & 0xFFFFFFFF)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def join(values: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, forest: Forest, leaf: int = LEAF, seen: dict | None = None) -> None:
    """Unite positions within the radius: `left` with `right`, or `left` with itself. The stack holds the tree's open nodes.

    `seen` counts the direct comparisons and the nodes split, by kind."""
    stack = [(left, right)]
    count = seen if seen is not None else {}
    note = lambda k, n=1: count.__setitem__(k, count.get(k, 0) + n)
    while stack:
        a, b = stack.pop()
        other = a if b is None else b
        if not len(a) or not len(other):
            continue
        if len(a) * len(other) <= leaf * leaf:
            i, j = near(values[a], values[other], radius)
            note("compared", len(a) * len(other))
            forest.unite(a[i], other[j])
            continue
        vantage = values[a[0]]
        da = np.bitwise_count(values[a] ^ vantage).astype(np.int16)
        db = da if b is None else np.bitwise_count(values[other] ^ vantage).astype(np.int16)
        note("compared", len(a) + (0 if b is None else len(b)))
        ball_a, ball_b = da <= radius, db <= radius
        forest.unite(a[ball_a], np.broadcast_to(a[0], int(ball_a.sum())))
        if b is not None:
            forest.unite(b[ball_b], np.broadcast_to(a[0], int(ball_b.sum())))
        whole = len(a) * (len(a) / 2 if b is None else len(b))
        cost = lambda parts: sum(len(x) * (len(x) / 2 if y is None else len(y)) for x, y in parts)
        if 2 * (int(ball_a.sum()) + int(ball_b.sum())) > len(a) + len(other):
            # the ball is one class already: only the rest can add to it, as far as the bound lets it reach
            out_a, out_b = ~ball_a, ~ball_b
            parts = [(a[out_a], None if b is None else b[out_b]), (a[out_a & (da <= 2 * radius)], other[ball_b])]
            if b is not None:
                parts.append((a[ball_a], b[out_b & (db <= 2 * radius)]))
            if cost(parts) < 0.9 * whole:
                note("balls")
                stack += parts
                continue
        mu = int(np.median(da))
        if b is None and (mu >= da.max() or mu < da.min()):
            mu = (int(da.min()) + int(da.max())) // 2
        a_in, b_in = da <= mu, db <= mu
        a_near, b_near = (da > mu - radius) & a_in, (db > mu - radius) & b_in
        a_far, b_far = (da <= mu + radius) & ~a_in, (db <= mu + radius) & ~b_in
        if b is None:
            parts = [(a[a_in], None), (a[~a_in], None), (a[a_near], a[a_far])]
        else:
            parts = [(a[a_in], b[b_in]), (a[~a_in], b[~b_in]), (a[a_near], b[b_far]), (a[a_far], b[b_near])]
        if cost(parts) < 0.9 * whole:
            note("splits")
            stack += parts
            continue
        note("flat")
        for k in range(0, len(a), 256):  # the bounds prune nothing here: compare in slices
            forest.roots()
            for m in range(k if b is None else 0, len(other), 1024):
                i, j = near(values[a[k : k + 256]], values[other[m : m + 1024]], radius)
                note("compared", min(256, len(a) - k) * min(1024, len(other) - m))
                forest.unite(a[k + i], other[m + j])


def local_stars(values: np.ndarray, side: np.ndarray | None, radius: int, leaf: int = LEAF, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of every local class of two or more. side: rows marked 0 and 1 are compared with each other only."""
    if len(values) == 2:
        ok = int(values[0] ^ values[1]).bit_count() <= radius
        return (values[1:], values[:1]) if ok else (values[:0], values[:0])
    order = np.argsort(values, kind="stable")
    values = values[order]
    forest = Forest(len(values))
    if side is None:
        join(values, np.arange(len(values)), None, radius, forest, leaf, seen)
    else:
        s = side[order]
        join(values, np.nonzero(s == 0)[0], np.nonzero(s == 1)[0], radius, forest, leaf, seen)
    roots = forest.roots()
    moved = roots != np.arange(len(values))
    return values[moved], values[roots[moved]]


def shards(fps: DataFrame, level: int, want: int, radius: int) -> DataFrame:
    """(choice, key, fp): on level L keys are L of radius + L blocks, cut on the first level to `want` bits."""
    blocks = radius + level
    ends = [(BITS * i // blocks, BITS * (i + 1) // blocks) for i in range(blocks)]
    if level == 1:
        ends = [(a, min(b, a + want)) for a, b in ends]
    masks = [sum(((1 << b - a) - 1) << a for a, b in (ends[i] for i in c)) for c in combinations(range(blocks), level)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])
    return fps.select("fp", F.explode(keys).alias("s")).select("s.choice", "s.key", "fp")


def few(df: DataFrame) -> DataFrame:
    """For a join with few rows of fixed width: broadcast them if their number is within bounds."""
    return F.broadcast(df) if df.count() <= 100_000 else df


def tree_stars(at: DataFrame, radius: int, shard_rows: int, leaf: int = LEAF) -> DataFrame:
    """Edges (src, dst) of the classes within every shard (choice, key, fp). A task gets shards of about shard_rows rows together, each a tree of its own."""
    total = at.count()
    width = max(1, -(-total // shard_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        choice, key, v = (pdf[c].to_numpy(np.int64) for c in ("choice", "key", "fp"))
        order = np.lexsort((key, choice))
        choice, key, v = choice[order], key[order], v[order].view(np.uint64)
        cuts = np.nonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))[0] + 1
        src, dst = [v[:0]], [v[:0]]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(v)]):
            if hi - lo > 1:
                a, b = local_stars(v[lo:hi], None, radius, leaf)
                src.append(a), dst.append(b)
        pairs = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], axis=1).view(np.int64), axis=0)
        return pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return at.groupBy(F.pmod(F.xxhash64("choice", "key"), F.lit(width)).alias("task")).applyInPandas(run, "src long, dst long")


def ring_stars(at: DataFrame, big: DataFrame, radius: int, shard_rows: int, leaf: int = LEAF) -> DataFrame:
    """As `tree_stars` for the rows of too large shards `big` (choice, key, vantage): by rings around a vantage point, and tiles of rings."""
    wide = max(RING, radius)
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
    rings = F.when(far % wide < radius, F.array(far / wide, far / wide - 1)).otherwise(F.array(far / wide))
    ringed = at.join(few(big.select("choice", "key", "vantage")), ["choice", "key"])
    ringed = ringed.select("fp", "choice", "key", F.explode(F.transform(rings, lambda r: F.floor(r).cast("int"))).alias("ring")).where("ring >= 0")
    load = cut(ringed.groupBy("choice", "key", "ring").agg(F.ceil(F.count("*") * 2 / shard_rows).cast("int").alias("tiles")))
    ringed = ringed.join(few(load), ["choice", "key", "ring"])
    salt = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("salt")).alias("tile_a"), F.greatest(t, F.col("salt")).alias("tile_b"), (t < F.col("salt")).cast("int").alias("side")))
    tiled = ringed.withColumn("salt", salt).select("fp", "choice", "key", "ring", F.explode(pairs).alias("p")).select("fp", "choice", "key", "ring", "p.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cross = int(pdf["tile_a"].iat[0]) != int(pdf["tile_b"].iat[0])
        a, b = local_stars(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["side"].to_numpy() if cross else None, radius, leaf)
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return tiled.groupBy("choice", "key", "ring", "tile_a", "tile_b").applyInPandas(run, "src long, dst long")


def links(fps: DataFrame, *, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, tree_rows: int = TREE_ROWS, levels: int = LEVELS, leaf: int = LEAF) -> DataFrame:
    """Edges (src, dst) that span the same classes as all pairs of distinct fingerprints `fp` within the radius."""
    todo, out, level = fps, None, 1
    want = max(0, (max(1, fps.count() // tree_rows) - 1).bit_length())
    while level < levels and BITS * level // (radius + level) < want:  # keys of this level are too short for so many rows
        level += 1
    while True:
        at = shards(todo, level, want, radius)
        big = cut(at.groupBy("choice", "key").agg(F.count("*").alias("n"), F.min("fp").alias("vantage")).where(F.col("n") > shard_rows))
        if big.isEmpty():
            found, todo = tree_stars(at, radius, shard_rows, leaf), None
        else:
            keys = few(big.select("choice", "key"))
            found = tree_stars(at.join(keys, ["choice", "key"], "left_anti"), radius, shard_rows, leaf)
            if level >= levels:
                found, todo = found.unionByName(ring_stars(at, big, radius, shard_rows, leaf)), None
            else:
                todo, level = cut(at.join(keys, ["choice", "key"], "left_semi").select("fp").distinct()), level + 1
        out = found if out is None else out.unionByName(found)
        if todo is None:
            return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge: roots are the least nodes of components, by large-star and small-star steps."""
    at = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    while True:
        # large star: neighbours above a node go to its least neighbour
        both = at.select(F.col("a").alias("u"), F.col("b").alias("v")).union(at.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: a node and its lower neighbours go to the least of them
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(small.where("a <> b").distinct())
        sig = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if sig(now) == sig(at):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        at = now


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Return id, fp (signed 64-bit fingerprint), component_id for every row of `docs`."""

    def run(texts):
        return {"fp": [fingerprint(t, shingle) for t in texts]}

    at = cut(map_texts(docs, run, SCHEMA, "fp long", keep=(id_col,), text_col=text_col))
    fps = cut(at.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = components(links(fps, radius=radius, shard_rows=shard_rows))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return at.join(by_fp, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of each class, that of the least id (of rows with that id the one of least text); columns as they are.

    Rows of a null id can't be told apart and stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, radius=radius, shard_rows=shard_rows)
    return first_of_class(docs, found, id_col=id_col, text_col=text_col)


def first_of_class(docs: DataFrame, found: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that keep_one keeps, from their classes (id, component_id)."""
    found = cut(found)
    chosen = found.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    row = docs.select(F.struct("*").alias("d"))
    id_ = F.col("d")[id_col]
    kept = row.where(id_.isNotNull()).join(chosen, id_ == F.col("id"))
    if not chosen.where("n > 1").isEmpty():  # repeated ids
        kept = kept.groupBy("id").agg(F.min_by("d", F.coalesce(F.col("d")[text_col], F.lit(""))).alias("d"))
    return kept.select("d.*").unionByName(row.where(id_.isNull()).select("d.*"))
