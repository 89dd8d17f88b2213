"""SimHash near-duplicates for the pipeline: simhash.py's trees at a wide radius, with an exact check of similarity behind them.

Texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8 are linked; classes are connected components.

1. Texts become sets of 64-bit shingle hashes (words as in simhash.py) and fingerprints of those sets. Texts with equal sets are one node.
2. Candidates: a pair at 0.8 differs in about 10 of 64 bits, give or take 3, so RADIUS lets less than one in 10,000 such pairs go, and fewer of closer ones.
   At that radius blocks of the word can't be shard keys. Shards are keyed by min-wise hashes instead, BANDS bands of ROWS: a pair at 0.8 shares no shard with
   probability (1 - 0.8^4)^48 = 1e-11. In each shard a vantage-point tree links fingerprints within the radius; a shard with more than `shard_rows`
   fingerprints is one class of candidates as it is. Components over these links are clusters that hold all links.
3. Links: inside a cluster shingle sets are compared exactly. A search from each node over those not yet reached finds the components without visiting
   pairs that are united already. A cluster with more than `tile` shingles is tiled: its nodes are salted, and every two salts meet in one task.
4. Components over the links are the classes.

Texts without a word share the empty set. Rows of a null id belong to classes, but a class's component_id is its least non-null id. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, workers
from .simhash import SHARD_ROWS, components, few, first_of_class, majority, shingle_hashes, tree_stars

SHINGLE = 5
#: Least similarity as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
#: Differing bits of fingerprints that are compared.
RADIUS = 21
BANDS = 48
ROWS = 4
#: Shingles that one tile of a cluster holds.
TILE = 400_000
SCHEMA = pa.schema([("sid", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

_RNG = np.random.default_rng(20240511)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle."""
    return np.unique(shingle_hashes(text, shingle))


def bands_of(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which holds the band's number."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):  # whole texts, in slices that bound memory
        low = np.minimum(low, ((found[None, i : i + 2048] ^ _XOR) * _MUL).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def linked(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) positions of every class of two or more sets, by exact comparison."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    size = size[order]
    codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int64)
    p, q = similar
    left = np.nonzero(size > 0)[0]  # not yet reached, by size
    member, root = [], []
    while len(left):
        top, todo, left = int(left[0]), [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            lo, hi = np.searchsorted(size[left] * q, p * size[i]), np.searchsorted(size[left] * p, q * size[i], side="right")
            mine = codes[start[i] : start[i + 1]]
            mark[mine] = 1
            near = []
            for at in range(lo, hi, 1024):
                others = left[at : min(at + 1024, hi)]
                n = size[others]
                ends = np.cumsum(n)
                flat = np.arange(int(ends[-1])) + np.repeat(start[others] - (ends - n), n)
                both = np.add.reduceat(mark[codes[flat]], ends - n)
                near.append(others[both * q >= p * (size[i] + n - both)])
            mark[mine] = 0
            near = np.concatenate(near) if near else left[:0]
            if len(near):
                member += near.tolist()
                root += [top] * len(near)
                todo += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return order[member] if member else order[:0], order[root] if root else order[:0]


def candidates(nodes: DataFrame, *, radius: int, shard_rows: int) -> DataFrame:
    """(sid, root) of the nodes that have candidates, by cluster."""
    at = nodes.where("size > 0").select("fp", F.explode("bands").alias("key")).distinct()
    count = cut(at.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low")).where("n > 1"))
    big = count.where(F.col("n") > shard_rows).select("key", "low")
    shared = at.join(count.where(F.col("n") <= shard_rows).select("key"), "key").select(F.lit(0).alias("choice"), "key", "fp")
    edges = tree_stars(shared, radius, shard_rows)
    if not big.isEmpty():
        edges = edges.unionByName(at.join(few(big), "key").where("fp <> low").select(F.col("fp").alias("src"), F.col("low").alias("dst")))
    roots = components(edges)
    named = nodes.where("size > 0").select("sid", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("sid", F.coalesce("root", "fp").alias("root"))
    crowd = named.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    return named.join(crowd, "root").select("sid", "root")


def links(docs: DataFrame, nodes: DataFrame, *, id_col: str, text_col: str, shingle: int, tile: int, radius: int, shard_rows: int) -> DataFrame:
    """Edges (src, dst) that span the classes. nodes: sid, size, fp, bands, rep (id and text hash of one text)."""
    roots = candidates(nodes, radius=radius, shard_rows=shard_rows)
    members = cut(roots.join(nodes.select("sid", "size", "rep"), "sid"))
    load = members.groupBy("root").agg(F.ceil(F.sum("size") / tile).cast("int").alias("tiles"))
    width = max(1, 4 * int(members.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // tile)
    members = members.join(load, "root").withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k"), F.col(text_col).alias("text"))
    picked = members.select("sid", "root", "tiles", "salt", F.col("rep.id").alias("id1"), F.col("rep.k").alias("k1"))
    picked = text.join(picked, F.col("id").eqNullSafe(F.col("id1")) & (F.col("k") == F.col("k1")))

    def hashed(texts):
        return {"found": [shingle_set(t, shingle).tobytes() for t in texts]}

    sets = map_texts(picked, hashed, pa.schema([("found", pa.binary())]), "found binary", keep=("sid", "root", "tiles", "salt"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("salt")).alias("tile_a"), F.greatest(t, F.col("salt")).alias("tile_b")))
    sets = sets.withColumn("p", F.explode(pairs)).select("sid", "root", "found", "p.*", F.when(F.col("tiles") > 1, F.col("root")).alias("big"), F.pmod(F.xxhash64("root"), F.lit(width)).alias("bucket"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = [], []
        for _, part in pdf.drop_duplicates("sid").groupby("root", sort=False):
            sid = part["sid"].to_numpy(np.int64)
            a, b = linked([np.frombuffer(x, np.uint64) for x in part["found"]])
            src.append(sid[a]), dst.append(sid[b])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return sets.groupBy("bucket", "big", "tile_a", "tile_b").applyInPandas(run, "src long, dst long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tile: int = TILE, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Return id, component_id for every row of `docs`."""
    workers(docs.sparkSession)

    def run(texts):
        sets = [shingle_set(t, shingle) for t in texts]
        return {"sid": [xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63) for s in sets], "size": [len(s) for s in sets], "fp": [majority(s) for s in sets], "bands": [bands_of(s) if len(s) else [] for s in sets]}

    source = docs.withColumn("_k", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    at = cut(map_texts(source, run, SCHEMA, "sid long, size long, fp long, bands array<long>", keep=(id_col, "_k"), text_col=text_col))
    rep = F.min(F.struct(F.col(id_col).alias("id"), F.col("_k").alias("k"))).alias("rep")
    nodes = cut(at.groupBy("sid").agg(F.min(id_col).alias("low"), F.first("size").alias("size"), F.first("fp").alias("fp"), rep, F.first("bands").alias("bands")))
    roots = components(links(docs, nodes, id_col=id_col, text_col=text_col, shingle=shingle, tile=tile, radius=radius, shard_rows=shard_rows))
    named = nodes.join(roots, nodes["sid"] == roots["node"], "left").select("sid", "low", F.coalesce("root", "sid").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_set = named.join(least, "root").select("sid", "component_id")
    return at.select(id_col, "sid").join(by_set, "sid").select(id_col, "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row of each class, as simhash.keep_one chooses it."""
    return first_of_class(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, tile=tile), id_col=id_col, text_col=text_col)
