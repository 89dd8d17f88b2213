"""Similarity search: steps against all nodes, texts against all functions.

Nothing is pre-filtered: every node is scored. `nearest` packs both sides into blocks, sets every block of one beside every block of the other, and lets the k best
rows of each step and block leave the workers; neither side passes through the driver. `scored` and `pairs` give whole sets of pairs; their steps are broadcast in blocks.

Products of vectors and overlaps of token sets are computed for a block of steps and one of nodes at once: folds over lambdas cost about 10 microseconds
a pair. Sums run over the dimensions in order, one product of columns after the other, so they are equal to the last bit to a fold from left to right.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import text as X
from ..functions import vectors as V
from ..lineage import cut
from .ranking import top_k

BLOCK = 10_000
#: Steps scored at once: what a worker holds is 16 bytes for each of them and each of the 10,000 rows of an Arrow batch.
SCORED = 1024
#: Rows set beside a block of SCORED steps at once; sums that are added up at once, so that they stay in the cache; overlaps that are remembered.
BESIDE, SUMS, KNOWN = 4096, 1 << 15, 4096


def pairs(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every step beside every node; the step side is broadcast, in blocks of about BLOCK rows."""
    return blocks(steps, lambda part: nodes.join(F.broadcast(part)), BLOCK)


def blocks(steps: DataFrame, search, block: int = BLOCK) -> DataFrame:
    """Apply `search` to blocks of steps and unite the results."""
    n = max(1, -(-steps.count() // block))
    out = None
    for i in range(n):
        part = search(steps.where(F.pmod(F.xxhash64(*steps.columns[:1]), F.lit(n)) == i) if n > 1 else steps)
        out = part if out is None else out.unionByName(part)
    return out


def products(queries: list, vectors: pa.ListArray) -> np.ndarray:
    """Rows of vectors by queries; 0 where lengths differ or one is null."""
    out = np.zeros((len(vectors), len(queries)))
    lengths = np.diff(vectors.offsets.to_numpy())
    lengths[np.asarray(vectors.is_null())] = -1
    flat, first = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    for n in {len(q) for q in queries if q is not None}:
        cols = [i for i, q in enumerate(queries) if q is not None and len(q) == n]
        rows = np.flatnonzero(lengths == n)
        if not n or not len(rows):
            continue
        left = flat[first[rows][:, None] + np.arange(n)]
        right = np.array([queries[i] for i in cols], dtype=float)
        by_dimension, total = np.ascontiguousarray(right.T), np.zeros((len(rows), len(cols)))
        tile = max(1, SUMS // len(cols))
        once = np.empty((tile, len(cols)))
        for at in range(0, len(rows), tile):
            part = total[at : at + tile]
            for d in range(n):
                part += np.multiply(left[at : at + tile, d : d + 1], by_dimension[d], out=once[: len(part)])
        if total.shape == out.shape:
            return total
        out[np.ix_(rows, cols)] = total
    return out


def overlaps(asked: list, parts: list) -> np.ndarray:
    """Best Jaccard of each step's distinct tokens with any part of each row; only steps that share a token are touched."""
    out = np.zeros((len(parts), len(asked)))
    sizes = np.array([len(a or ()) for a in asked])
    having: dict[str, list[int]] = {}
    for i, a in enumerate(asked):
        for t in a or ():
            having.setdefault(t, []).append(i)
    known, seen = {t: np.array(x) for t, x in having.items()}, {}
    for row, sets in enumerate(parts):
        for words in sets or ():
            if (found := seen.get(key := tuple(words or ()))) is None:
                hits = [known[t] for t in key if t in known]
                shared = np.bincount(np.concatenate(hits), minlength=len(asked)) if hits else np.zeros(0, int)
                at = np.flatnonzero(shared)
                if len(seen) == KNOWN:
                    seen.clear()
                found = seen[key] = at, shared[at] / (sizes[at] + len(key) - shared[at])
            at, jaccard = found
            if len(at):
                out[row, at] = np.maximum(out[row, at], jaccard)
    return out


def scored(asked: DataFrame, scanned: DataFrame, vectors: tuple[str, str], words: tuple[str, str] | None = None) -> DataFrame:
    """Every asked row beside every scanned one, with `product` of their vectors (null if lengths differ) and, with words, `overlap` of their token sets.

    vectors: the columns (asked, scanned) of doubles; words: distinct tokens (asked) and sets of them (scanned). Blocks of asked rows pass through the driver."""
    sc = asked.sparkSession.sparkContext
    kind = StructType([StructField("_at", IntegerType()), *[StructField(f.name, f.dataType) for f in asked.schema.fields]])
    a, b = vectors

    def lists(m: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.shape[1] else np.zeros(len(m) + 1, np.int32)), pa.array(m.ravel()))

    def search(part: DataFrame) -> DataFrame:
        rows = part.collect()
        held = sc.broadcast(([r[a] for r in rows], [r[words[0]] for r in rows] if words else None))
        local = asked.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], kind)

        @F.arrow_udf("array<double>")
        def product(v: pa.Array) -> pa.Array:
            return lists(products(held.value[0], v))

        @F.arrow_udf("array<double>")
        def overlap(t: pa.Array) -> pa.Array:
            return lists(overlaps(held.value[1], t.to_pylist()))

        beside = scanned.withColumn("_p", product(F.col(b)))
        if words:
            beside = beside.withColumn("_o", overlap(F.col(words[1])))
        both = beside.join(F.broadcast(local)).withColumn("product", F.when(F.size(a) == F.size(b), F.get("_p", F.col("_at"))))
        if words:
            both = both.withColumn("overlap", F.get("_o", F.col("_at"))).drop("_o")
        return both.drop("_p", "_at")

    return blocks(asked, search, min(BLOCK, SCORED))


def packed(df: DataFrame, size: int, together: int = 1) -> DataFrame:
    """Rows in blocks of about `size`, each a binary in Arrow's format, `together` of them a partition."""
    n = max(1, -(-df.count() // (size * together)))

    def pack(batches):
        rows = pa.Table.from_batches(held) if (held := list(batches)) else None
        count = rows.num_rows if rows is not None else 0
        step = -(-count // max(1, round(count / size)))
        for at in range(0, count, step or 1):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows.slice(at, step).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    return cut(df.repartition(n).mapInArrow(pack, "block binary"))


def numbers(c: pa.Array) -> np.ndarray:
    """Doubles with NaN for null."""
    return np.asarray(c.to_numpy(zero_copy_only=False), dtype=float)


def lengths(c: pa.ListArray) -> np.ndarray:
    return np.where(np.asarray(c.is_null()), -1, np.diff(c.offsets.to_numpy()))


def raw(product: np.ndarray, n: np.ndarray, known: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, where there is one) as vectors.cosine_raw. n: products of norms; known: both norms are there; same: lengths are equal."""
    zero = n == 0
    with np.errstate(all="ignore"):
        return np.where(zero, 0.0, product / n), known & (zero | same)


def client(product: np.ndarray, n: np.ndarray, known: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As vectors.cosine_client; NaN is above 1 there."""
    with np.errstate(all="ignore"):
        score = (product / n + 1.0) / 2.0
    score = np.where(np.isnan(score), 1.0, np.minimum(np.maximum(score, 0.0), 1.0))
    return np.where(known & same & (n != 0), score, 0.0), np.ones(n.shape, bool)


def first_k(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row, of equal ones the first."""
    k = min(k, score.shape[1])
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    above, level = score > least, score == least
    rest = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= rest)))


def nearest(asked: DataFrame, scanned: DataFrame, k: int, by: str, seq: str, vectors: tuple[str, str] | None = None, words: tuple[str, str] | None = None, semantic=raw, blend=None) -> DataFrame:
    """The k best scanned rows of each asked row `by`, by score, then `seq` (NaN first, null last): the other columns of both with score, semantic, lexical and rank.

    vectors: the columns (asked, scanned) of doubles, scored by `semantic`; words: distinct tokens (asked) and sets of them (scanned), scored by the best Jaccard.
    The score is the one there is, or what `blend` makes of (semantic, lexical)."""
    both = [c for c in (vectors, words) if c]
    keep = [[c for c in df.columns if c not in [x[i] for x in both]] for i, df in enumerate((asked, scanned))]
    if vectors:
        asked, scanned = (df.withColumn(v, V.doubles(F.col(v))).withColumn("_n", V.norm(F.col(v))) for df, v in zip((asked, scanned), vectors))
    fields = StructType([f for df, names in zip((asked, scanned), keep) for f in df.select(names).schema.fields] + [StructField(c, DoubleType()) for c in ("score", "semantic", "lexical")])
    nullable = StructType.fromJson(json.loads(fields.json(), object_hook=lambda o: o | {x: True for x in ("nullable", "containsNull", "valueContainsNull") if x in o}))

    def opened(block: pa.Scalar) -> pa.RecordBatch:
        return pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks().to_batches()[0]

    def compared(q: pa.RecordBatch, s: pa.RecordBatch) -> pa.RecordBatch:
        meaning = lexical = there = None
        if vectors:
            a, b = q.column(vectors[0]), s.column(vectors[1])
            na, nb = numbers(q.column("_n")), numbers(s.column("_n"))
            known = ~np.asarray(q.column("_n").is_null())[:, None] & ~np.asarray(s.column("_n").is_null())
            meaning, there = semantic(products(b.to_pylist(), a), na[:, None] * nb, known, lengths(a)[:, None] == lengths(b))
        if words:
            lexical = overlaps(q.column(words[0]).to_pylist(), s.column(words[1]).to_pylist()).T
        score = blend(meaning, lexical) if blend else lexical if meaning is None else meaning
        order = np.where(np.isnan(score), np.inf, score)
        if there is not None:
            order[~there] = -np.inf
        i, j = first_k(order, k)
        columns = [q.column(c).take(pa.array(i)) for c in keep[0]] + [s.column(c).take(pa.array(j)) for c in keep[1]]
        for m, null in ((score, there), (meaning, there), (lexical, None)):
            columns.append(pa.nulls(len(i), pa.float64()) if m is None else pa.array(m[i, j], pa.float64(), mask=None if null is None else ~null[i, j]))
        return pa.RecordBatch.from_arrays(columns, [f.name for f in nullable.fields])

    def search(batches):
        last = q = None
        for batch in batches:
            for one, other in zip(*batch.columns):
                if last is None or not one.equals(last):
                    last, q = one, opened(one)
                s = opened(other)
                yield compared(q, s.take(pc.sort_indices(s.column(seq))))

    left, right = packed(asked, min(BLOCK, SCORED)), packed(scanned, BESIDE, 4)
    found = left.crossJoin(right.withColumnRenamed("block", "other").hint("shuffle_replicate_nl")).mapInArrow(search, nullable)
    return top_k(found, [by], [F.col("score").desc(), F.col(seq)], k)


def type_filter(wanted: Column, types: Column, node_type: Column) -> Column:
    """True if nothing is wanted, or any of the node's types is."""
    return (F.coalesce(F.size(wanted), F.lit(0)) <= 0) | F.arrays_overlap(wanted, F.array_union(types, F.array(node_type)))


def candidate_nodes(steps: DataFrame, nodes: DataFrame, k: int = 5, node_types: list[str] | None = None, guard_empty: bool = True) -> DataFrame:
    """Top k nodes of each step by 0.70 cosine + 0.30 Jaccard, ties by the nodes' seq.

    steps: step_id, text, query; nodes: seq, id, name, node_type, description, aliases, types, embedding. With guard_empty, empty texts find nothing.
    """
    q = steps.select("step_id", "text", "query").withColumn("_qt", X.token_set(F.col("text")))
    if guard_empty:
        q = q.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    n = nodes.withColumn("_nt", X.token_parts(X.client_parts(*[F.col(c) for c in ("name", "id", "description", "aliases", "types")])))
    if node_types:
        n = n.where(type_filter(X.strings(*node_types), F.col("types"), F.col("node_type")))
    q, n = q.select("step_id", "query", "_qt"), n.select("seq", "id", "name", "node_type", "embedding", "_nt")
    best = nearest(q, n, k, "step_id", "seq", ("query", "embedding"), ("_qt", "_nt"), client, V.blend_client).where("score > 0")
    return best.select("step_id", "seq", "id", "name", "node_type", "score", F.col("lexical").alias("lexical_score"), F.col("semantic").alias("semantic_score"), "rank")


def top_then_threshold(steps: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Rank by raw cosine, keep k, and only then apply the threshold."""
    best = nearest(steps.select("step_id", "query"), nodes.select("seq", "id", "embedding"), k, "step_id", "seq", ("query", "embedding"))
    return best.select("step_id", "seq", "id", F.col("score").alias("similarity"), "rank").where(F.col("similarity") >= threshold)


def match_functions(texts: DataFrame, functions: DataFrame, threshold: float = 0.70, k: int = 1) -> DataFrame:
    """Best k functions of each text; below the threshold the score stays but the function is hidden.

    texts: text_id, text, query; functions: seq, name, description, inputs, outputs, embedding."""
    f = functions.select("seq", "name", "description", "inputs", "outputs", "embedding")
    best = nearest(texts.select("text_id", "text", "query"), f, k, "text_id", "seq", ("query", "embedding"))
    found = F.col("score") >= threshold
    hide = lambda c: F.when(found, F.col(c))
    return best.select(
        "text_id", "text", "rank", "score", found.alias("found"), F.when(found, "FOUND").otherwise("NOT_FOUND").alias("status"),
        hide("name").alias("function_name"), hide("description").alias("description"), hide("inputs").alias("inputs"), hide("outputs").alias("outputs"),
    )


def resolve_dependencies(dependencies: DataFrame, steps: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each dependency's texts go to the best candidate by 0.65 score + 0.35 Jaccard with the candidate's step, first in (step, rank) on ties.

    dependencies: prompt_id, seq, before, after; steps: prompt_id, step_index, text; candidates: prompt_id, step_index, rank, node_id, score.
    Both texts must be there and find different nodes."""
    ask = dependencies.where("before <> '' AND after <> ''").select("prompt_id", "seq", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("said")) for s in ("before", "after")])).alias("e")).select("prompt_id", "seq", "e.*")
    with_step = candidates.join(steps.select("prompt_id", "step_index", F.col("text").alias("step_text")), ["prompt_id", "step_index"])
    both = ask.join(with_step, "prompt_id")
    similar = X.lexical(X.norm_builder(F.col("said")), F.array("step_text"), X.token_set_builder)
    both = both.withColumn("s", V.blend_dependency(F.col("score"), similar))
    best = top_k(both, ["prompt_id", "seq", "side"], [F.col("s").desc(), F.col("step_index"), F.col("rank")], 1)
    wide = best.groupBy("prompt_id", "seq").agg(*[F.max(F.when(F.col("side") == s, F.col("node_id"))).alias(c) for s, c in (("before", "source"), ("after", "target"))])
    return wide.where("source <> target")
