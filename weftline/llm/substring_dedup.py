"""Exact removal of repeated byte strings of a fixed length, whole corpus.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller document or earlier in the same one. Strings are judged on the
input, never cross documents, and may overlap.

The method first named for this operator, a run-compressed Burrows-Wheeler index with matching statistics, is not used; the README says why, with figures. Instead:
1. anchors: every window of `length` bytes selects the least hash among its GRAM-byte grams, so equal windows have equal anchors at equal offsets;
2. anchors whose hash recurs are joined back to their documents, which return the bytes around them, enough for all windows of the anchor;
3. rows of an anchor meet in a task, which compares all their windows in document order and returns the spans that occurred before. An anchor with very many
   rows is salted; windows that are still first within their salt meet again by two 64-bit hashes, the window's and its anchor's, in a plain aggregation;
4. spans are joined to their documents and cut out.
Within a task windows of equal hash are compared byte by byte; only windows of different salts are equal by their two hashes alone.

Documents are ordered by (doc_id, text hash), nulls first; rows equal in both are one document and get equal results. Null texts are empty. An empty table gives
an empty table.
"""

from __future__ import annotations

import gc
import hashlib
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_path, workers

LENGTH = 100
GRAM = 16
#: Rows of contexts that a task compares at once.
TASK_ROWS = 40_000
BUFFER = 1 << 18

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x5851F42D4C957F2D
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K3
    return x ^ (x >> np.uint64(29))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def anchors(buffer: bytes, bounds: np.ndarray, length: int, gram: int):
    """Anchors of documents that lie end to end in `buffer`, bounds[i] to bounds[i + 1].

    Returns document, position, first and last window start (in the buffer), hash."""
    n = len(buffer)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    v = np.ndarray(n - 7, "<u8", buffer, strides=(1,)).astype(np.uint64)
    g = v[: n - gram + 1] * _K1
    for o in range(8, gram - 7, 8):
        g = (g ^ (g >> np.uint64(32))) * _K2 + v[o : o + n - gram + 1]
    if gram % 8:
        g = (g ^ (g >> np.uint64(32))) * _K2 + v[gram - 8 :]
    g = mix(g)
    bits = np.uint64(max(1, int(n).bit_length()))
    m = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
    w = length - gram + 1
    span = 1
    while 2 * span <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    at = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # windows that stay within their document
    size = np.diff(bounds)
    valid = np.zeros(len(at) + 1, np.int64)
    has = size >= length
    np.add.at(valid, bounds[:-1][has], 1)
    np.add.at(valid, bounds[1:][has] - length + 1, -1)
    start = np.nonzero(np.cumsum(valid[:-1]) > 0)[0]
    if not len(start):
        return none, none, none, none, none
    p = at[start]
    first = np.concatenate([[True], p[1:] != p[:-1]])
    i = np.nonzero(first)[0]
    last = np.concatenate([i[1:] - 1, [len(p) - 1]])
    pos = p[i]
    return np.searchsorted(bounds, pos, side="right") - 1, pos, start[i], start[last], g[pos].view(np.int64)


def chunks(texts: list[str | None], most: int = BUFFER):
    """(number of the first text, bytes end to end, bounds) for runs of texts of about `most` bytes; longer texts are alone."""
    part, size, at = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if part and size + len(b) > most:
            yield at, b"".join(part), np.cumsum([0, *map(len, part)])
            part, size, at = [], 0, i
        part.append(b)
        size += len(b)
    if part:
        yield at, b"".join(part), np.cumsum([0, *map(len, part)])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    workers(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for at, buf, bounds in chunks(b.column(2).to_pylist()):
                doc, pos, lo, hi, h = anchors(buf, bounds, length, gram)
                if not len(doc):
                    continue
                rows = pa.array(doc + at)
                p = pos - bounds[doc]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(p.astype(np.int32)), pa.array((lo - bounds[doc]).astype(np.int32)), pa.array((hi - lo).astype(np.int16)), pa.array(h)],
                    ["id", "k", "p", "lo", "n", "h"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, k long, p int, lo int, n smallint, h long")


def contexts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """From documents with `at` (p, lo, n, h, salts) the bytes that their windows cover."""

    def run(batches):
        for b in batches:
            owner, ctx, start = [], [], []
            texts = b.column(2)
            lists = b.column(3)
            inner = lists.flatten()
            lo, n = inner.field("lo").to_numpy(), inner.field("n").to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            i = 0
            for row in range(b.num_rows):
                data = texts[row].as_py().encode("utf-8", "surrogatepass")
                for j in range(i, i + size[row]):
                    ctx.append(data[lo[j] : lo[j] + n[j] + length])
                i += size[row]
            owner = pa.array(np.repeat(np.arange(b.num_rows), size))
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), inner.field("lo"), inner.field("h"), inner.field("salts"), pa.array(ctx, pa.binary())], ["id", "k", "lo", "h", "salts", "ctx"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, k long, lo int, h long, salts int, ctx binary")


def compare(pdf: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of rows in document order: row, start, window hash, whether it occurred in an earlier window."""
    ctx = pdf["ctx"].tolist()
    size = np.fromiter(map(len, ctx), np.int64, len(ctx))
    buf = np.frombuffer(b"".join(ctx), np.uint8)
    n = size - length + 1
    row = np.repeat(np.arange(len(ctx)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[row] + inner
    up = powers(_BASE, len(buf) + 1)
    down = powers(pow(_BASE, -1, 1 << 64), len(buf) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[:-1])])
    h = (total[at + length] - total[at]) * down[at]
    h = mix(h ^ mix(pdf["h"].to_numpy(np.int64).view(np.uint64) + _K1)[row])
    order = np.argsort(h, kind="stable")  # equal windows stay in document order
    twin = np.full(len(h), -1)  # the window before of equal hash
    same = np.nonzero(h[order][1:] == h[order][:-1])[0]
    twin[order[same + 1]] = order[same]
    seen = verified(buf, at, row, twin, length)
    return row, pdf["lo"].to_numpy(np.int64)[row] + inner, h.view(np.int64), seen


def verified(buf: np.ndarray, at: np.ndarray, row: np.ndarray, twin: np.ndarray, length: int) -> np.ndarray:
    """Windows whose bytes are those of their twin. Behind a window that is, the next one of its row with the next twin has only one more byte to compare."""
    seen = twin >= 0
    follows = np.zeros(len(at), bool)
    follows[1:] = seen[1:] & seen[:-1] & (row[1:] == row[:-1]) & (twin[1:] == twin[:-1] + 1) & (at[twin[1:]] == at[twin[:-1]] + 1)
    windows = np.lib.stride_tricks.sliding_window_view(buf, length) if len(buf) >= length else buf

    def check(which: np.ndarray) -> bool:
        good = True
        for i in range(0, len(which), 1 << 15):  # slices bound memory
            part = which[i : i + (1 << 15)]
            ok = (windows[at[part]] == windows[at[twin[part]]]).all(axis=1)
            seen[part[~ok]] = False
            good &= bool(ok.all())
        return good

    first, rest = np.nonzero(seen & ~follows)[0], np.nonzero(follows)[0]
    end = length - 1
    if not check(first) or not (buf[at[rest] + end] == buf[at[twin[rest]] + end]).all():
        check(rest)  # a hash collision: nothing is taken on trust
    return seen


def spans_of(row: np.ndarray, start: np.ndarray, length: int):
    """Runs of window starts as (row, a, b)."""
    if not len(row):
        return row, start, start
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    i = np.nonzero(new)[0]
    last = np.concatenate([i[1:] - 1, [len(row) - 1]])
    return row[i], start[i], start[last] + length


def recurring(docs: DataFrame, length: int, gram: int, task_rows: int) -> DataFrame:
    """(id, k, at): documents' anchors whose hash recurs, with the salts that their number of rows asks for. A checkpoint."""
    found = anchor_rows(docs, length, gram)
    count = found.groupBy("h").agg(F.count("*").alias("n_rows")).where("n_rows > 1").select("h", F.ceil(F.col("n_rows") / task_rows).cast("int").alias("salts"))
    count = cut(count)  # a join side of its own, so that Spark can split the rows of a hot anchor
    return cut(found.join(count, "h").groupBy("id", "k").agg(F.collect_list(F.struct("lo", "n", "h", "salts")).alias("at")))


def bucket(n: int):
    """The task of a row, of n tasks. Salts come from the row's place, not its text alone: equal texts are spread, equal rows stay together."""
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id", "k", "lo"), F.col("salts"))).otherwise(F.lit(0))
    return F.pmod(F.xxhash64("h", salt), F.lit(n))


def compared(docs: DataFrame, again: DataFrame, length: int, gram: int, task_rows: int) -> DataFrame:
    """(id, k, a, b, w, g, open): spans that occurred before, and windows (open, with hashes w and g) that are still first within their salt. A table in the shared
    folder, in Parquet: a checkpoint's rows would take four times the room."""
    total = again.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    picked = docs.withColumnRenamed("id", "id1").withColumnRenamed("k", "k1").join(again, F.col("id1").eqNullSafe(F.col("id")) & (F.col("k1") == F.col("k")))
    ctx = contexts(picked.select("id", "k", "text", "at"), length, gram).withColumn("bucket", bucket(max(1, -(-total // task_rows))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "k", "lo"], na_position="first", kind="stable").drop_duplicates(["id", "k", "lo"]).reset_index(drop=True)
        row, start, h, seen = compare(pdf, length)
        r, a, b = spans_of(row[seen], start[seen], length)
        open_ = ~seen & (pdf["salts"].to_numpy()[row] > 1)
        who = np.concatenate([r, row[open_]])
        return pd.DataFrame(
            {
                "id": pdf["id"].iloc[who].array,
                "k": pdf["k"].iloc[who].array,
                "a": np.concatenate([a, start[open_]]),
                "b": np.concatenate([b, start[open_] + length]),
                "w": np.concatenate([np.zeros(len(r), np.int64), h[open_]]),
                "g": np.concatenate([np.zeros(len(r), np.int64), pdf["h"].to_numpy(np.int64)[row[open_]]]),
                "open": np.concatenate([np.zeros(len(r), bool), np.ones(int(open_.sum()), bool)]),
            }
        )

    kind = docs.schema["id"].dataType.simpleString()
    path = shared_path(docs.sparkSession, "repeats")
    ctx.groupBy("bucket").applyInPandas(run, f"id {kind}, k long, a long, b long, w long, g long, open boolean").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, task_rows: int = TASK_ROWS) -> DataFrame:
    """(id, k, spans) of documents (id, k, text) with repeated strings. Phases are functions, so that nothing here holds a finished phase's shuffle files."""
    spark = docs.sparkSession
    again = recurring(docs, length, gram, task_rows)
    release(spark)
    out = compared(docs, again, length, gram, task_rows)
    del again
    release(spark)
    spans = out.where(~F.col("open")).select("id", "k", "a", "b")
    later = out.where("open")
    if not later.isEmpty():
        here = F.struct("id", "k", "a")
        first = later.groupBy("w", "g").agg(F.min(here).alias("first"), F.max(here).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("w", "g", "first")
        spans = spans.unionByName(later.join(first, ["w", "g"]).where(~here.eqNullSafe(F.col("first"))).select("id", "k", "a", "b"))
    return spans.groupBy("id", "k").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def release(spark) -> None:
    """Let Spark delete the shuffle files of finished phases now; else they stay until the driver happens to collect its garbage.

    What the first collection frees holds what the second one does, and Spark deletes in the background."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def cut_out(text: str | None, spans) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs, what is left. Spans are sorted (a, b)."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    kept, end, removed, runs = [], 0, 0, 0
    low = None
    for a, b in spans or ():
        if low is None or a > end:
            if low is not None:
                removed += end - low
            kept.append(data[end if low is not None else 0 : a])
            low, end, runs = a, b, runs + 1
        else:
            end = max(end, b)
    if low is not None:
        removed += end - low
    kept.append(data[end:])
    return len(data), removed, runs, b"".join(kept)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, task_rows: int = TASK_ROWS, digest: bool = False) -> DataFrame:
    """Return id, n_bytes, n_removed, n_spans, and kept (binary), or with `digest` kept_sha256, for every row of `docs`."""
    at = keyed(docs, id_col, text_col)
    spans = repeats(at, length=length, gram=gram, task_rows=task_rows).withColumnRenamed("id", "id2").withColumnRenamed("k", "k2")
    both = at.join(spans, F.col("id").eqNullSafe(F.col("id2")) & (F.col("k") == F.col("k2")), "left").select("id", "text", "spans")

    def run(batches):
        for b in batches:
            texts, lists = b.column(1).to_pylist(), b.column(2)
            inner = lists.flatten()
            a, z = (inner.field(c).to_numpy().tolist() if len(inner) else [] for c in ("a", "b"))
            size, i, out = lists.value_lengths().fill_null(0).to_pylist(), 0, []
            for t, n in zip(texts, size):
                out.append(cut_out(t, list(zip(a[i : i + n], z[i : i + n]))))
                i += n
            last = pa.array([hashlib.sha256(o[3]).hexdigest() for o in out]) if digest else pa.array([o[3] for o in out], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[c] for o in out], pa.int64()) for c in range(3)], last], ["id", "n_bytes", "n_removed", "n_spans", "last"])

    kind = at.schema["id"].dataType.simpleString()
    name = "kept_sha256" if digest else "kept"
    res = both.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, last {'string' if digest else 'binary'}")
    return res.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("last").alias(name))
