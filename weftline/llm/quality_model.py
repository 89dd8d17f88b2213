"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are n-grams of two views of the words: the words as they are (1- and 2-grams) and their shapes (1- to 3-grams). A shape tells the
cases of letters, digits and the punctuation at the end, and whether the word repeats one of the two before it. Counts are hashed to a fixed number
of weights and divided by their total, so long and short texts weigh alike. A score is the sparse dot product through a sigmoid.

Training takes a bounded, documented sample: of labelled rows outside the held-out fifth the `sample` ones of least id hash, and of these as many as hold
SAMPLE_BYTES of text. Only their labels
and texts are learned from. Null and empty texts have the bias alone. Null ids are scored, never learned from; several labels of one id count by
majority (ties as 1). Repeated rows get equal scores. Without labels every score is 0.5. Empty tables give empty tables.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_bytes, held_out, map_texts, per_process, workers

BITS = 18
SAMPLE = 4096
SAMPLE_BYTES = 64 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
SCALE = 8.0
THRESHOLD = 0.3
MEMO = 200_000
SCHEMA = pa.schema([("score", pa.float64())])
_FOLD = [(re.compile(p), s) for p, s in ((r"[^\W\d_a-zà-öø-ÿœß]+", "A"), (r"[a-zà-öø-ÿœß]+", "a"), (r"\d+", "0"), (r"\s+", "_"))]


def shape(word: str) -> str:
    for p, s in _FOLD:
        word = p.sub(s, word)
    return word


class Words(dict):
    """word -> hash of the word << 32 | hash of its shape."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        v = crc32(word.encode("utf-8", "surrogatepass")) << 31 | crc32(shape(word).encode("utf-8", "surrogatepass")) >> 1
        if len(word) < 64:
            self[word] = v
        return v


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None, memo: Words) -> np.ndarray:
    """Weight numbers of all n-grams, repeats included; number 0 is the bias's and never a feature's."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(memo.__getitem__, words), np.int64, len(words)).view(np.uint64)
    w, s = both >> np.uint64(31), both & np.uint64(0x7FFFFFFF)
    s = s.copy()
    same = w[1:] == w[:-1]
    again = w[2:] == w[:-2]
    s[1:][same] = 1
    s[2:][again & ~same[1:]] = 2
    k1, k2 = np.uint64(1_000_003), np.uint64(998_244_353)
    parts = [mix(w, 1), mix(w[:-1] * k1 + w[1:], 2), mix(s, 3), mix(s[:-1] * k1 + s[1:], 4), mix(s[:-2] * k2 + s[1:-1] * k1 + s[2:], 5)]
    return np.maximum(np.concatenate(parts), 1)


def train(rows: list[tuple[str | None, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over the rows, in the order given."""
    size = 1 << BITS
    z, n, memo = np.zeros(size), np.zeros(size), Words()
    data = []
    for text, y in rows:
        i, c = np.unique(features(text, memo), return_counts=True)
        data.append((np.append(i, 0), np.append(c * (SCALE / max(1, c.sum())), 1.0), y))

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, y in data:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g2
    return weights(np.arange(size)).astype(np.float32)


def score(text: str | None, w: np.ndarray, memo: Words) -> float:
    i = features(text, memo)
    dot = float(w[0]) + (SCALE * float(w[i].mean(dtype=np.float64)) if len(i) else 0.0)
    return 1 / (1 + np.exp(-min(35.0, max(-35.0, dot))))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, label_col: str = "quality") -> np.ndarray:
    """Weights learned from a bounded sample, in one task."""
    workers(docs.sparkSession)
    marked = labels.where(labels[label_col].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    y = (F.avg(labels[label_col]) >= 0.5).cast("int")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = marked.groupBy(labels["doc_id"].alias("id")).agg(y.alias("y")).orderBy(*order).limit(sample)
    texts = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").orderBy(*order, "text").limit(sample)
    upto = Window.orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, 0)  # over `sample` rows at most
    total = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(upto)
    rows = rows.withColumn("total", total).where((F.col("total") <= SAMPLE_BYTES) | (F.col("total") == F.octet_length("text"))).drop("total")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id", "text"])
        w = train(list(zip(pdf["text"], pdf["y"].astype(int))))
        return pd.DataFrame({"w": [w.tobytes()]})

    got = rows.withColumn("h", F.xxhash64("id")).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "w binary").collect()
    return np.frombuffer(got[0]["w"], np.float32) if got else np.zeros(1 << BITS, np.float32)


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, label_col: str = "quality") -> DataFrame:
    """Return doc_id, held_out, score, predicted for every row of `docs`."""
    shared = broadcast_bytes(docs.sparkSession, fit(docs, labels, sample=sample, label_col=label_col).tobytes(), "the weights")

    def run(texts):
        w = np.frombuffer(shared.value, np.float32)
        memo = per_process("quality words", Words)
        return {"score": [score(t, w, memo) for t in texts]}

    out = map_texts(docs, run, SCHEMA, "score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
