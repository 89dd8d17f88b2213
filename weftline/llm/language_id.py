"""Language identification by a linear-chain conditional random field over words.

Words are labelled with languages. A word's emission scores come from hashed features: its affixes of 1 to 3 letters, its letter 2- and 3-grams,
and the word itself if the lexicon (words seen in several training texts) has it. Transitions and start scores are learned with them by
gradients of forward-backward. Sequences are the words of a line; longer runs
of letters than REACH, as in scripts without spaces, count as several words. A text's language is the one with the highest mean
posterior over its words, which is also its score, so code-switched text goes to the language of most of its words; `Model.tag` gives the label
of each word.

Training takes a bounded, documented sample: of each language the texts of least id hash outside the held-out fifth, at most `per_lang`, fewer where SAMPLE of
all languages is reached, and at most LANG_BYTES of them, fewer where SAMPLE_BYTES of all languages is reached (one at least). No language is left out. Every word carries its text's language; one line
in MIXED is joined with one of another text, so that switches within a line are learned from. Null texts and texts without a letter are `und` with score 0, as is everything if no language was learned. Null ids are predicted, never
learned from. Repeated rows get equal results. Empty tables give empty tables.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_bytes, held_out, map_texts, per_process, workers

BITS = 16
PER_LANG = 256
#: Texts of all languages together.
SAMPLE = 65_536
#: Bytes of a language's texts, and of all languages' together.
LANG_BYTES = 4 << 20
SAMPLE_BYTES = 64 << 20
#: Weights of all languages together; many languages get fewer weights each.
WEIGHTS = 1 << 23
MIXED = 4
#: Words of a batch of lines, padded to the longest.
CELLS = 1 << 18
EPOCHS = 2
BATCH = 64
RATE = 0.4
LEXICON = 20_000
#: Letters of a chain element; a longer run of letters is cut into elements that overlap by two, so that no n-gram is lost.
REACH = 24
CHUNK = 4_000_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SCHEMA = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def pieces(word: str) -> list[str]:
    """The whole word, in elements of at most REACH letters."""
    if len(word) <= REACH:
        return [word]
    return [word[i : i + REACH] for i in range(0, len(word) - 2, REACH - 2)]


def chains(text: str | None) -> list[list[str]]:
    """The words of every line."""
    lines = ([x for w in WORD.findall(line) for x in pieces(w)] for line in (text or "").lower().split("\n"))
    return [words for words in lines if words]


def batches(size: np.ndarray):
    """Ranges of chains, longest first, with at most CELLS words when padded; a longer chain is alone."""
    a = 0
    while a < len(size):
        b = min(len(size), a + max(1, CELLS // int(size[a])))
        yield a, b
        a = b


def word_features(words: list[str], lexicon: dict[str, int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of distinct words, feature as a number below 1 << bits."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    width = int(size.max()) + 2
    codes = np.zeros((n, width), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.arange(width)[None, :]
    codes[(at >= 1) & (at <= size[:, None])] = flat + 2
    codes[:, 0] = 1
    codes[np.arange(n), size + 1] = 1
    k = np.uint64(0x100000001B3)
    two = codes[:, :-1] * k + codes[:, 1:]
    three = two[:, :-1] * k + codes[:, 2:]
    rows, feats = [], []

    def add(r, h, salt):
        h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append(r)
        feats.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64))

    r = np.arange(n)
    i, j = np.nonzero(np.arange(width - 1)[None, :] < (size + 1)[:, None])
    add(i, two[i, j], 11)
    i, j = np.nonzero(np.arange(width - 2)[None, :] < size[:, None])
    add(i, three[i, j], 12)
    for a in (1, 2, 3):  # affixes; a rim mark stands before and after the word
        long = size >= a
        head = tail = np.zeros(int(long.sum()), np.uint64)
        for b in range(a):
            head = head * k + codes[r[long], 1 + b]
            tail = tail * k + codes[r[long], size[long] - b]
        add(r[long], head, 20 + a)
        add(r[long], tail, 30 + a)
    known = [(x, lexicon[w]) for x, w in enumerate(words) if w in lexicon]
    if known:
        x, f = np.array(known, np.int64).T
        add(x, f.astype(np.uint64), 40)
    return np.concatenate(rows), np.concatenate(feats)


def forward_backward(e: np.ndarray, size: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Posteriors of chains. e: (chains, steps, labels), chains of `size` words, longest first. Scaled in the linear domain."""
    n, steps, labels = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    m = np.exp(move - move.max())
    f = np.zeros_like(p)
    scale = np.ones((n, steps))
    f[:, 0] = np.exp(start - start.max()) * p[:, 0]
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps + 1)]  # chains with over t words
    for t in range(steps):
        a = live[t]
        if t:
            f[:a, t] = (f[:a, t - 1] @ m) * p[:a, t]
        s = f[:a, t].sum(axis=1)
        scale[:a, t] = s
        f[:a, t] /= s[:, None]
    b = np.ones_like(p)
    for t in range(steps - 2, -1, -1):
        a = live[t + 1]
        x = (b[:a, t + 1] * p[:a, t + 1]) @ m.T
        b[:a, t] = x / scale[:a, t + 1, None]
    post = f * b
    mask = np.arange(steps)[None, :] < size[:, None]
    post = np.where(mask[:, :, None], post / np.maximum(post.sum(axis=2, keepdims=True), 1e-300), 0.0)
    if not pairs:
        return post, None
    both = np.zeros((labels, labels))
    for t in range(1, steps):
        a = live[t]
        x = b[:a, t] * p[:a, t] / scale[:a, t, None]
        both += m * np.einsum("ni,nj->ij", f[:a, t - 1], x)
    return post, both


class Model:
    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        self.langs, self.lexicon = langs, lexicon
        k = len(langs)
        self.bits = min(BITS, max(8, (WEIGHTS // max(1, k)).bit_length() - 1))
        self.w = np.zeros((1 << self.bits, k), np.float32)
        self.start, self.move = np.zeros(k), np.zeros((k, k))

    def words(self, seqs: list[list[str]]):
        """Chains in order, longest first, their words as numbers, and the emissions of distinct words with what is needed to go back."""
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        size = np.array([len(seqs[i]) for i in order])
        coded = pa.array([w for i in order for w in seqs[i]], pa.string()).dictionary_encode()
        rows, feats = word_features(coded.dictionary.to_pylist(), self.lexicon, self.bits)
        n = len(coded.dictionary)
        count = np.bincount(rows, minlength=n)[:, None]
        emit = np.stack([np.bincount(rows, self.w[feats, c], n) for c in range(len(self.langs))], axis=1) / np.sqrt(count)
        return order, size, coded.indices.to_numpy(), emit, rows, feats, count

    def posteriors(self, size: np.ndarray, ids: np.ndarray, emit: np.ndarray, pairs: bool = False):
        """(first chain, last chain, first word, last word, mask, posteriors, expected transitions) of batches of chains."""
        ends = np.concatenate([[0], np.cumsum(size)])
        for a, b in batches(size):
            where = np.arange(int(size[a]))[None, :] < size[a:b, None]
            e = np.zeros((b - a, int(size[a]), len(self.langs)))
            e[where] = emit[ids[ends[a] : ends[b]]]
            post, both = forward_backward(e, size[a:b], self.start, self.move, pairs)
            yield a, b, int(ends[a]), int(ends[b]), where, post, both

    def train(self, texts: list[tuple[list[list[str]], int]]) -> None:
        k, width = len(self.langs), 1 << self.bits
        g2 = np.full((width, k), 1e-6)
        m2, s2 = np.full((k, k), 1e-6), np.full(k, 1e-6)
        rng = np.random.default_rng(7)
        for _ in range(EPOCHS):
            shuffled = rng.permutation(len(texts))
            for at in range(0, len(texts), BATCH):
                seqs, gold = [], []
                for i in shuffled[at : at + BATCH]:
                    for line in texts[i][0]:
                        if gold and len(gold) % MIXED == 0 and gold[-1][0] == gold[-1][-1] != texts[i][1]:
                            seqs[-1], gold[-1] = seqs[-1] + line, gold[-1] + [texts[i][1]] * len(line)
                        else:
                            seqs.append(line)
                            gold.append([texts[i][1]] * len(line))
                if not seqs:
                    continue
                order, size, ids, emit, rows, feats, count = self.words(seqs)
                y = np.array([c for i in order for c in gold[i]])
                words = len(y)
                by_word = np.zeros((len(count), k))
                gm, gs = np.zeros((k, k)), np.zeros(k)
                for a, b, lo, hi, where, post, both in self.posteriors(size, ids, emit, True):
                    diff = post[where]
                    diff[np.arange(hi - lo), y[lo:hi]] -= 1.0
                    by_word += np.stack([np.bincount(ids[lo:hi], diff[:, c], len(count)) for c in range(k)], axis=1)
                    gm += both
                    gs += post[:, 0].sum(axis=0)
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                inner = np.ones(words, bool)
                inner[first] = False
                after = np.nonzero(inner)[0]
                np.subtract.at(gm, (y[after - 1], y[after]), 1.0)
                np.subtract.at(gs, y[first], 1.0)
                by_word = by_word / np.sqrt(count) / words
                g = np.stack([np.bincount(feats, by_word[rows, c], width) for c in range(k)], axis=1)
                g2 += g * g
                self.w -= (RATE * g / np.sqrt(g2)).astype(np.float32)
                gm = gm / words + 1e-4 * self.move
                m2 += gm * gm
                self.move -= 0.1 * gm / np.sqrt(m2)
                gs = gs / len(size) + 1e-4 * self.start
                s2 += gs * gs
                self.start -= 0.1 * gs / np.sqrt(s2)

    def tag(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, language, posterior) of every word, in order; words lower-cased."""
        seqs = chains(text)
        if not seqs or not self.langs:
            return []
        order, size, ids, emit, *_ = self.words(seqs)
        out = [None] * len(seqs)
        for a, b, _, _, _, post, _ in self.posteriors(size, ids, emit):
            for i in range(a, b):
                p = post[i - a, : size[i]]
                out[order[i]] = [(w, self.langs[c], float(x[c])) for w, c, x in zip(seqs[order[i]], p.argmax(axis=1), p)]
        return [t for line in out for t in line]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        seqs, owner = [], []
        for i, t in enumerate(texts):
            c = chains(t)
            seqs += c
            owner += [i] * len(c)
        if not seqs or not self.langs:
            return [("und", 0.0)] * len(texts)
        order, size, ids, emit, *_ = self.words(seqs)
        own = np.array(owner)[order]
        k = len(self.langs)
        total, words = np.zeros((len(texts), k)), np.zeros(len(texts))
        np.add.at(words, own, size)
        for a, b, _, _, _, post, _ in self.posteriors(size, ids, emit):
            np.add.at(total, own[a:b], post.sum(axis=1))
        out = []
        for i in range(len(texts)):
            if not words[i]:
                out.append(("und", 0.0))
                continue
            c = int(total[i].argmax())
            out.append((self.langs[c], min(1.0, float(total[i, c] / words[i]))))
        return out


def fit(docs: DataFrame, *, per_lang: int = PER_LANG, lang_col: str = "lang") -> Model:
    """A model learned from a bounded sample, in one task."""
    workers(docs.sparkSession)
    known = docs.where(docs[lang_col].isNotNull() & docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"]))
    keys = known.select(docs["doc_id"].alias("id"), docs[lang_col].alias("lang"), F.octet_length(docs["text"]).alias("size")).withColumn("h", F.xxhash64("id"))
    n = keys.agg(F.count_distinct("lang")).first()[0]
    most = max(1, min(per_lang, SAMPLE // max(1, n)))
    by_lang = Window.partitionBy("lang").orderBy("h", "id")
    chosen = keys.withColumn("r", F.row_number().over(by_lang)).where(F.col("r") <= most)
    total = F.sum(F.coalesce("size", F.lit(0))).over(by_lang.rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("total", total).where((F.col("total") <= min(LANG_BYTES, SAMPLE_BYTES // max(1, n))) | (F.col("r") == 1)).select("id", "lang").distinct()
    texts = docs.select(docs["doc_id"].alias("id"), docs[lang_col].alias("lang"), docs["text"].alias("text"))
    rows = texts.join(F.broadcast(chosen), ["id", "lang"]).dropDuplicates(["id", "lang", "text"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lang", "id", "text"])
        langs = sorted(pdf["lang"].unique())
        index = {x: i for i, x in enumerate(langs)}
        seen = Counter()
        data = []
        for text, lang in zip(pdf["text"], pdf["lang"]):
            c = chains(text)
            seen.update({w for s in c for w in s})
            data.append((c, index[lang]))
        often = sorted(((-n, w) for w, n in seen.items() if n >= 3))[:LEXICON]
        model = Model(langs, {w: i for i, (_, w) in enumerate(often)})
        model.train(data)
        return pd.DataFrame({"m": [pickle.dumps((langs, model.lexicon, model.w, model.start, model.move))]})

    got = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "m binary").collect()
    return load(got[0]["m"]) if got else Model([], {})


def load(blob: bytes) -> Model:
    langs, lexicon, w, start, move = pickle.loads(blob)
    model = Model(langs, lexicon)
    model.w, model.start, model.move = w, start, move
    return model


def identify(docs: DataFrame, *, per_lang: int = PER_LANG, lang_col: str = "lang") -> DataFrame:
    """Return doc_id, held_out, lang_pred, score for every row of `docs`."""
    model = fit(docs, per_lang=per_lang, lang_col=lang_col)
    blob = pickle.dumps((model.langs, model.lexicon, model.w, model.start, model.move))
    shared = broadcast_bytes(docs.sparkSession, blob, "the model")
    key = hash(blob)

    def run(texts):
        model = per_process(("crf", key), lambda: load(shared.value))
        found, part, size = [], [], 0
        for t in texts:  # texts go together up to a bounded number of characters
            if part and size + len(t or "") > CHUNK:
                found += model.predict(part)
                part, size = [], 0
            part.append(t)
            size += len(t or "")
        found += model.predict(part)
        return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    out = map_texts(docs, run, SCHEMA, "lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
