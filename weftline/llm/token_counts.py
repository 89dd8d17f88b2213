"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as a doubly linked list of byte symbols. A heap holds the adjacent pairs that some merge
joins; the lowest rank (leftmost on ties) is popped again and again. A merge unlinks one symbol, so the count is
the number of initial symbols minus the number of merges; no identifiers are emitted.

Null texts count as empty (0 tokens). Repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import broadcast_bytes, map_texts, per_process

#: Distinct pre-tokens remembered in a worker; the memo is emptied when full, which changes no result.
MEMO = 400_000
#: `\s` as the White_Space property: Python's own class also holds U+001C to U+001F.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SCHEMA = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def byte_symbols() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes are themselves, others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Counter:
    """Counts tokens as a byte-level BPE file of the `tokenizers` format gives them."""

    def __init__(self, blob: bytes, memo: int = MEMO):
        spec = json.loads(blob)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are supported")
        changed = [k for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        changed += [f"{k} of {t['content']!r}" for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
        vocab = model["vocab"]
        if len(vocab) >= 1 << 20 or max(vocab.values(), default=0) >= 1 << 20:
            changed.append("ids of 2^20 and more")
        if changed:
            raise ValueError(f"the file changes how tokens are counted: {', '.join(changed)}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.first = [vocab[s] for _, s in sorted(byte_symbols().items())]
        # a pair is keyed a << 20 | b; the rank finds the pair and what it makes
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.sides = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.split = regex.compile(SPLIT)
        self.memo: dict[str, int] = {}
        self.size = memo

    def piece(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(data)
        if n < 2:
            return n
        rank, sides, first = self.rank.get, self.sides, self.first
        sym = [first[b] for b in data]
        # an entry is rank << 32 | position, so the heap compares plain integers
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(sym[i] << 20 | sym[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        count = n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            a, b, made = sides[top >> 32]
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one side has merged since
            sym[i], sym[j] = made, -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := rank(made << 20 | sym[k])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(sym[h] << 20 | made)) is not None:
                heappush(heap, r << 32 | h)
        return count

    def plain(self, text: str) -> int:
        memo, total = self.memo, 0
        for p in self.split.findall(text):
            c = memo.get(p)
            if c is None:
                if len(memo) >= self.size:
                    memo.clear()
                c = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) < 64:
                    memo[p] = c
            total += c
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        parts = self.cut.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def count_tokens(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, n_bytes (UTF-8), n_tokens for every row of `docs`."""
    with open(vocabulary_path, "rb") as f:
        shared = broadcast_bytes(docs.sparkSession, f.read(), vocabulary_path)

    def run(texts):
        counter = per_process(("counter", vocabulary_path), lambda: Counter(shared.value))
        return {"n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": [counter.count(t) for t in texts]}

    return map_texts(docs, run, SCHEMA, "n_bytes long, n_tokens long", keep=(id_col,), text_col=text_col)
