"""Byte-level BPE encoding and decoding by monoid tree reduction.

A pre-token is split in halves down to single bytes, whose encodings are their own tokens; two neighbours are joined by
re-encoding a window across their boundary. The window starts with the two tokens at the boundary and grows by doubling until both of
its rims are stable: a token sequence is the byte-pair encoding of its bytes exactly if every two adjacent tokens are the encoding of
their own bytes, so once the pairs at both rims pass that test no token outside the window can change. The joined sequences form
a monoid, so the encodings of short halves are remembered and used again wherever the same bytes come up; the texts' sequences are
concatenated up the tree, and decoding concatenates bytes up the tree.

Null texts are empty (no ids). Repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import broadcast_bytes, map_texts, per_process

#: Distinct pre-tokens remembered in a worker; the memo is emptied when full, which changes no result.
MEMO = 200_000
#: Halves of at most so many bytes are remembered, too.
HALF = 16
#: Windows of more bytes are merged by a heap.
LONG = 128
SCHEMA = pa.schema([("token_ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
DIGEST = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def unicode_space(pattern: str) -> str:
    r"""`\s` and `\S` as the White_Space property, as the tokenizer libraries read them."""
    return pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class Codec:
    def __init__(self, blob: bytes, pattern: str, memo: int = MEMO):
        self.ranks = {base64.b64decode(a): int(r) for a, r in map(bytes.split, blob.splitlines())}
        self.tokens = {r: b for b, r in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        # what two adjacent ids merge to, keyed a << 20 | b; an id is its rank
        get = self.ranks.get
        self.made = {a << 20 | c: r for b, r in self.ranks.items() for i in range(1, len(b)) if (a := get(b[:i])) is not None and (c := get(b[i:])) is not None}
        self.split = regex.compile(unicode_space(pattern))
        self.memo: dict[str, tuple[int, ...]] = {}
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[int, tuple[int, ...]] = {}
        self.size = memo

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Re-encode a window: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        if len(data) > LONG:
            return self.merge_long(data)
        get, none, first = self.made.get, 1 << 60, self.bytes
        ids = [first[b] for b in data]
        cost = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while cost:
            low = min(cost)
            if low == none:
                break
            i = cost.index(low)
            ids[i] = low
            del ids[i + 1], cost[i]
            if i < len(cost):
                cost[i] = get(low << 20 | ids[i + 1], none)
            if i:
                cost[i - 1] = get(ids[i - 1] << 20 | low, none)
        return tuple(ids)

    def merge_long(self, data: bytes) -> tuple[int, ...]:
        """As `merge`, with the open pairs in a heap, so that windows of long runs take no quadratic time."""
        get, first, n = self.made.get, self.bytes, len(data)
        ids = [first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != r:
                continue  # one side has merged since
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := get(r << 20 | ids[k])) is not None:
                    heappush(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := get(ids[h] << 20 | r)) is not None:
                heappush(heap, (x, h))
        return tuple(x for x in ids if x >= 0)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two adjacent tokens' bytes; the tokens are stable beside each other if it is just them."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.size:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.tokens[a] + self.tokens[b])
        return known

    def fits(self, a: int, b: int) -> bool:
        return self.pair(a, b) == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's product."""
        if not left or not right:
            return left + right
        inner = self.pair(left[-1], right[0])
        if inner == (left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            low = i == len(left) or self.fits(left[-i - 1], inner[0])
            high = j == len(right) or self.fits(inner[-1], right[j])
            if low and high:
                return left[: len(left) - i] + inner + right[j:]
            i, j = min(i if low else 2 * i, len(left)), min(j if high else 2 * j, len(right))
            inner = self.merge(b"".join(map(self.tokens.__getitem__, left[len(left) - i :] + right[:j])))

    def tree(self, data: bytes) -> tuple[int, ...]:
        """Reduce a pre-token by halves; the depth is the logarithm of its length."""
        n = len(data)
        if n < 2:
            return (self.bytes[data[0]],) if n else ()
        known = self.halves.get(data)
        if known is None:
            known = self.join(self.tree(data[: n // 2]), self.tree(data[n // 2 :]))
            if n <= HALF:
                if len(self.halves) >= self.size:
                    self.halves.clear()
                self.halves[data] = known
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.tree(data)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        memo, extend = self.memo, out.extend
        for p in self.split.findall(text or ""):
            ids = memo.get(p)
            if ids is None:
                if len(memo) >= self.size:
                    memo.clear()
                ids = self.piece(p)
                if len(p) < 64:
                    memo[p] = ids
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Concatenate token bytes up the tree."""
        level = [b"".join(map(self.tokens.__getitem__, ids[i : i + 256])) for i in range(0, len(ids), 256)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def _codec(docs: DataFrame, path: str, pattern: str):
    with open(path, "rb") as f:
        shared = broadcast_bytes(docs.sparkSession, f.read(), path)
    return lambda: per_process(("codec", path, pattern), lambda: Codec(shared.value, pattern))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, token_ids, decoded (the bytes that the ids stand for) for every row of `docs`."""
    codec = _codec(docs, ranks_path, pattern)

    def run(texts):
        ids = [codec().encode(t) for t in texts]
        return {"token_ids": ids, "decoded": [codec().decode(x) for x in ids]}

    return map_texts(docs, run, SCHEMA, "token_ids array<int>, decoded binary", keep=(id_col,), text_col=text_col)


def encode_digest(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode_decode`, with digests in place of ids and bytes: what leaves a worker is a few bytes a text."""
    codec = _codec(docs, ranks_path, pattern)

    def run(texts):
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts:
            ids = codec().encode(t)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec().decode(ids)).hexdigest())
        return out

    return map_texts(docs, run, DIGEST, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep=(id_col,), text_col=text_col)
