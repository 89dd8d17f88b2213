"""Models are injected. What is here are interfaces, and stand-ins that need no model."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..sources import schemas


class Embedding(Protocol):
    def encode(self, text: Column) -> Column:
        """ARRAY<DOUBLE> of norm 1; null and empty texts count as ''."""


class LanguageModel(Protocol):
    def enrich(self, prompts: DataFrame, context: DataFrame | None) -> DataFrame:
        """(prompt_id, reply): the model's raw reply to each prompt."""


class Tagger(Protocol):
    def analyse(self, prompts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Actions (prompt_id, ordinal, text, lemma, token_index), entities (prompt_id, ordinal, text, root, token_index), relations (prompt_id, seq, source, target, relation)."""


class HashEmbedding:
    """Counts of hashed tokens, of norm 1. For tests; its scores mean nothing beside a model's."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, text: Column) -> Column:
        slots = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), F.lit(self.size)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
        return F.get(F.transform(F.array(counts), lambda c: F.get(F.transform(F.array(V.norm(c)), lambda n: F.transform(c, lambda x: F.when(n == 0, 0.0).otherwise(F.try_divide(x, n)))), F.lit(0))), F.lit(0))


class CannedModel:
    """Replies from a table (text, reply)."""

    def __init__(self, replies: DataFrame):
        self.replies = replies

    def enrich(self, prompts: DataFrame, context: DataFrame | None = None) -> DataFrame:
        return prompts.join(self.replies, "text").select("prompt_id", "reply")


#: What a reply must hold, as told to a model.
CONTRACT = (
    "Answer with one JSON object and nothing else: intent (string), explicit_steps and inferred_steps (lists of objects with text and reason), "
    "dependencies (list of objects with before and after, texts of steps). Keep the wording of explicit steps; infer only steps that the domain supports."
)


def merge_replies(replies: list[str]) -> str:
    """One reply for several: the first intent, and all steps and dependencies in order. A single reply stays as it is."""
    if len(replies) == 1:
        return replies[0]
    found = []
    for r in replies:
        low, high = r.find("{"), r.rfind("}")
        if low < 0 or high < low:
            raise ValueError("the reply holds no JSON object")
        found.append(json.loads(r[low : high + 1]))
    out = {"intent": next((x["intent"] for x in found if x.get("intent")), None)}
    for c in ("explicit_steps", "inferred_steps", "dependencies"):
        every = [e for x in found for e in x.get(c) or []]
        out[c] = [e for i, e in enumerate(every) if e not in every[:i]]
    return json.dumps(out)


class HostedModel:
    """Any chat endpoint behind `call(system, user, max_tokens, temperature) -> str`, asked from the executors.

    All of the context is sent, in order, in blocks of `context_rows` rows: one call for each prompt and block. Replies of several blocks are merged."""

    def __init__(self, call, token: str | None, max_tokens: int = 1000, temperature: float = 0.1, context_rows: int = 200):
        if not token:
            raise RuntimeError("a model token is needed")
        self.call, self.max_tokens, self.temperature, self.context_rows = call, max_tokens, temperature, context_rows

    def enrich(self, prompts: DataFrame, context: DataFrame | None = None) -> DataFrame:
        rows = [] if context is None else context.orderBy(*context.columns).toJSON().collect()
        known = ["" if context is None else "\nKnown concepts:\n" + "\n".join(rows[i : i + self.context_rows]) for i in range(0, max(1, len(rows)), self.context_rows)]
        call, limit, temperature = self.call, self.max_tokens, self.temperature

        def ask(parts):
            for pdf in parts:
                yield pdf[["prompt_id"]].assign(reply=[merge_replies([call(CONTRACT, f"{t}{k}", limit, temperature) for k in known]) for t in pdf["text"]])

        kind = prompts.schema["prompt_id"].dataType.simpleString()
        return prompts.select("prompt_id", "text").mapInPandas(ask, f"prompt_id {kind}, reply string")


def fill_embeddings(nodes: DataFrame, embedding: Embedding) -> DataFrame:
    """Stored vectors stay; others are encoded from the node's text."""
    text = X.node_text_client(*[F.col(c) for c in ("name", "description", "id", "aliases", "types")])
    return nodes.withColumn("embedding", F.when(V.present(F.col("embedding")), V.doubles(F.col("embedding"))).otherwise(embedding.encode(text)))


def parse_replies(replies: DataFrame) -> DataFrame:
    """Replies to (prompt_id, intent, explicit_steps, inferred_steps, dependencies); what is no JSON object is an error."""
    good = X.recover_json(F.col("reply"))
    return replies.select("prompt_id", F.from_json(F.coalesce(good, F.raise_error(F.lit("the reply holds no JSON object"))), schemas.INTERPRETATION).alias("r")).select("prompt_id", "r.*")
