"""Models behind the interfaces. Each takes `load`, which returns the model's function and runs where the rows are, once in each Python worker.

`load` is pickled by reference or value, never the model. Nothing here imports a model library unless it is asked for by name."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.triplets import triplets
from ..lineage import cut
from .providers import HashEmbedding


def unit(vector) -> list[float]:
    v = [float(x) for x in vector]
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


@lru_cache(2)
def sentence_model(name: str) -> Callable[[list[str]], list]:
    """An encoder of the sentence-transformers library, by its public name or path."""
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name).encode


class ModelEmbedding:
    """Vectors of norm 1 from `load() -> encode(list of texts)`; null and empty texts count as ''. Texts go in Arrow batches."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list]]):
        self.load = load

    def encode(self, text: Column) -> Column:
        load = self.load

        @F.pandas_udf("array<double>")
        def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for texts in parts:
                yield pd.Series([unit(v) for v in encode(texts.fillna("").tolist())], dtype=object)

        return vectors(text)


def embedding_of(name: str):
    """`hash-64` (any size) is the stand-in without a model; any other name is a sentence-transformers model."""
    kind, _, size = name.partition("-")
    return HashEmbedding(int(size)) if kind == "hash" and size.isdigit() else ModelEmbedding(partial(sentence_model, name))


@lru_cache(2)
def seq2seq_model(name: str, read: int = 256, write: int = 128, beams: int = 2) -> Callable[[str], str]:
    """A relation extractor of the transformers library: text to its marked output, of `read` and `write` tokens at most."""
    import torch
    from transformers import AutoModelForSeq2SeqLM, AutoTokenizer

    device = "cuda" if torch.cuda.is_available() else "cpu"
    tokenizer, model = AutoTokenizer.from_pretrained(name), AutoModelForSeq2SeqLM.from_pretrained(name).to(device).eval()

    def generate(text: str) -> str:
        with torch.no_grad():
            out = model.generate(**tokenizer(text, return_tensors="pt", max_length=read, truncation=True).to(device), max_length=write, num_beams=beams, length_penalty=0)
        return tokenizer.decode(out[0], skip_special_tokens=False)

    return generate


class RelationExtractor:
    """(prompt_id, seq, subject, relation, object) from `load() -> generate(text)`. Blank texts have no triplets; without `load` there are none at all, and nothing is loaded."""

    def __init__(self, load: Callable[[], Callable[[str], str]] | None):
        self.load = load

    def extract(self, prompts: DataFrame) -> DataFrame:
        said = prompts.select("prompt_id", "text").where(F.trim(F.coalesce("text", F.lit(""))) != "")
        if self.load is None:
            said, load = said.where("false"), None
        else:
            load = self.load

        def decode(parts):
            generate = None
            for pdf in parts:
                generate = generate or load()
                yield pdf[["prompt_id"]].assign(decoded=[generate(t) for t in pdf["text"]])

        kind = prompts.schema["prompt_id"].dataType.simpleString()
        out = said.mapInPandas(decode, f"prompt_id {kind}, decoded string")
        return out.select("prompt_id", F.posexplode(triplets(F.col("decoded"))).alias("seq", "t")).select("prompt_id", "seq", "t.*")


@lru_cache(2)
def spacy_model(name: str = "en_core_web_sm"):
    import spacy

    return spacy.load(name)


def read_text(nlp, text: str) -> dict[str, list]:
    """Actions, entities and relations of one text, by a parser whose documents have tokens, sentences (sents) and noun_chunks.

    Actions are verbs, nouns behind `after that` or `before that`, and a noun that opens a sentence if it turns to a verb behind `Please`.
    `before` and `after` relate the first verb under their head to the nearest verb above; consecutive actions are in sequence."""
    doc = nlp(text or "")
    tokens = list(doc)
    commands = {}
    for first, words in ((s[0], s.text) for s in doc.sents):
        if first.pos_ in ("NOUN", "PROPN"):
            polite = list(nlp(f"Please {words}"))[1:2]
            if polite and polite[0].pos_ == "VERB":
                commands[first.i] = polite[0].lemma_
    low = [t.text.lower() for t in tokens]
    actions = []
    for t in tokens:
        behind = t.pos_ == "NOUN" and low[max(0, t.i - 2) : t.i] in (["after", "that"], ["before", "that"])
        if t.i in commands or t.pos_ == "VERB" or behind:
            actions.append((t.text, commands.get(t.i, t.lemma_).lower(), t.i))
    verb = lambda ts: next((t.lemma_ for t in ts if t.pos_ == "VERB"), None)
    relations = []
    for t in tokens:
        if low[t.i] in ("before", "after"):
            under, above = verb(t.head.subtree), verb(t.ancestors)
            if under and above and under != above:
                relations.append((above, under, "before") if low[t.i] == "before" else (under, above, "before"))
    for a, b in zip(actions, actions[1:]):
        if (a[1], b[1], "sequence") not in relations:
            relations.append((a[1], b[1], "sequence"))
    return {"actions": actions, "entities": [(c.text, c.root.lemma_.lower(), c.root.i) for c in doc.noun_chunks], "relations": relations}


class ModelTagger:
    """The tagger interface over `load() -> parser`; each prompt is parsed once."""

    def __init__(self, load: Callable = spacy_model):
        self.load = load

    def analyse(self, prompts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        load = self.load
        named = {"actions": ("text", "lemma", "token_index"), "entities": ("text", "root", "token_index"), "relations": ("source", "target", "relation")}

        def parse(parts):
            nlp = load()
            for pdf in parts:
                found = [read_text(nlp, t) for t in pdf["text"]]
                yield pdf[["prompt_id"]].assign(**{c: [[dict(zip(names, x)) for x in f[c]] for f in found] for c, names in named.items()})

        kind = prompts.schema["prompt_id"].dataType.simpleString()
        types = [f"{c} array<struct<{', '.join(f'{n}:' + ('bigint' if n == 'token_index' else 'string') for n in names)}>>" for c, names in named.items()]
        whole = cut(prompts.select("prompt_id", "text").mapInPandas(parse, f"prompt_id {kind}, {', '.join(types)}"))
        part = lambda c, at: whole.select("prompt_id", F.posexplode(c).alias(at, "x")).select("prompt_id", F.col(at).cast("int" if at == "seq" else "long").alias(at), "x.*")
        return part("actions", "ordinal"), part("entities", "ordinal"), part("relations", "seq")
