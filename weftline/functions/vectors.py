"""Vector similarity and score blends as Column expressions. Folds run left to right in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def present(a: Column) -> Column:
    return F.coalesce(F.size(a) > 0, F.lit(False))


def cosine_raw(a: Column, b: Column, na: Column | None = None, nb: Column | None = None, product: Column | None = None) -> Column:
    """In [-1, 1]; a zero norm gives 0. Norms and the product can be handed in, so that they are not computed anew for each pair."""
    n = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    return F.when(n == 0, 0.0).otherwise(F.try_divide(dot(a, b) if product is None else product, n))


def cosine_client(a: Column, b: Column, na: Column | None = None, nb: Column | None = None, product: Column | None = None) -> Column:
    """(cos + 1) / 2 within [0, 1]; absent, empty, unlike in length or of norm zero gives 0."""
    n = (norm(a) if na is None else na) * (norm(b) if nb is None else nb)
    same = present(a) & present(b) & (F.size(a) == F.size(b)) & (n != 0)
    return F.coalesce(F.when(same, clamp((F.try_divide(dot(a, b) if product is None else product, n) + 1.0) / 2.0)), F.lit(0.0))


def cosine_builder(a: Column, b: Column) -> Column:
    """As cosine_client, but a longer vector is cut for the product while norms are of whole vectors."""
    short = F.least(F.size(a), F.size(b))
    n = norm(a) * norm(b)
    same = present(a) & present(b) & (n != 0)
    return F.coalesce(F.when(same, clamp((F.try_divide(dot(F.slice(a, 1, short), F.slice(b, 1, short)), n) + 1.0) / 2.0)), F.lit(0.0))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def blend_client(semantic: Column, lexical: Column) -> Column:
    return 0.70 * semantic + 0.30 * lexical


def blend_direct(semantic: Column, lexical: Column, client: Column) -> Column:
    return 0.45 * semantic + 0.35 * lexical + 0.20 * clamp(client)


def blend_neighbour(semantic: Column, lexical: Column, relation: Column) -> Column:
    return 0.50 * semantic + 0.25 * lexical + 0.25 * relation


def blend_dependency(score: Column, step: Column) -> Column:
    return 0.65 * score + 0.35 * step


def node_similarity(query: Column, text: Column, name: Column) -> Column:
    """The better of full text and name; null where the full text has no vector."""
    return F.when(present(text), F.greatest(cosine_raw(query, text), F.when(present(name), cosine_raw(query, name))))
