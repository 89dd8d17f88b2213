"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Negation markers are looked for as substrings, opposites as tokens.
NEGATION_MARKERS = [
    "not ", "do not ", "don't ", "without ", "never ", "cannot ", "can't ", "must not ", "should not ", "shouldn't ", "ignore ", "bypass ", "skip ",
]
OPPOSITES = {
    "active": ["inactive", "disabled", "blocked", "deactivated"],
    "inactive": ["active", "enabled", "activated"],
    "enabled": ["disabled", "inactive", "blocked"],
    "disabled": ["enabled", "active"],
    "valid": ["invalid", "unverified"],
    "invalid": ["valid", "verified"],
    "verified": ["unverified", "invalid"],
    "approved": ["rejected", "denied"],
    "rejected": ["approved"],
    "allowed": ["forbidden", "blocked", "disallowed"],
    "forbidden": ["allowed", "permitted"],
}
GENERIC_WORDS = ["the", "a", "an", "must", "should", "be", "is", "are", "to", "for", "and", "or", "of", "on", "in"]
STEP_SEPARATORS = [", then ", " then ", ";"]

EMPTY = "cast(array() as array<string>)"


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr(EMPTY)


def strip(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """Lower case; everything but a-z and 0-9 is one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def norm_builder(c: Column) -> Column:
    """Lower case, underscores as blanks; hyphens and punctuation stay."""
    return F.trim(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))


def norm_step(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def norm_term(c: Column) -> Column:
    """Relationship wording: underscores, hyphens and runs of blanks are one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[_\-\s]+", " "))


def words(c: Column, pattern: str = " +") -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), pattern), lambda x: x != ""))


def token_set(c: Column) -> Column:
    return words(norm(c))


def token_set_builder(c: Column) -> Column:
    return words(norm_builder(c), r"(?U)\s+")


def tokens(c: Column) -> Column:
    """Distinct runs of a-z and 0-9; null has none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    n = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), n.cast("double")))


def token_parts(parts: Column, tokenise=token_set) -> Column:
    """Token sets of an array of strings, nulls left out; one side of `best_jaccard`, computed once a row and not once a pair."""
    return F.transform(F.filter(parts, lambda x: x.isNotNull()), tokenise)


def best_jaccard(query_tokens: Column, part_tokens: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(part_tokens, lambda x: jaccard(query_tokens, x))), F.lit(0.0))


def lexical(query: Column, parts: Column, tokenise=token_set) -> Column:
    """Best Jaccard of the query with any of `parts` (array of strings); an empty query scores 0."""
    return F.get(F.transform(F.array(tokenise(query)), lambda q: best_jaccard(q, token_parts(parts, tokenise))), F.lit(0))


def client_parts(name, id_, description, aliases, types) -> Column:
    return F.concat(F.array(name, id_, description), F.coalesce(aliases, F.expr(EMPTY)), F.coalesce(types, F.expr(EMPTY)))


def lexical_client(query: Column, name, id_, description, aliases, types) -> Column:
    return lexical(query, client_parts(name, id_, description, aliases, types))


def lexical_builder(query: Column, name, aliases, description) -> Column:
    return lexical(query, F.concat(F.array(name), F.coalesce(aliases, F.expr(EMPTY)), F.array(description)), token_set_builder)


def filled(parts: Column, glue: str = " ") -> Column:
    """Join what is neither null nor empty."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), glue)


def node_text_client(name, description, id_, aliases, types) -> Column:
    return filled(F.concat(F.array(name, description, id_), F.coalesce(aliases, F.expr(EMPTY)), F.coalesce(types, F.expr(EMPTY))))


def node_text_builder(name, description, aliases) -> Column:
    return filled(F.concat(F.array(name, description), F.coalesce(aliases, F.expr(EMPTY))))


def node_text_records(name, id_, types, raw_records_json) -> Column:
    """Name, types, then statement, description and summary of every raw record; unreadable JSON gives none."""
    schema = "array<struct<statement:string,description:string,summary:string>>"
    said = F.flatten(F.transform(F.from_json(raw_records_json, schema), lambda r: F.array(r["statement"], r["description"], r["summary"])))
    types_text = F.array_join(F.coalesce(types, F.expr(EMPTY)), " ")
    return F.trim(filled(F.concat(F.array(F.coalesce(F.nullif(name, F.lit("")), id_, F.lit("")), types_text), F.coalesce(said, F.expr(EMPTY)))))


def function_text(name, description, inputs, outputs) -> Column:
    """name, description and, if there are any, lines of inputs and outputs."""
    line = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(f"\n{label}: "), F.array_join(a, ", "))).otherwise("")
    return F.concat(name, F.lit("\n"), description, line("Inputs", inputs), line("Outputs", outputs))


def rule_text(name, description, aliases) -> Column:
    return node_text_builder(name, description, aliases)


def match_text(name, domain_node_name, prompt_text, description=None) -> Column:
    """The first name there is, and the description behind it."""
    best = F.coalesce(*[F.nullif(c, F.lit("")) for c in (name, domain_node_name, prompt_text)], F.lit(""))
    if description is None:
        return best
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(best, F.lit(". "), description)).otherwise(best)


def explicit_steps(prompt: Column) -> Column:
    """Split on the first of the separators that is in the text, and on that one only."""
    text = strip(prompt)
    clean = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")
    out = F.array(text)
    for sep in reversed(STEP_SEPARATORS):
        out = F.when(F.contains(text, F.lit(sep)), clean(F.split(text, sep))).otherwise(out)
    return out


def intent(prompt: Column, steps: Column, given: Column | None = None) -> Column:
    said = F.coalesce(F.get(steps, F.lit(0)), strip(prompt))
    return said if given is None else F.coalesce(F.nullif(given, F.lit("")), said)


def contradicts(prompt: Column, rule: Column) -> Column:
    """An opposite of a rule's token is in the prompt, or the prompt negates and shares a telling token with the rule."""
    low = F.trim(F.lower(prompt))
    p, r = tokens(low), tokens(F.trim(F.lower(rule)))
    opposite = F.lit(False)
    for token, others in OPPOSITES.items():
        opposite = opposite | (F.array_contains(r, token) & F.arrays_overlap(p, strings(*others)))
    negated = F.lit(False)
    for marker in NEGATION_MARKERS:
        negated = negated | F.contains(low, F.lit(marker))
    return opposite | (negated & (F.size(F.array_except(F.array_intersect(p, r), strings(*GENERIC_WORDS))) > 0))


def overlap_terms(prompt: Column, rule: Column) -> Column:
    return F.array_sort(F.array_intersect(tokens(prompt), tokens(rule)))


def recover_json(raw: Column) -> Column:
    """The JSON text in a model's reply: fences go; what does not parse is tried from the first `{` to the last `}`. Null if nothing parses."""
    bare = F.trim(F.regexp_replace(F.trim(raw), r"(?s)^```[a-zA-Z]*\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    ok = lambda c: F.try_parse_json(c).isNotNull() & (F.substring(F.ltrim(c), 1, 1) == "{")
    return F.when(ok(bare), bare).when(ok(inner), inner)


def path_text(path: Column) -> Column:
    return F.array_join(path, " -> ")
