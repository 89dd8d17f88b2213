"""Triplets in the linearised output of a relation extractor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE = "struct<mode:string,s:string,o:string,r:string,out:array<struct<subject:string,relation:string,object:string>>>"


def triplets(decoded: Column) -> Column:
    """Array of (subject, relation, object). Words follow the last mark: <triplet> a subject, <subj> an object, <obj> a relation. Incomplete triplets are dropped."""
    bare = F.regexp_replace(F.coalesce(decoded, F.lit("")), "<s>|</s>|<pad>", "")
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")

    def state(mode, s, o, r, out):
        return F.struct(mode.alias("mode"), s.alias("s"), o.alias("o"), r.alias("r"), out.alias("out"))

    def closed(a):
        whole = (a["s"] != "") & (a["r"] != "") & (a["o"] != "")
        one = F.array(F.struct(F.ltrim(a["s"]).alias("subject"), F.ltrim(a["r"]).alias("relation"), F.ltrim(a["o"]).alias("object")))
        return F.when(whole, F.concat(a["out"], one)).otherwise(a["out"])

    def step(a, w):
        none = F.lit("")
        add = lambda mode, field: F.when(a["mode"] == mode, F.concat(a[field], F.lit(" "), w)).otherwise(a[field])
        word = state(a["mode"], add("t", "s"), add("s", "o"), add("o", "r"), a["out"])
        mark = lambda m: state(F.lit(m), a["s"], a["o"], a["r"], a["out"])
        return F.when(w == "<triplet>", state(F.lit("t"), none, none, none, closed(a))).when(w == "<subj>", mark("s")).when(w == "<obj>", mark("o")).otherwise(word)

    start = F.expr(f"cast(named_struct('mode', 'text', 's', '', 'o', '', 'r', '', 'out', array()) as {STATE})")
    return F.aggregate(words, start, lambda a, w: step(a, w).cast(STATE), closed)
