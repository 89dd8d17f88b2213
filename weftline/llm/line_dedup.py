"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines with a word are hashed. Windows are measured in words, so that one long line or many short ones weigh alike: from every line
forward, and to every line backward, the window is the fewest consecutive lines that hold `min_words` words. Each window selects the
leftmost of its least line hashes as fingerprint; neighbouring windows mostly select the same line, so there are fewer fingerprints than lines.
A run of `min_words` words or more that is found twice selects the same lines in both places, so every such run is caught.
Positions of fingerprints that recur are joined by hash. From each the match is extended both ways: the windows around it that selected it are compared
with those around the others, by two 64-bit hashes of their lines beside the fingerprint's own. Windows that are equal to an earlier one unite to
the later runs, which are deleted with the blank lines inside them. No pairs of positions are formed, so a hot line costs what its rows cost.

Documents are ordered by (doc_id, text hash), nulls first; rows equal in both are the same document and get the same result. Only the
first place of a run stays, be it in an earlier document or earlier in the same one. Null texts have no lines and stay null. An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .quality_rules import SPACES, let, words_of

MIN_WORDS = 50


def fingerprints(text: Column, min_words: int) -> Column:
    """Array of (anchor, wins): the hash of a selected line and the windows (a, b, one, two) that selected it, as first and last line and two hashes."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    units = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.least(F.size(words_of(x)), F.lit(min_words)).alias("w"), x.alias("x"))),
        lambda u: u["w"] > 0,
    )
    wide = F.lit(min_words + 1)  # a window is k * wide + n: from unit k on, n units

    def reach(ws: Column) -> Column:
        """How many of the given weights reach min_words; 0 if all don't."""
        got = F.aggregate(
            ws,
            F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")),
            lambda acc, w: F.when(acc["s"] < min_words, F.struct((acc["s"] + w).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(acc),
            lambda acc: F.when(acc["s"] >= min_words, acc["n"]).otherwise(F.lit(0)),
        )
        return F.when(F.get(ws, F.lit(0)) >= min_words, F.lit(1)).otherwise(got)

    def both(us: Column, hs: Column, ws: Column, xs: Column) -> Column:
        ahead = F.transform(us, lambda u, k: let(reach(F.slice(ws, k + 1, min_words)), lambda n: F.when(n > 0, k * wide + n).otherwise(-1)))
        low = lambda k: F.greatest(k - (min_words - 1), F.lit(0))
        back = F.transform(us, lambda u, k: let(reach(F.reverse(F.slice(ws, low(k) + 1, k - low(k) + 1))), lambda n: F.when(n > 0, (k - n + 1) * wide + n).otherwise(-1)))
        # in this order both ends of windows only move on, and so does the selected line
        spans = F.sort_array(F.array_distinct(F.filter(F.concat(ahead, back), lambda s: s > 0)))
        return let(F.transform(spans, lambda s: selected(us, hs, xs, ((s - s % wide) / wide).cast("int"), s % wide)), grouped)

    def selected(us: Column, hs: Column, xs: Column, k: Column, n: Column) -> Column:
        return let(
            F.slice(hs, k + 1, n),
            lambda part: F.struct(
                (k + F.array_position(part, F.array_min(part)).cast("int") - 1).alias("at"),
                F.array_min(part).alias("anchor"),
                F.struct(
                    F.get(us, k)["i"].alias("a"),
                    F.get(us, k + n - 1)["i"].alias("b"),
                    F.xxhash64(part).alias("one"),
                    F.xxhash64(F.lit(1), F.slice(xs, k + 1, n)).alias("two"),
                ).alias("win"),
            ),
        )

    def grouped(found: Column) -> Column:
        """Windows by the place of the line that they selected; equal places are neighbours."""
        new = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda j: (j == 0) | (F.get(found, j)["at"] != F.get(found, F.greatest(j - 1, F.lit(0)))["at"]))
        parts = let(
            new,
            lambda starts: F.transform(
                starts,
                lambda j, x: F.struct(
                    F.get(found, j)["anchor"].alias("anchor"),
                    F.transform(F.slice(found, j + 1, F.coalesce(F.get(starts, x + 1), F.size(found)) - j), lambda f: f["win"]).alias("wins"),
                ),
            ),
        )
        return F.when(F.size(found) > 0, parts)

    return let(units, lambda us: let(F.transform(us, lambda u: u["h"]), lambda hs: let(F.transform(us, lambda u: u["w"]), lambda ws: let(F.transform(us, lambda u: u["x"]), lambda xs: both(us, hs, ws, xs)))))


def _later(rows: DataFrame, id_: Column, text: Column, min_words: int) -> DataFrame:
    """For each document (id, th) with deletions the spans of lines that go."""
    found = rows.select(id_.alias("id"), F.xxhash64(text).alias("th"), F.explode(fingerprints(text, min_words)).alias("f"))
    found = cut(found.select("id", "th", "f.*"))
    # counts and first places are join sides of their own, so that Spark can split the rows of a hot line
    again = cut(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    near = found.join(again, "anchor").select("id", "th", "anchor", F.explode("wins").alias("w")).select("id", "th", "anchor", "w.*")
    here, key = F.struct("id", "th", "a"), ["anchor", "one", "two"]
    first = cut(near.groupBy(*key).agg(F.min(here).alias("first"), F.max(here).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    later = near.join(first, key).where(~here.eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _remove(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Rows as struct d with kept (the text that stays), n_lines, n_removed."""
    row = docs.select(F.struct("*").alias("d"))
    id_, text = F.col("d")[id_col], F.col("d")[text_col]
    spans = _later(row, id_, text, min_words)
    keyed = row.withColumn("th", F.xxhash64(text))
    out = keyed.join(spans.withColumnRenamed("th", "th2"), id_.eqNullSafe(F.col("id")) & (F.col("th") == F.col("th2")), "left")
    lines = F.split(text, "\n")
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"]))))
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)), "\n"))
    return out.select(
        "d",
        F.when(F.col("spans").isNull(), text).otherwise(kept).alias("kept"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Return id, n_lines, n_removed, kept (the text without deleted lines) for every row of `docs`."""
    return _remove(docs, id_col, text_col, min_words).select(F.col("d")[id_col].alias(id_col), "n_lines", "n_removed", "kept")


def clean_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` with deleted lines taken out of the text (and n_chars, if there, counted anew). Rows that lost all their words go."""
    out = _remove(docs, id_col, text_col, min_words)
    out = out.where((F.col("n_removed") == 0) | (F.length(F.translate("kept", SPACES, "")) > 0))
    new = {text_col: F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("d")[c]).alias(c) for c in docs.columns])


def oracle(min_words: int = MIN_WORDS) -> str:
    blank = r"[\x20\x09-\x0D]+"
    n = min_words
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i - 1 AS i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
u AS (SELECT doc_id, i, line, len(list_filter(regexp_split_to_array(line, '{blank}'), lambda x: x <> '')) AS w FROM l),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, i, line, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM u WHERE w > 0),
f AS (SELECT x.doc_id, x.k, min(y.k) AS e FROM k x JOIN k y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k AND x.k + {n - 1} AND y.c - x.c + x.w >= {n} GROUP BY 1, 2),
g AS (SELECT y.doc_id, max(x.k) AS k, y.k AS e FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k BETWEEN y.k - {n - 1} AND y.k AND y.c - x.c + x.w >= {n} GROUP BY 1, 3),
s AS (SELECT DISTINCT doc_id, k, e FROM (SELECT * FROM f UNION ALL SELECT * FROM g)),
w AS (SELECT s.doc_id, s.k, min(x.i) AS a, max(x.i) AS b, string_agg(x.line, chr(10) ORDER BY x.k) AS content
      FROM s JOIN k x ON x.doc_id = s.doc_id AND x.k BETWEEN s.k AND s.e GROUP BY s.doc_id, s.k, s.e),
r AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) AS rn FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM r WHERE rn > 1),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i WHERE gone.i IS NULL GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)"""
