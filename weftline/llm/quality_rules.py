"""Host-level quality rules, in DataFrame functions only.

Each document gets base counts and a base verdict. Failures are summed by host (`source`), the failure rates are shrunk
with a beta prior fitted to all hosts by moments, and hosts whose shrunk rate is above a threshold are rejected with
all their documents.

Null or empty texts have no words and so fail the base rule. Documents of a null host are judged by the base rule alone, and
null hosts take no part in the prior. Repeated rows count as often as they are there. An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
HOST_MAX_RATE = 0.5


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body` as often as needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of characters other than blanks; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of `window` words that is found twice or more."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - s, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def repeated(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(o: Column) -> Column:
            twin = F.filter(o, lambda x, k: (x["h"] == F.coalesce(F.get(o, k + 1)["h"], x["h"] + 1)) | (x["h"] == F.coalesce(F.get(o, F.greatest(k - 1, F.lit(0)))["h"], x["h"] + 1)) & (k > 0))
            return let(F.sort_array(F.transform(twin, lambda x: x["i"])), covered)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, starts))

    def hashed(w: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window))), repeated)

    return let(words, lambda w: F.when(F.size(w) < window + 1, F.lit(0).cast("long")).otherwise(hashed(w)))


def base_counts(text: Column) -> Column:
    """A struct of the base counts and base_failed."""
    safe = F.coalesce(text, F.lit(""))
    counts = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(safe, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(safe) - F.length(F.translate(safe, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            dup_lines(text).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    return let(
        counts,
        lambda c: F.struct(*[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ((c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])).alias("base_failed")),
    )


def bad_hosts(rows: DataFrame, host: Column, failed: Column, max_rate: float = HOST_MAX_RATE) -> DataFrame:
    """Hosts (column host) whose shrunk failure rate is above max_rate, marked as broadcastable if their size is within bounds."""
    hosts = cut(rows.where(host.isNotNull()).groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.count_if(failed).alias("k")))
    p = hosts.select((F.col("k") / F.col("n")).alias("r")).agg(F.avg("r").alias("m"), F.var_pop("r").alias("v")).first()
    mean, spread = p["m"] or 0.0, p["v"] or 0.0
    # moments of a beta distribution: its weight is m (1 - m) / v - 1 observations
    weight = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1.0
    rate = (F.col("k") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    bad = hosts.where(rate > max_rate).select("host")
    size = bad.agg(F.coalesce(F.sum(F.octet_length("host") + 16), F.lit(0))).first()[0]
    return F.broadcast(bad) if size <= BROADCAST_BYTES // 4 else bad


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = HOST_MAX_RATE) -> DataFrame:
    """Return id, the base counts, base_failed, host_rejected, kept for every row of `docs`."""
    base = cut(docs.select(docs[id_col], docs[host_col].cast("string").alias("__host"), base_counts(docs[text_col]).alias("b")).select(id_col, "__host", "b.*"))
    bad = bad_hosts(base, F.col("__host"), F.col("base_failed"), max_rate)
    out = base.join(bad, base["__host"] == bad["host"], "left").withColumn("host_rejected", F.col("host").isNotNull())
    return out.withColumn("kept", ~(F.col("base_failed") | F.col("host_rejected"))).drop("__host", "host")


def keep_good(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_rate: float = HOST_MAX_RATE) -> DataFrame:
    """The rows of `docs` that are kept, columns as they are. The base rule runs twice, so that no text is written or shuffled."""
    row = docs.select(F.struct("*").alias("d"))
    text, host = F.col("d")[text_col], F.col("d")[host_col].cast("string")
    failed = base_counts(text)["base_failed"]
    bad = bad_hosts(row.select(host.alias("h"), failed.alias("f")), F.col("h"), F.col("f"), max_rate)
    return row.where(~failed).join(bad, host == bad["host"], "left_anti").select("d.*")


def oracle(max_rate: float = HOST_MAX_RATE) -> str:
    blank = r"[\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, list_filter(regexp_split_to_array(t, '{blank}'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win
      FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n_repeat_words
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
b AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN n USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT coalesce(avg(k / n), 0) AS m, coalesce(var_pop(k / n), 0) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN least(1e6, greatest(1, m * (1 - m) / v - 1)) ELSE 1 END AS s FROM p),
bad AS (SELECT source FROM h, q WHERE (k + m * s) / (n + s) > {max_rate})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bad.source IS NOT NULL AS host_rejected,
       NOT (base_failed OR bad.source IS NOT NULL) AS kept
FROM f LEFT JOIN bad ON f.source = bad.source"""
