"""URL filtering by a path-template tree, in DataFrame functions only.

Explicit rules come first: the longest that fits wins. Other urls get the verdict of their template. Per host, paths form a
tree of segments, which is grown level by level until no path has a further segment:
- a child whose labelled purity differs significantly from its siblings' keeps its own branch, however small its share (two-proportion test; a child or
  siblings with fewer than MIN_LABELS labels can't be told apart);
- the only child of a node keeps its own branch;
- all others are variable segments or statistically similar branches: they are merged as `*` and grow on together.
A template is rejected if its labelled purity, smoothed towards the purity of all labels, is below a threshold. `labels` marks pages by number: the
label of `doc_id` n is taken as that of `page_id` n, as both number the same crawl and no other column ties the two tables.

Null urls and urls without `://` have an empty host and path, fit no rule, and share the template of that empty path.
Repeated rows count as often as they are there; null page ids have no label; several labels of one page all count. Pages of a
template without labels get the smoothed mean. Empty tables give empty tables; without labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Fixed values of the contract: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LABELS = 5
Z = 1.96
SMOOTHING = 10.0
MIN_PURITY = 0.5
SALTS = 32


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def salted(big: DataFrame, small: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Join a few rows of `small` for each key to many of `big`: rows of a hot key are spread over SALTS by another column."""
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")


def grow(urls: DataFrame) -> DataFrame:
    """From distinct (host, path) with n, lab, good to the same with their template."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    at = urls.withColumn("seg", F.when(F.col("path") == "", F.expr("cast(array() as array<string>)")).otherwise(parts)).withColumn("template", F.lit(""))
    at, d = cut(at), 0
    done = at.where(F.size("seg") == 0)
    at = at.where(F.size("seg") > 0)
    while not at.isEmpty():
        here = at.withColumn("s", F.get("seg", F.lit(d)))
        child = here.groupBy("host", "template", "s").agg(F.count("*").alias("paths"), *[F.sum(c).alias(c) for c in ("lab", "good")])
        node = child.groupBy("host", "template").agg(F.count("*").alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("lab", "good")])
        both = salted(child, node, ["host", "template"], "s")
        rest = F.col("all_lab") - F.col("lab")
        pooled = F.try_divide(F.col("all_good"), F.col("all_lab"))
        gap = F.abs(F.try_divide(F.col("good"), F.col("lab")) - F.try_divide(F.col("all_good") - F.col("good"), rest))
        differs = (F.col("lab") >= MIN_LABELS) & (rest >= MIN_LABELS) & (gap > Z * F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("lab")) + F.try_divide(F.lit(1.0), rest))))
        own = both.select("host", "template", "s", (F.coalesce(differs, F.lit(False)) | (F.col("kids") == 1)).alias("own"), "paths")
        grown = here.join(own, ["host", "template", "s"])
        # a path that is alone in its branch has only single children below: its segments stay as they are
        alone = F.col("own") & (F.col("paths") == 1)
        tail = F.slice("seg", d + 1, F.greatest(F.size("seg") - d, F.lit(1)))
        template = F.when(alone, F.concat_ws("/", "template", F.array_join(tail, "/"))).otherwise(F.concat("template", F.lit("/"), F.when(F.col("own"), F.col("s")).otherwise("*")))
        grown = cut(grown.select(*urls.columns, "seg", template.alias("template"), (alone | (F.size("seg") <= d + 1)).alias("over")))
        done = done.unionByName(grown.where("over").drop("over"))
        at, d = grown.where("NOT over").drop("over"), d + 1
    return done.drop("seg")


def judge(
    pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", rules=RULES, min_purity: float = MIN_PURITY
) -> DataFrame:
    """Return id, host, path, rule, template, purity, verdict for every row of `pages`."""
    host, path = parse(pages[url_col])
    page = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    marks = labels.where(labels[label_col].isNotNull() & labels[label_id].isNotNull()).groupBy(labels[label_id].alias("id")).agg(F.count("*").alias("lab"), F.sum(labels[label_col].cast("long")).alias("good"))
    urls = page.join(marks, "id", "left").groupBy("host", "path").agg(F.count("*").alias("n"), F.coalesce(F.sum("lab"), F.lit(0)).alias("lab"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    at = cut(grow(urls))
    whole = at.agg(F.sum("lab"), F.sum("good")).first()
    mean = (whole[1] / whole[0]) if whole[0] else 1.0
    purity = (F.sum("good") + F.lit(SMOOTHING * mean)) / (F.sum("lab") + F.lit(SMOOTHING))
    judged = at.groupBy("host", "template").agg(purity.alias("purity"))
    by_url = salted(at.select("host", "path", "template", "n"), judged, ["host", "template"], "path")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    out = join_hot(page, by_url, ["host", "path"], "n")
    method = F.when(F.col("purity") < min_purity, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), "template", F.round("purity", 9).alias("purity"), F.coalesce(said, method).alias("verdict"))


def oracle(rules=RULES, min_purity: float = MIN_PURITY, depth: int = 10) -> str:
    """SQL that writes levels out; `depth` must be as many as the longest path has segments."""
    rule, said = "NULL", "NULL"
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
        rule, said = f"CASE WHEN {fits} THEN '{h + p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {said} END"
    sql = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
marks AS (SELECT doc_id AS page_id, count(*) AS lab, sum(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
l0 AS (SELECT host, path, count(*) AS n, coalesce(sum(lab), 0) AS lab, coalesce(sum(good), 0) AS good,
              CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS seg, '' AS template
       FROM page LEFT JOIN marks USING (page_id) GROUP BY host, path)"""
    for d in range(depth):
        sql += f""",
c{d} AS MATERIALIZED (SELECT host, template, seg[{d + 1}] AS s, sum(lab) AS lab, sum(good) AS good FROM l{d} WHERE seg[{d + 1}] IS NOT NULL GROUP BY 1, 2, 3),
n{d} AS MATERIALIZED (SELECT host, template, count(*) AS kids, sum(lab) AS all_lab, sum(good) AS all_good FROM c{d} GROUP BY 1, 2),
v{d} AS MATERIALIZED (SELECT *, CASE WHEN lab >= {MIN_LABELS} AND all_lab - lab >= {MIN_LABELS} THEN abs(good / lab - (all_good - good) / (all_lab - lab))
                     > {Z} * sqrt(all_good / all_lab * (1 - all_good / all_lab) * (1 / lab + 1 / (all_lab - lab))) ELSE FALSE END AS differs
         FROM c{d} JOIN n{d} USING (host, template)),
l{d + 1} AS MATERIALIZED (SELECT a.host, a.path, a.n, a.lab, a.good, a.seg,
                CASE WHEN b.s IS NULL THEN a.template ELSE a.template || '/' || CASE WHEN kids = 1 OR differs THEN b.s ELSE '*' END END AS template
         FROM l{d} a LEFT JOIN v{d} b ON a.host = b.host AND a.template = b.template AND a.seg[{d + 1}] = b.s)"""
    return sql + f""",
t AS (SELECT host, path, lab, good, template FROM l{depth}),
g AS (SELECT CASE WHEN sum(lab) > 0 THEN sum(good) / sum(lab) ELSE 1.0 END AS mean FROM t),
j AS (SELECT host, template, (sum(good) + {SMOOTHING} * any_value(mean)) / (sum(lab) + {SMOOTHING}) AS purity FROM t, g GROUP BY 1, 2)
SELECT page_id, host, path, {rule} AS rule, template, round(purity, 9) AS purity,
       coalesce({said}, CASE WHEN purity < {min_purity} THEN 'block' ELSE 'allow' END) AS verdict
FROM page JOIN t USING (host, path) JOIN j USING (host, template)"""
