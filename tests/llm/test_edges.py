"""Nulls, empty and very long texts, ties and repeated rows, empty tables, columns with clashing names."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe_codec, decontaminate, language_id, line_dedup, quality_model, quality_rules, simhash, substring_dedup, token_counts, url_filter

CLASH = "id k th d host b h fp low root seg lo n lab good spans kept at text2 __text row score n_words component_id salts bucket template s as n_rows".split()
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def word(i):
    r = random.Random(i)
    return "".join(r.choice("abcdefgh") for _ in range(6))


LONG = " ".join(word(i) for i in range(9000)) + "\n" + "x" * 30000
ROWS = [
    (None, None, None, None, None), (None, "some text", "en", "a", 9), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, LONG, "en", None, 1), (4, LONG, "en", "a", 1), (4, LONG, "en", "a", 1),
    (5, " \n\t ", "de", "b", 4), (6, "ein zwei\n" * 30, "de", "b", 2), (7, "ein zwei\n" * 30, "de", "b", 2), (8, "\U0001f600 ok \x00 <|endoftext|>", "de", "b", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DDL)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, None), (3, 1, 0), (None, 1, 1), (6, 0, 0), (7, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "ein zwei"), (1, "ein zwei"), (None, "some"), (3, None), (4, "")], "item_id long, text string")


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def ops(labels, bench):
    return {
        "quality_model": lambda d: quality_model.classify(d, labels), "decontaminate": lambda d: decontaminate.with_verdict(decontaminate.find_contamination(d, bench)), "quality_rules": quality_rules.judge,
        "line_dedup": line_dedup.dedup_lines, "simhash": simhash.near_duplicates, "language_id": language_id.identify, "substring": substring_dedup.remove_repeats,
        "codec": lambda d: bpe_codec.encode_decode(d, RANKS, public_tokenizers.PATTERN), "counts": lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    }


NAMES = "quality_model decontaminate quality_rules line_dedup simhash language_id substring codec counts".split()


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(docs, labels, bench, name):
    got = ops(labels, bench)[name](docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append({k: v for k, v in r.asDict().items() if k != "doc_id"})
    assert by[4][0] == by[4][1]  # repeated rows
    one = {k: v[0] for k, v in by.items()}
    if name == "counts":
        assert (one[1]["n_tokens"], one[2]["n_tokens"], one[8]["n_bytes"]) == (0, 0, 23)
    if name == "codec":
        assert one[1]["token_ids"] == [] and bytes(one[3]["decoded"]).decode() == LONG
    if name == "language_id":
        assert one[1]["lang_pred"] == one[2]["lang_pred"] == one[5]["lang_pred"] == "und"
    if name == "simhash":
        assert one[1]["fp"] == one[2]["fp"] == one[5]["fp"] == 0 and one[5]["component_id"] == one[1]["component_id"] == 1
        assert one[4]["component_id"] == 3 and one[7]["component_id"] == 6
    if name == "decontaminate":
        assert one[6]["n_hit"] == 60 and one[6]["contaminated"] and one[6]["items"] == ["1"] and not one[1]["contaminated"] and one[1]["n_words"] == 0
    if name == "quality_rules":
        assert one[1]["base_failed"] and one[6]["n_repeat_words"] == 60 and one[6]["n_dup_lines"] == 29 and not one[3]["host_rejected"]
    if name == "line_dedup":
        assert one[1]["kept"] is None and one[4]["n_removed"] == 2 and one[3]["n_removed"] == 0 and one[6]["n_removed"] == 29 and one[7]["n_removed"] == 30
    if name == "substring":
        assert one[1]["n_bytes"] == 0 and one[4]["n_removed"] == one[4]["n_bytes"] and one[7]["n_removed"] == one[7]["n_bytes"] == 270 and one[6]["n_removed"] == 261
    if name == "quality_model":
        assert all(0 <= r["score"] <= 1 for v in by.values() for r in v) and one[None]["held_out"] is False


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, labels, bench, name):
    assert ops(labels.where("false"), bench.where("false"))[name](empty).collect() == []


def test_without_labels_or_items(docs, labels, bench):
    none = ops(labels.where("false"), bench.where("false"))
    assert {r.score for r in none["quality_model"](docs).collect()} == {0.5}
    assert not any(r.contaminated for r in none["decontaminate"](docs).collect())


def test_stages_keep_columns(docs, bench):
    for stage in (quality_rules.keep_good, line_dedup.clean_lines, simhash.keep_one, lambda d: decontaminate.clean_documents(d, bench)):
        out = stage(docs)
        assert out.columns == docs.columns and out.count() <= len(ROWS)
    kept = sorted((r.doc_id is not None, r.doc_id) for r in simhash.keep_one(docs).collect() if r.doc_id is not None)
    assert [k for _, k in kept] == [1, 3, 6, 8]


URLS = [
    ("https://A.Example.ORG/en/1?x", "a.example.org", "/en/1", "example.org/en/1", "block"), ("http://example.org/es/9", "example.org", "/es/9", "example.org/es/", "block"), ("x://b.org/", "b.org", "/", "org/", "allow"),
    ("x://b.org", "b.org", "", None, "allow"), ("x://c.com/fr/1#f", "c.com", "/fr/1", "com/fr/", "allow"), ("x://c.com/de/", "c.com", "/de/", "com/de/", "block"), ("x://c.com/de", "c.com", "/de", None, "allow"),
    ("x://notorg/", "notorg", "/", None, "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("x://É.com/de/1", "É.com", "/de/1", "com/de/", "block"),
]


def test_urls(spark, labels):
    pages = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(URLS)] + [(None, "x://b.org/"), (0, URLS[0][0])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("id", F.lit(2))
    labels = labels.where("quality = 1")
    got = url_filter.judge(pages, labels).collect()
    assert len(got) == len(URLS) + 2
    by = {r.page_id: r for r in got}
    assert [(by[i].host, by[i].path, by[i].rule, by[i].verdict) for i in range(len(URLS))] == [u[1:] for u in URLS]
    assert url_filter.judge(pages.where("false"), labels).collect() == []


def test_bad_templates_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"x://h.net/{'bad' if i % 2 else 'good'}/{i}.html") for i in range(400)], "page_id long, url string")
    labels = pages.select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 2 == 0).cast("int").alias("quality"))
    got = {(r.template, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got == {("/good/*", "allow"), ("/bad/*", "block")}


def test_bad_sections_of_any_share_and_depth_are_blocked(spark):
    """Among 40 good sections one bad one, and a bad branch below the seventh segment; a very long url and one of 300 segments."""
    rows = [(i, f"x://h.net/s{i % 40}/p{i}") for i in range(4000)]
    rows += [(5000 + i, f"x://d.net/a/b/c/d/e/f/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)]
    rows += [(6000, "x://long.net/" + "y" * 200_000), (6001, "x://deep.net" + "/z" * 300), (6002, "x://deep.net" + "/z" * 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = ((F.col("page_id") < 4000) & (F.col("page_id") % 40 == 7)) | ((F.col("page_id") >= 5000) & (F.col("page_id") % 2 == 1))
    labels = pages.where("page_id < 6000").select(F.col("page_id").alias("doc_id"), (~bad).cast("int").alias("quality"))
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert {r.template for r in got.values() if r.verdict == "block"} == {"/s7/*", "/a/b/c/d/e/f/bad/*"}
    assert all((got[i].verdict == "block") == (i % 40 == 7) for i in range(4000)) and got[6001].template == "/z" * 300


def test_bad_hosts_are_rejected(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "short" if i % 10 else good, "en", "bad", 1) for i in range(50)] + [(100 + i, good + str(i), "en", f"g{i % 3}", 1) for i in range(60)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, DDL)).collect()}
    assert got[10].host_rejected and not got[10].kept and not got[10].base_failed and got[100].kept


def test_many_blocks_of_items(spark, bench):
    rows = [(i, " ".join(f"t{j}" for j in range(i, i + 20)), None, None, None) for i in range(40)]
    d = spark.createDataFrame(rows, DDL)
    items = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(3 * i, 3 * i + 14))) for i in range(12)], "item_id long, text string")
    one = decontaminate.with_verdict(decontaminate.find_contamination(d, items))
    many = decontaminate.with_verdict(decontaminate.find_contamination(d, items, pass_bytes=200))
    pick = lambda x: sorted(tuple(r) for r in x.select("doc_id", "n_words", "n_hit", "contaminated", F.array_join("items", ",")).collect())
    assert pick(one) == pick(many)
    assert sorted(r.doc_id for r in decontaminate.clean_documents(d, items, pass_bytes=200).collect()) == sorted(r.doc_id for r in decontaminate.clean_documents(d, items).collect())
