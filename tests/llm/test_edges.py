"""Edge cases of every operator and stage: nulls in any column, empty and very long texts, ties
and repeated rows, empty tables, and further columns whose names clash with results or with
what the operators call their own columns."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import bin_slack_packing, edit_decontamination, extendible_sharding, html_wrappers, jaccard_join, quality_rules, quality_trees, quote_linking, token_counts, url_rules
from factloom.llm.common import materialise
from factloom.llm.queries import VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)
LONG = " ".join(f"w{k % 977} x{k}" for k in range(40_000))
ITEM = "a benchmark question of fifty letters or a few more than that"
SAME = "the same text of a few words"
TEXTS = [
    (None, None), (None, SAME), (0, None), (1, ""), (2, LONG), (3, SAME), (3, SAME), (4, SAME), (4, "another text"), (5, " \t\n "),
    (6, "y" * 60_000), (7, f"It asks {ITEM} and goes on."), (8, LONG + " and " + ITEM), (9, "\0﻿\U0001f600 é"),
]
NAMES = """a at b before ca cb component component_id conv degree end_id errors fp found h hash held_out home host ids ids_crc32 item item_id items kept
key labels least length link mined_rule n n_bytes n_chars n_dup_lines n_quotes n_repeat_words n_shingles n_symbols n_tokens n_words node note offset over_limit
p parent_conv parent_turn path piece place position predicted pos quality rule row said score sequence_id shard size start t thread_id token top toxic u v
verdict word_chars wrapper _at _host _html _part _parts _page _path _salt _url _own_host _own_path _b _c _e _h _k _l _n _q _r _row _s _sa _sb _t _text _token _tokens _u _w""".split()


def documents(spark, given=TEXTS):
    return spark.createDataFrame(given, "doc_id long, text string")


def clashing(df):
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("clash").alias(n) for n in NAMES if n not in have])


def labels(spark):
    return spark.createDataFrame([(k, k % 2, None if k % 3 else k % 2) for k in range(10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, ITEM), (None, None), (3, ""), (4, None)], "item_id long, text string")


def packed(d):
    # Which of equal pieces takes which place is free.
    return bin_slack_packing.pack_documents(d, PATH).drop("sequence_id", "offset")


OPERATORS = {
    "1": lambda s, d: quality_rules.judge(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "2": lambda s, d: token_counts.count_tokens(d, PATH).select("doc_id", "n_bytes", "n_tokens", "over_limit"),
    "3": lambda s, d: jaccard_join.join(d),
    "7": lambda s, d: extendible_sharding.assign(d, 1000),
    "8": lambda s, d: packed(d),
    "9": lambda s, d: quality_trees.score(d, quality_trees.train(d, labels(s))).select("doc_id", "held_out", "score", "predicted"),
    "10": lambda s, d: edit_decontamination.contaminated(d, benchmark(s), short=True),
}


def sorted_rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_documents_with_clashing_columns_and_without_rows(spark, name):
    run = OPERATORS[name]
    plain = run(spark, documents(spark))
    assert sorted_rows(run(spark, clashing(documents(spark)))) == sorted_rows(plain)
    if name not in ("8", "10"):
        assert plain.count() == len(TEXTS)
    assert run(spark, documents(spark, [])).columns == plain.columns
    assert run(spark, documents(spark, [])).count() == 0


def test_counts_of_edges_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    found = token_counts.count_tokens(documents(spark), PATH).collect()
    wanted = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in TEXTS]
    assert sorted(map(repr, [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found])) == sorted(map(repr, wanted))
    whole = bin_slack_packing.pack_documents(documents(spark), PATH).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    sums: dict = {}
    for k, _, n in wanted:
        sums[k] = sums.get(k, 0) + n + 1
    assert {r["doc_id"]: r["n"] for r in whole} == sums


def test_items_in_very_long_and_repeated_rows(spark):
    found = edit_decontamination.contaminated(clashing(documents(spark, [*TEXTS, (7, ITEM), (7, ITEM)])), benchmark(spark), short=True)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(k, i) for k in (7, 8) for i in (1, 2)}


def test_shards_of_ties_fit(spark):
    many = [(1, "x" * 100)] * 30 + [(2, "x" * 100)] * 3 + [(3, "x" * 5000), (None, None)]
    given = clashing(documents(spark, many))
    found = extendible_sharding.assign(given, 1000)
    assert found.count() == len(many)


# ---- pages

URLS = [
    (1, "http://News.Example.net/a?b"), (1, "http://News.Example.net/a?b"), (2, None), (None, "http://x.net/"), (3, "no scheme"), (4, "://"), (5, "http://"), (6, "http://a.org/fr/" + "p/" * 30_000),
    (7, "HTTP://EXAMPLE.NET/en/x"), (8, "http://notexample.com/de/"), (9, "http://sub.example.com/de/x#y"), (10, "http://h.net#/en/"), (11, ""),
]
VERDICTS = {
    1: ("news.example.net", "/a", "net/", "block"), 2: ("", "", None, "allow"), None: ("x.net", "/", "net/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
    7: ("example.net", "/en/x", "example.net/en/", "allow"), 8: ("notexample.com", "/de/", None, "allow"), 9: ("sub.example.com", "/de/x", "example.com/de/", "block"), 10: ("h.net", "", None, "allow"), 11: ("", "", None, "allow"),
}


def test_urls_with_clashing_columns(spark):
    pages = clashing(spark.createDataFrame(URLS, "page_id long, url string"))
    none = url_rules.mine(url_rules.label_pages(pages, labels(spark).limit(0)))
    found = url_rules.verdicts(pages, url_rules.LISTED, none).select("page_id", "host", "path", "rule", "verdict").collect()
    assert len(found) == len(URLS)
    assert {r["page_id"]: tuple(r)[1:] for r in found if r["page_id"] != 6} == VERDICTS
    assert [(r["host"], len(r["path"]), r["rule"]) for r in found if r["page_id"] == 6] == [("a.org", 60_004, "org/fr/")]
    assert url_rules.verdicts(pages.limit(0), url_rules.LISTED, none).count() == 0
    mined = url_rules.mine(url_rules.label_pages(pages, labels(spark)))
    assert url_rules.verdicts(pages, url_rules.LISTED, mined).count() == len(URLS)


def test_pages_that_are_empty_long_or_repeated(spark):
    body = "".join(f"<p>Paragraph {k} of a very long page &amp; more.</p>" for k in range(4000))
    long = f"<html><body><nav>Menu</nav><article>{body}</article><footer>End</footer></body></html>"
    given = [(1, "http://a.net/1", None), (2, "http://a.net/2", ""), (3, None, "<p>No address</p>"), (4, "http://b.net/4", long), (None, "http://b.net/5", long), (5, "x", "no tags"), (6, "http://a.net/6", "<div><p>open <b>tags"), (7, "http://a.net/7", "<" * 2000)]
    given += [(8, "http://c.net/8", "<article><p>Twelve copies</p></article>")] * 12
    pages = spark.createDataFrame(given, "page_id long, url string, html string")
    plain = html_wrappers.extract_pages(pages).select("page_id", "url", "text", "n_chars")
    rows = plain.collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == len(given) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert got[1] == got[2] == "" and got[3] == "No address" and got[5] == "no tags" and got[6] == "open tags" and got[8] == "Twelve copies"
    assert got[4] == got[None] == " ".join(f"Paragraph {k} of a very long page & more." for k in range(4000))
    assert sorted_rows(html_wrappers.extract_pages(clashing(pages)).select("page_id", "url", "text", "n_chars")) == sorted_rows(plain)
    assert html_wrappers.extract_pages(pages.limit(0)).count() == 0


# ---- conversations


def test_messages_that_repeat_tie_or_are_very_long(spark):
    line = "A line that very many messages write and some quote."
    talk = [(k, 0, "user", line) for k in range(1, 9)] + [(9, 0, "user", f"> {line}\nYes."), (9, 1, "user", LONG), (9, 2, None, None), (10, 0, "user", f"> {LONG}\nLong."), (11, 1, "user", "one"), (11, 1, "user", "two"), (11, 1, "user", "two"), (11, 2, "user", "> one\nthree"), (None, None, None, "> one\nnowhere")]
    given = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    plain = quote_linking.link(given)
    found = [r.asDict() for r in plain.collect()]
    assert len(found) == len(talk)
    parent = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"], r["link"]) for r in found}
    assert parent[9, 0] == (1, 0, "quote")  # the earliest of the writers
    assert parent[10, 0] == (9, 1, "quote") and parent[11, 2] == (11, 1, "quote") and parent[11, 1] == (None, None, "root")
    assert sorted(r["text"] for r in found if r["conv_id"] == 11 and r["turn"] == 1) == ["one", "two", "two"]
    assert sorted(r["position"] for r in found if r["thread_id"] == 11) == [1, 2, 3, 4]
    assert sorted_rows(quote_linking.link(clashing(given))) == sorted_rows(plain)


# ---- the pipeline's stages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels(spark).write.parquet(f"{path}/labels.parquet")
    benchmark(spark).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("number", range(5))
def test_stages_at_the_edges(spark, folder, number):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[number]
    d = documents(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    for given in (d, clashing(d)):
        out = stage(spark, given, folder)
        kept = [(r["doc_id"], r["text"]) if "text" in out.columns else r["doc_id"] for r in out.collect()]
        if number < 4:
            assert out.columns == given.columns, name
            assert set(kept) <= set(TEXTS)
            assert given is d or all(set(r) == {"clash"} for r in out.select([n for n in NAMES if n != "lang"]).collect()), name
        if name == "jaccard_join":
            # Empty texts and those without words stay; of SAME and its copies one stays, with the least key.
            assert sorted(map(repr, kept)) == sorted(map(repr, [t for t in TEXTS if t[1] != SAME and t[0] != 8] + [(3, SAME)]))
        if name == "decontamination":
            assert sorted(map(repr, kept)) == sorted(map(repr, [t for t in TEXTS if t[0] not in (7, 8)]))
        if name == "quality_rules":
            assert not {t for t in kept if len((t[1] or "").split()) < 20}
        if name == "packing":
            assert set(kept) == {k for k, _ in TEXTS}
    empty = stage(spark, d.limit(0), folder)
    assert empty.count() == 0


def test_joins_of_the_directory_see_its_leaves_only(spark):
    """All prefixes of all depths are many times the cells, whose file is all that Spark knows of them."""
    rng = random.Random(7)
    rows = {rng.randrange(2**10): (rng.randint(0, 400), rng.randint(1, 3)) for _ in range(600)}
    cells = materialise(spark.createDataFrame([(c, b, n) for c, (b, n) in rows.items()], "cell long, bytes long, rows long"), "cells")
    found = extendible_sharding._leaves(cells, 10, 0, 1000)
    assert "sequence(" not in found._jdf.queryExecution().executedPlan().toString()
    sums = {}
    for c, (b, n) in rows.items():
        for depth in range(11):
            have = sums.get((depth, c >> (10 - depth)), (0, 0))
            sums[depth, c >> (10 - depth)] = (have[0] + b, have[1] + n)
    leaf = {c: next((depth, c >> (10 - depth), *s) for depth in range(11) for s in [sums[depth, c >> (10 - depth)]] if s[0] <= 1000 or s[1] == 1) for c in rows}
    assert {r["cell"]: tuple(r)[1:] for r in found.collect()} == leaf
