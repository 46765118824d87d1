"""The operators against plain versions, and their edge cases: nulls, empty and long texts,
ties, repeated rows, empty tables, further columns."""

import itertools
import json
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from factloom.llm import (
    bin_slack_packing,
    edit_decontamination,
    extendible_sharding,
    html_wrappers,
    jaccard_join,
    quality_rules,
    quality_trees,
    quote_linking,
    token_counts,
    url_rules,
    vocabulary,
)
from factloom.llm.common import table
from factloom.llm.components import components
from factloom.llm.queries import ORACLES, QUERIES, VOCABULARY

from ..compare import connection, rows
from . import brute

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(VOCABULARY)
DOCS = "doc_id long, text string, kept string, score int"


def docs(spark, pairs):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in pairs], DOCS)


def some_texts(seed, n=60):
    """Bases with edited and exact copies, and small and empty texts."""
    rng = random.Random(seed)
    vocabulary_ = [f"w{k}" for k in range(400)]
    out = ["", None, "one", "One", "one two", "a b c d e", "A b c d e", "  ", "a\nb\tc d e"]
    while len(out) < n:
        base = [rng.choice(vocabulary_) for _ in range(rng.choice([5, 6, 8, 12, 20, 40, 90]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary_)] * rng.randint(0, 2)
            out.append(" ".join(copy) or "x")
    return list(enumerate(out))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    wanted = connection(FOLDER).execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


# ---- 1


def test_quality_measures(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "x y " * 30, "the cat sat on the mat and " * 9, "l1 a\nl1 a\n\nl2\nl1 a", "é# *\x0bü\x1cz\x85q"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["long word " * 30_000]
    found = {r["doc_id"]: r for r in quality_rules.judge(docs(spark, enumerate(texts))).collect()}
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        w, r = brute.words(t), found[k]
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        wanted = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), brute.repeat_words(t))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == wanted, t
        assert r["base_failed"] == (wanted[0] < 20 or 100 * wanted[4] > 30 * wanted[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.keep_good(docs(spark, enumerate(texts))).columns == ["doc_id", "text", "kept", "score"]
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_quality_filter_agrees_with_verdicts(spark):
    d = table(spark, FOLDER, "documents")
    kept = {r[0] for r in quality_rules.judge(d).where("kept").select("doc_id").collect()}
    assert {r[0] for r in quality_rules.keep_good(d).select("doc_id").collect()} == kept and kept


# ---- 2


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_tokens_equal_the_library(spark):
    rng = random.Random(5)
    letters = list("abcABC 's'ret\t\n\r\x0b\x0c\x85\xa0\x1c éÉßſİıΣσς中文ñ'!#1٣²½🙂") + ["<|endoftext|>", "<|startoftext|>", "'S", "Ǆ"]
    texts = [None, "", "the the", "x" * 5000] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    own, lib = vocabulary.Encoder(*vocabulary.read(PATH)), library()
    ids = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [own.encode(t or "") for t in texts] == [struct.pack(f"<{len(i)}I", *i) for i in ids]
    found = {r["doc_id"]: r for r in token_counts.count_tokens(docs(spark, enumerate(texts)), PATH, limit=3).collect()}
    for k, t in enumerate(texts):
        assert (found[k]["n_tokens"], found[k]["n_bytes"], found[k]["over_limit"]) == (len(ids[k]), len((t or "").encode()), len(ids[k]) > 3)


def test_each_piece_is_merged_once_whatever_stands_beside_it(monkeypatch):
    own, lib, merged = vocabulary.Encoder(*vocabulary.read(PATH)), library(), []
    merge = own._merged
    monkeypatch.setattr(own, "_merged", lambda piece: merged.append(piece) or merge(piece))
    text = "qxzvwk qxzvwk, (qxzvwk) Qxzvwk's \u201cqxzvwk\u201d qüxzvwk; qxzvwk7"
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids) and own.count(text) == len(ids)
    assert merged.count("qxzvwk") == 2 and merged.count("qüxzvwk") == 2  # once for the ids, once for the count


# ---- 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed):
    given = some_texts(seed, 140) + [(7, "repeated row of five words more"), (7, "repeated row of five words more"), (None, "a b c d e")]
    found = jaccard_join.join(docs(spark, given)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute.components(given), key=repr)


def test_jaccard_many_members_under_one_leader(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 0)  # so that all go through the index
    rng = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    given = []
    for k in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(60)] = f"n{k}-{rng.randrange(9)}"
        given.append((k, " ".join(copy)))
    given += [(200 + k, " ".join(base[:30] + [f"t{k}-{j}" for j in range(25)])) for k in range(40)]
    given += [(300 + k, " ".join(base[:30] + [f"t{k}-{j}" for j in range(24)])) for k in range(40)]
    found = jaccard_join.join(docs(spark, given)).collect()
    assert sorted(map(tuple, found)) == sorted(brute.components(given))


def test_jaccard_near_copies_that_mostly_do_not_link(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    given = []
    for i in range(240):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(80)] = f"x{rng.randrange(40)}"
        given.append((i, " ".join(words)))
    found = {tuple(r) for r in jaccard_join.join(docs(spark, given)).collect()}
    assert found == set(brute.components(given))


def test_jaccard_keys_that_are_not_whole_numbers(spark):
    text = " ".join(f"w{i}" for i in range(30))
    given = spark.createDataFrame([("a", text), ("b", text), (None, text), ("c", "other")], "doc_id string, text string")
    assert sorted(r["doc_id"] for r in jaccard_join.keep_first(given).collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        jaccard_join.join(given)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.choice([2, 3, 5, 9, 15, 30, 80, 300]))
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        most = jaccard_join.most_apart(len(a), len(a))
        drop = int(rng.integers(0, most // 2 + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**64, int(rng.integers(0, most // 2 + 1)), dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common) and len(a) + len(b) != 2 * common:
            (ka, na), (kb, nb) = jaccard_join.signatures(a), jaccard_join.signatures(b)
            assert len(np.intersect1d(ka, kb)) > min(na.max() % 64, nb.max() % 64) or len(np.intersect1d(ka[na % 64 == 0], kb[nb % 64 == 0]))


def test_jaccard_keeps_one_of_each_group(spark):
    given = some_texts(5, 80)
    kept = sorted(r["doc_id"] for r in jaccard_join.keep_first(docs(spark, given)).collect())
    assert kept == sorted({k for k, _, c in brute.components(given) if k == c})
    assert jaccard_join.join(docs(spark, [])).count() == 0


def test_jaccard_keeps_documents_with_null_or_repeated_keys(spark):
    a, b, c, d = ("".join(f"{x}{k} " for k in range(30)) for x in "abcd")
    given = [(1, a), (1, b), (2, a), (2, c), (None, a), (None, d), (None, d), (None, b), (None, ""), (None, ""), (3, c)]
    kept = jaccard_join.keep_first(docs(spark, given))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (2, c), (None, d), (None, ""), (None, "")], key=str)
    copy = jaccard_join.keep_first(docs(spark, [(7, a), (None, a), (8, b)]))
    assert sorted(r["doc_id"] for r in copy.collect()) == [7, 8]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components(links, "a", "b").collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


# ---- 4


def test_quotations_link_messages(spark):
    first = "Where shall we meet on Sunday?\nI would like the park."
    talk = [
        (1, 0, "user", first), (1, 1, "assistant", "A second message, with its own words."), (1, 2, "user", "On Monday Bob wrote:\n> where shall we  meet on Sunday?\n> I would like the park.\n\nAt the gate."),
        (1, 3, "assistant", ">> Where shall we meet on Sunday?\n> At the gate.\nFine."), (2, 0, "user", "> A second message, with its own words.\nI come from elsewhere."), (3, 0, "user", None), (3, 1, "user", "> nobody said that\nok"), (3, 1, "user", "> nobody said that\nok"),
    ]
    frame = spark.createDataFrame([(*m, "extra") for m in talk], "conv_id long, turn long, role string, text string, link string")
    found = {}
    for r in quote_linking.link(frame).collect():
        found.setdefault((r["conv_id"], r["turn"]), []).append(r)
    get = lambda c, t: (found[c, t][0]["thread_id"], found[c, t][0]["parent_conv"], found[c, t][0]["parent_turn"], found[c, t][0]["link"], found[c, t][0]["text"])
    assert get(1, 2) == (1, 1, 0, "quote", "At the gate.")
    assert get(1, 3) == (1, 1, 2, "quote", "Fine.")
    assert get(2, 0) == (1, 1, 1, "quote", "I come from elsewhere.")
    assert get(3, 0) == (3, None, None, "root", "")
    assert get(3, 1) == (3, 3, 0, "turn", "ok") and len(found[3, 1]) == 2
    rows_ = [r for rs in found.values() for r in rs]
    place = {(r["conv_id"], r["turn"]): r["position"] for r in rows_ if r["thread_id"] == 1}
    assert all(place[r["parent_conv"], r["parent_turn"]] < r["position"] for r in rows_ if r["thread_id"] == 1 and r["link"] != "root")
    threads = {r["thread_id"]: [m["content"] for m in r["messages"]] for r in quote_linking.threads(quote_linking.link(frame)).collect()}
    assert threads[1][0] == first and ">" not in "".join(threads[1])
    assert quote_linking.link(frame.limit(0)).count() == 0


def test_deeper_levels_and_other_conversations_link_too(spark):
    long = "A long passage that was written in the first conversation."
    talk = [(1, 0, long), (1, 1, "thanks"), (2, 0, "thanks"), (2, 1, f"> thanks\n\n> {long}\nHere again."), (3, 0, f"> an edited reply\n>> {long}\nSee above."), (4, 0, "thanks"), (4, 1, "> thanks\nok")]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in talk], "conv_id long, turn long, role string, text string")
    found = {(r["conv_id"], r["turn"]): (r["thread_id"], r["parent_conv"], r["parent_turn"], r["link"]) for r in quote_linking.link(frame).collect()}
    assert found[2, 1] == (1, 1, 0, "quote") and found[3, 0] == (1, 1, 0, "quote")
    assert found[4, 1] == (4, 4, 0, "quote")  # on a tie, home


# ---- 5


def test_listed_and_mined_rules(spark):
    urls = ["http://A.NET/x", "http://a.net", "https://b.Example.net/en/1", "http://example.com/de/2", "http://x.org/fr/", "http://x.org/de/", None, "no host", "http://bad.io/spam/1?buy=1", "http://bad.io/ham/2"]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    labelled = spark.createDataFrame([(f"http://bad.io/spam/{k}?buy={k}", True) for k in range(30)] + [(f"http://bad.io/ham/{k}", False) for k in range(60)] + [(None, True), ("http://x.io", None)], "url string, bad boolean")
    mined = url_rules.mine(labelled)
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.verdicts(pages, url_rules.LISTED, mined).collect()}
    assert found == {
        0: ("a.net", "/x", "net/", "block"), 1: ("a.net", "", None, "allow"), 2: ("b.example.net", "/en/1", "example.net/en/", "allow"), 3: ("example.com", "/de/2", "example.com/de/", "block"),
        4: ("x.org", "/fr/", "org/fr/", "allow"), 5: ("x.org", "/de/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("bad.io", "/spam/1", None, "block"), 9: ("bad.io", "/ham/2", None, "allow"),
    }
    assert {tuple(r["antecedent"]) for r in mined.collect()} <= {("path:spam",), ("query:buy",)}
    assert url_rules.mine(labelled.limit(0)).count() == 0


def test_rules_of_four_tokens_are_mined(spark):
    # Any three of the four paths are as often good as bad, the four together only bad.
    bad = [("http://h.io/a/b/c/d", True)] * 40
    good = [(f"http://h.io/{'/'.join(x)}", False) for x in ("abc", "abd", "acd", "bcd") for _ in range(40)]
    mined = url_rules.mine(spark.createDataFrame(bad + good, "url string, bad boolean"))
    assert {tuple(r["antecedent"]) for r in mined.collect()} == {("path:a", "path:b", "path:c", "path:d")}
    pages = spark.createDataFrame([(1, "http://h.io/a/b/c/d"), (2, "http://h.io/a/b/c")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.verdicts(pages, (), mined).collect()} == {1: "block", 2: "allow"}


def test_long_urls_are_mined_and_judged_in_bounded_time(spark):
    long = "http://x.io/" + "/".join(f"p{k}" for k in range(60))
    labelled = spark.createDataFrame([(long, k % 2 == 0) for k in range(60)] + [(f"{long}/a/b", True) for _ in range(25)] + [(f"{long}/a", False) for _ in range(25)] + [(f"{long}/b", False) for _ in range(25)], "url string, bad boolean")
    mined = url_rules.mine(labelled)
    assert [tuple(r) for r in mined.collect()] == [(["path:a", "path:b"], 25, 25)]
    pages = spark.createDataFrame([(1, long, "x"), (2, long + "/a/b", "y"), (2, long + "/a/b", "y"), (3, long + "/b", "z")], "page_id long, url string, host string")
    assert [(r["page_id"], r["host"], r["verdict"]) for r in url_rules.verdicts(pages, url_rules.LISTED, mined).orderBy("page_id").collect()] == [(1, "x.io", "allow"), (2, "x.io", "block"), (2, "x.io", "block"), (3, "x.io", "allow")]


def rules_by_counting(rows, how, longest=3):
    """The minimal sure combinations of up to ``longest`` tokens of rows (tokens, bad)."""
    least, found = max(how.min_count, -int(-how.min_share * len(rows) // 1)), []
    every = sorted({t for tokens, _ in rows for t in tokens})
    for size in range(1, longest + 1):
        shorter = list(found)
        for c in itertools.combinations(every, size):
            held = [bad for tokens, bad in rows if set(c) <= tokens]
            if sum(held) >= least and 100 * sum(held) >= how.confidence * len(held) and not any(set(p) <= set(c) for p in shorter):
                found.append(c)
    return sorted(found)


@pytest.mark.parametrize("most", [0, 14])
def test_mined_rules_equal_counting(spark, most):
    how = url_rules.Mining(min_count=4, min_share=0.0, confidence=60, most_items=most)
    for seed in range(3):
        rng = random.Random(seed)
        rows = []
        for _ in range(150):
            has = {w for w in "abcdef" if rng.random() < 0.5}
            has |= {"twin"} if "a" in has else set()  # always with a
            bad = rng.random() < (0.9 if {"b", "c"} <= has or {"a", "d", "e"} <= has else 0.15)
            rows.append((has | {"all"}, bad))
        labelled = spark.createDataFrame([("http://h/" + "/".join(sorted(t)), bad) for t, bad in rows], "url string, bad boolean")
        found = sorted(tuple(r["antecedent"]) for r in url_rules.mine(labelled, how).collect())
        wanted = rules_by_counting([({f"path:{w}" for w in t} | {"host:h"}, bad) for t, bad in rows], how)
        assert [f for f in found if len(f) <= 3] == wanted


def test_no_token_is_left_out_of_long_urls(spark):
    rng = random.Random(1)
    others = [f"o{k}" for k in range(16)]
    bad = [("http://h/pp/qq/" + "/".join(w for w in others if rng.random() < 0.97), True) for _ in range(100)]
    good = [(f"http://h/{w}/" + "/".join(o for o in others if rng.random() < 0.4), False) for w in ("pp", "qq") for _ in range(100)]
    how = url_rules.Mining(confidence=95)
    found = [tuple(r["antecedent"]) for r in url_rules.mine(spark.createDataFrame(bad + good, "url string, bad boolean"), how).collect()]
    assert ("path:pp", "path:qq") in found


def test_a_url_of_sixty_tokens_takes_no_longer(spark):
    sixty = "http://h/" + "/".join(f"w{k}" for k in range(60))
    rows = [(sixty, k % 2 == 0) for k in range(200)] + [(f"http://h/x/y{k % 7}", k % 3 == 0) for k in range(200)]
    began = time.time()
    assert url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0
    assert time.time() - began < 60


def test_rows_of_one_very_frequent_url_and_null_urls_are_judged(spark):
    mined = spark.createDataFrame([(["path:b", "path:c"],)], "antecedent array<string>")
    pages = spark.createDataFrame([(k, "http://x/b/c" if k % 3 else None) for k in range(90)] + [(100, "http://x/b"), (101, "http://x/c/b/d")], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in url_rules.verdicts(pages, (), mined).collect()}
    assert len(found) == 92 and all(found[k] == ("block" if k % 3 else "allow") for k in range(90)) and (found[100], found[101]) == ("allow", "block")


# ---- 6


def page(title, body, extra=""):
    return f'<html><head><title>x</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>{title}</h1>{body}<form><input>Send</form></article>{extra}<div id="comments"><p>I disagree</p></div><footer>&copy; 2024</footer></body></html>'


def test_main_text_of_pages(spark):
    pages = [
        ("http://a.io/1", page("One", "<p>First &amp; <b>bold</b>ly\n said.<br>Next<p>Second"), "One First & boldly said. Next Second"),
        ("http://a.io/2", page("Two", "<ul><li>x<li>y</ul>", '<aside class="sidebar">Side</aside>'), "Two x y"),
        ("http://b.io/1", '<body><div class="header">Top</div><div class="content"><p>Only&nbsp;this</p><!-- no --></div><div class="ads">Buy</div>', "Only this"),
        ("http://c.io/1", "just text &lt; tags", "just text < tags"), (None, None, ""), ("http://d.io", "", ""), ("http://e.io", "<p>unclosed <b>", "unclosed"),
    ]
    frame = spark.createDataFrame([(k, u, h, "host", "t") for k, (u, h, _) in enumerate(pages)], "page_id long, url string, html string, host string, text string")
    found = html_wrappers.extract_pages(frame)
    assert {r["page_id"]: r["text"] for r in found.collect()} == {k: t for k, (_, _, t) in enumerate(pages)}
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())
    assert found.columns == ["page_id", "url", "html", "host", "text", "n_chars"]


def test_wrappers_join_beyond_the_broadcast_limit(spark, monkeypatch):
    frame = table(spark, FOLDER, "pages")
    more = [(10_000 + k, f"http://n.io/{k}", neutral(f"<p>{words_of(k)}</p>", k)) for k in range(9)] + [(20_000, None, None)]
    frame = frame.select("page_id", "url", "html").union(spark.createDataFrame(more, frame.select("page_id", "url", "html").schema))
    usual = {tuple(r) for r in html_wrappers.extract_pages(frame).select("page_id", "text").collect()}
    assert (10_003, words_of(3)) in usual
    monkeypatch.setattr(html_wrappers, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in html_wrappers.extract_pages(frame).select("page_id", "text").collect()} == usual


def test_expression_learns_repeats_options_slots_and_constants():
    pages = [bare("".join(f"<p>{words_of(9 * k + j)}</p>" for j in range(k + 1)), k) + ("<blockquote>q</blockquote>" if k % 2 else "") for k in range(5)]
    found = html_wrappers.infer(pages)["expression"]
    text = html_wrappers.regex(found)
    assert found["pages"] == 5 and text.startswith("Home | News | ")
    assert "(#slot)+" in text and "(q)?" in text and "Page #slot" in text


def neutral(article, k, tail="All rights are with the owners of this site."):
    return f'<html><body><div class="x"><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></div><div class="y">{article}</div><div class="z"><p>{tail}</p><p>Page {k}</p></div></body></html>'


def bare(article, k, tail="All rights are with the owners of this site."):
    return neutral(article, k, tail).removesuffix("</body></html>")


def extracted(spark, pages):
    frame = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_wrappers.extract_pages(frame).collect()}


def words_of(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_constants_go_where_no_name_says_what_the_article_is(spark):
    # Copies of one page count once, and there are more of them than a sample would hold.
    texts = [words_of(k) for k in range(8)]
    pages = [("http://n.io/0", neutral(f"<p>{texts[0]}</p>", 0))] * 40 + [(f"http://n.io/{k}", neutral(f"<p>{t}</p>", k)) for k, t in enumerate(texts)]
    found = extracted(spark, pages)
    assert [found[40 + k] for k in range(8)] == texts and found[0] == found[40]
    plain = html_wrappers.infer([h for _, h in pages])
    assert [html_wrappers.extract(h, plain) for _, h in pages] == list(found.values())


def test_what_near_copies_or_some_pages_share_stays(spark):
    same = "".join(f"<p>{words_of(k)}</p>" for k in range(5))
    copies = [("http://c.io/", page("Title", same + f"<p>Edition {k}</p>")) for k in range(6)]
    licence = words_of(99)
    some = [("http://l.io/", page(f"T{k}", f"<p>{words_of(200 + k)}</p>" + (f"<p>{licence}</p>" if k < 20 else ""))) for k in range(40)]
    found = extracted(spark, copies + some)
    assert all(found[k] == " ".join(["Title", *(words_of(j) for j in range(5)), f"Edition {k}"]) for k in range(6))
    assert all((licence in found[6 + k]) == (k < 20) for k in range(40))


@pytest.mark.parametrize("n", [3, 4, 8, 100])
def test_article_text_stays_however_many_pages_a_host_has(spark, n):
    licence = words_of(99, 12)
    court = lambda k: f'<p>Court {k}.</p><div class="legal">Law {words_of(k)}</div><section class="search">Search {words_of(300 + k)}</section><div class="side">Side {words_of(600 + k)}</div>'
    named = [("http://a.io/", page(f"T{k}", f"<p>By Ann Lee.</p>{court(k)}<p>{licence}</p>")) for k in range(n)]
    notice = lambda k: f'<div class="box7">Get our letter weekly {k}</div>'
    plain = [("http://p.io/", neutral(f"<p>{words_of(k)}</p><p>By Ann Lee.</p><p>{words_of(400 + k)}</p>", k).replace("</body>", notice(k) + "</body>")) for k in range(n)]
    found = extracted(spark, named + plain)
    wanted = [f"T{k} By Ann Lee. Court {k}. Law {words_of(k)} Search {words_of(300 + k)} Side {words_of(600 + k)} {licence}" for k in range(n)]
    assert [found[k] for k in range(n)] == wanted
    assert [found[n + k] for k in range(n)] == [f"{words_of(k)} By Ann Lee. {words_of(400 + k)}" for k in range(n)]


def by_counting(pages):
    """The texts of lists of blocks: without what all pages have before and behind what varies, numbers left out."""
    mark = lambda b: re.sub(r"\d+", "", b)
    held = Counter(m for blocks in pages for m in {mark(b) for b in blocks})
    out = []
    for blocks in pages:
        there = [i for i, b in enumerate(blocks) if held[mark(b)] < len(pages)]
        out.append(" ".join(blocks[there[0] : there[-1] + 1]) if there else "")
    return out


def test_expressions_of_random_templates_equal_counting(spark, monkeypatch):
    monkeypatch.setattr(html_wrappers, "PART", 5)  # parts, and parts of parts
    rng = random.Random(12)
    frame, wanted = [], []
    for h in range(4):
        before, behind = ([words_of(1000 * h + k + at, rng.randint(2, 8)) for k in range(rng.randint(1, 4))] for at in (100, 200))
        blocks = [[*before, *(words_of(rng.random(), rng.randint(10, 40)) for _ in range(rng.randint(1, 6))), *behind, f"Seen {k} times today"] for k in range(12)]
        shape = rng.choice(["<p>{}</p>", "<div><div>{}</div></div>"])
        frame += [(f"http://h{h}.io/{k}", "<html><body>" + "".join(shape.format(b) for b in page) + "</body></html>") for k, page in enumerate(blocks)]
        wanted += by_counting(blocks)
    assert list(extracted(spark, frame).values()) == wanted


def test_pages_of_another_template_have_their_own_article(spark):
    one = [("http://t.io/", f'<div class="content"><p>{words_of(k)}</p></div>') for k in range(20)]
    two = [("http://t.io/", f'<div class="content"><p>Box {k}</p></div><div class="story"><p>{words_of(50 + k)}</p></div>') for k in range(3)]
    found = extracted(spark, one + two)
    assert [found[k] for k in range(23)] == [words_of(k) for k in range(20)] + [words_of(50 + k) for k in range(3)]


def test_all_parts_of_an_article_are_taken():
    body = '<div class="entry-content"><p>First part.</p></div><div class="ad">Buy</div><div class="entry-content"><p>The second, longer part.</p></div>'
    assert html_wrappers.extract(f"<html><body>{body}</body></html>", None) == "First part. The second, longer part."


def in_article(body, k):
    return f"<html><body><article><h1>T{k}</h1>{body}</article></body></html>"


@pytest.mark.parametrize("n", [3, 30])
def test_pages_with_a_named_article_come_to_the_expression(spark, monkeypatch, n):
    monkeypatch.setattr(html_wrappers, "PART", 7)  # parts, and parts of parts
    notice = '<div class="legal">All prices with tax, all words without warranty.</div>'
    pages = [("http://a.io/", in_article(f'<p>{words_of(k)}</p>{notice}<div class="legal">Law {words_of(50 + k)}</div>', k)) for k in range(n)]
    found = html_wrappers.infer([h for _, h in pages])["named"]
    assert [e["pages"] for e in found.values()] == [n] and "#slot" in html_wrappers.regex(*found.values())
    wanted = [f"T{k} {words_of(k)} Law {words_of(50 + k)}" for k in range(n)]  # the same name: constant, a notice; varying, a paragraph
    assert extracted(spark, pages + pages[:2]) == dict(enumerate(wanted + wanted[:2]))
    monkeypatch.setattr(html_wrappers, "BROADCAST_BYTES", 0)
    assert extracted(spark, pages) == dict(enumerate(wanted))


def test_notices_stay_where_the_expression_tells_only_copies_apart(spark):
    same = f'<p>{words_of(1)}</p><div class="legal">All words without warranty.</div>'
    found = extracted(spark, [("http://c.io/", in_article(same + f"<p>Edition {k}</p>", "")) for k in range(4)])
    assert [found[k] for k in range(4)] == [f"T {words_of(1)} All words without warranty. Edition {k}" for k in range(4)]


def test_what_varies_is_the_article_whatever_the_names_say(spark):
    box = f'<div class="content"><p>{words_of(1, 30)}</p></div>'
    alone = [("http://a.io/", f'<body>{box}<div class="k3"><p>{words_of(10 + k)}</p></div></body>') for k in range(6)]
    longer = f'<div class="content"><p>{words_of(2, 30)}</p></div>'
    several = [("http://s.io/", f'<body>{longer}<div class="story"><p>{words_of(30 + k, 25)}</p></div><div class="k4"><p>{words_of(60 + k)}</p></div></body>') for k in range(6)]
    found = extracted(spark, alone + several)
    assert [found[k] for k in range(12)] == [words_of(10 + k) for k in range(6)] + [words_of(30 + k, 25) for k in range(6)]
    firm = [("http://f.io/", f"<body><article><p>{words_of(1, 30)}</p></article><p>{words_of(10 + k)}</p></body>") for k in range(6)]
    assert set(extracted(spark, firm).values()) == {words_of(1, 30)}  # a tag is no guess


def test_text_under_doubtful_names_does_not_choose_a_candidate():
    for tag in ("div", "span"):
        body = f'<div class="content"><p>The few words.</p></div><div class="story"><{tag} class="legal">{words_of(1)}</{tag}><p>x</p></div>'
        assert html_wrappers.extract(f"<body>{body}</body>", None) == "The few words."


def test_rare_blocks_stay_in_the_expression_however_many(spark):
    """They tell by their amount that constants are a template, and what is rare in the first pages may be on all that follow."""
    rare = lambda k: "".join(f"<r{k}x{j}>Rare words {k} of block {j}</r{k}x{j}>" for j in range(45))
    pages = [f"<body><p>{'menu entry ' * 60}</p>{rare(k)}<b>{words_of(k)}</b></body>" for k in range(60)]
    found = html_wrappers.infer(pages)["expression"]
    blocks = [b for page in pages for b in html_wrappers.stream(html_wrappers.read(page))[1]]
    assert sum(t[html_wrappers._CHARS] for t in found["tokens"]) == sum(len(b[1]) for b in blocks)
    assert html_wrappers.decides(found)
    got = html_wrappers.extract_pages(spark.createDataFrame([(k, "http://a.b/c", page) for k, page in enumerate(pages)], "page_id long, url string, html string")).collect()
    assert all("menu entry" not in r["text"] and "block 44" in r["text"] for r in got)


def test_matching_blocks_are_those_of_the_whole_lists():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(40))] for _ in range(2))
        b = [x for x in b if x % 3]
        assert list(html_wrappers._matches(a, b)) == [tuple(m) for m in html_wrappers.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]


# ---- 7


def test_shards_fit_and_are_prefixes(spark):
    rng = random.Random(2)
    given = [(k, "x" * rng.choice([0, 1, 10, 60])) for k in range(400)] + [(1000, "y" * 500), (None, None)] + [(7, "same row")] * 60
    found = extendible_sharding.assign(docs(spark, given), 200).collect()
    assert len(found) == len(given)
    size: dict[tuple, int] = {}
    for r in found:
        key = (r["depth"], r["shard"], r["part"])
        size[key] = size.get(key, 0) + r["n_bytes"]
    assert all(n <= 200 for key, n in size.items() if not any(r["oversized"] for r in found if (r["depth"], r["shard"], r["part"]) == key))
    whole = {}
    for r in found:
        whole.setdefault((r["depth"], r["shard"]), r["shard_bytes"])
    for depth, shard in whole:  # the bucket one bit shorter would not fit
        if depth:
            sibling = sum(b for (d, s), b in whole.items() if d >= depth and s >> (d - depth + 1) == shard >> 1)
            assert sibling > 200
    assert extendible_sharding.assign(docs(spark, []), 200).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    given = docs(spark, [(k, "word " * k) for k in range(40)])
    extendible_sharding.write_shards(given, extendible_sharding.assign(given, 500), str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text").collect())) == [(k, "word " * k) for k in range(40)]


# ---- 8


def test_packing_is_exact_and_tight(spark):
    rng = random.Random(8)
    given = [(k, " ".join(rng.choice(["the", "zqxj", "of", "and"]) for _ in range(rng.choice([0, 1, 5, 30, 100])))) for k in range(150)] + [(3, "twice"), (3, "twice"), (900, None), (2**60 + 1, "large id")]
    lib, capacity = library(), 64
    found = bin_slack_packing.pack_documents(docs(spark, given), PATH, capacity, with_ids=True)
    rows_ = found.collect()
    want = sorted((k, [*lib.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in given)
    cut = sorted((k, n // capacity, n, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, ids in want for n in range(0, len(ids), capacity) for p in [ids[n : n + capacity]])
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows_) == cut
    bins: dict[int, list] = {}
    for r in rows_:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(c[3] for c in cut) // capacity) + 1
    assert {len(r["ids"]) for r in bin_slack_packing.sequences(found).collect()} <= set(range(1, capacity + 1))
    assert bin_slack_packing.pack_documents(docs(spark, []), PATH).count() == 0


def test_null_keys_stay_and_large_ones_stay_whole(spark):
    given = docs(spark, [(None, "the cat"), (2**60 + 1, "the dog"), (2**60 + 1, None)])
    packed = bin_slack_packing.pack_documents(given, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packed) == [(0, 3), (2**60 + 1, 1), (2**60 + 1, 3)]
    item = "one two three four five six seven eight nine ten"
    held = docs(spark, [(None, item), (2**60 + 1, item), (1, "x")])
    found = edit_decontamination.contaminated(held, spark.createDataFrame([(4, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0) for r in found) == [0, 2**60 + 1]
    talk = spark.createDataFrame([(None, 0, "user", "a"), (2**60 + 1, None, "user", "b"), (2**60 + 1, 1, "user", "c")], "conv_id long, turn long, role string, text string")
    assert {(r["conv_id"], r["turn"], r["text"]) for r in quote_linking.link(talk).collect()} == {(None, 0, "a"), (2**60 + 1, None, "b"), (2**60 + 1, 1, "c")}


def test_fullest_finds_the_best_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 30)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = bin_slack_packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in taken.items())


# ---- 9


def test_classifier_on_held_out_labels(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    forest = quality_trees.train(d, labels)
    judged = quality_trees.score(d, forest).join(labels, "doc_id").where("held_out").toPandas()
    assert (judged["predicted"] == judged["quality"]).mean() > 0.9 and judged["score"].between(0, 1).all()
    assert all((zlib.crc32(str(k).encode()) % 5 == 0) for k in judged["doc_id"])
    again = quality_trees.train(d.repartition(7), labels)
    assert np.array_equal(forest.limit, again.limit) and np.array_equal(forest.value, again.value)


def test_classifier_edges(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "word " * 50_000), (3, "word")])
    nothing = quality_trees.train(d, spark.createDataFrame([], "doc_id long, quality int"))
    found = quality_trees.score(d, nothing)
    assert {r["score"] for r in found.collect()} == {0.5} and found.columns == ["doc_id", "text", "kept", "held_out", "score", "predicted"]
    one = quality_trees.train(d, spark.createDataFrame([(1, 1), (3, 1), (2, None), (3, 7)], "doc_id long, quality int"))
    assert all(r["score"] > 0.9 for r in quality_trees.score(d, one).collect())
    assert quality_trees.score(docs(spark, []), one).count() == 0


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality_trees.STATISTICS)))
    y = (x[:, 3] + 0.3 * x[:, 5] > 0).astype(float)
    f = quality_trees.grow(x, y, quality_trees.Settings(trees=5))
    for row, raw in zip(x[:50], f.raw(x[:50]), strict=True):
        total = f.start
        for t in range(5):
            node = 0
            while f.left[t, node] != node:
                node = f.left[t, node] if row[f.feature[t, node]] <= f.limit[t, node] else f.right[t, node]
            total += f.value[t, node]
        assert total == pytest.approx(raw)
    assert ((f.score(x) > 0.5) == y).mean() > 0.85


# ---- 10


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        item, text = ("".join(rng.choice("ab c") for _ in range(rng.randint(a, 12))) for a in (1, 0))
        most = rng.randint(0, 4)
        found, wanted = edit_decontamination.best_match(item, text, most), brute.nearest(item, text)
        assert (found[0] if found else None) == (wanted if wanted <= most else None)


def test_items_within_the_budget_are_found(spark):
    rng = random.Random(6)
    item = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(k, item(14)) for k in range(12)] + [(90, None), (91, "short")]
    given, wanted = [(0, None), (1, ""), (2, "short"), (3, items[0][1].upper().replace(" ", "\n  ")), (3, "nothing here")], {(3, 0, 0)}
    for k in range(10, 60):
        number, text = items[rng.randrange(12)]
        letters = list(text)
        for _ in range(rng.randint(0, 8)):
            letters[rng.randrange(len(letters))] = rng.choice("xyz")
        given.append((k, f"{item(20)} {''.join(letters)} {item(20)}"))
    norm = edit_decontamination.normalise
    for k, t in given[4:]:
        for number, text in items[:12]:
            d = brute.nearest(norm(text), norm(t))
            if d <= edit_decontamination.budget(len(norm(text)), 6):
                wanted.add((k, number, d))
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, end string")
    found = edit_decontamination.contaminated(docs(spark, given), bench)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found.collect()} == wanted
    kept = edit_decontamination.drop_contaminated(docs(spark, given), bench)
    dirty = {k for k, *_ in wanted}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, t in given if k not in dirty or t == "nothing here")
    assert edit_decontamination.contaminated(docs(spark, given), bench.limit(0)).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    d, bench = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    whole = {tuple(r) for r in edit_decontamination.contaminated(d, bench).collect()}
    monkeypatch.setattr(edit_decontamination, "BLOCK", 3000)
    assert {tuple(r) for r in edit_decontamination.contaminated(d, bench).collect()} == whole and whole


def test_short_items_are_found_whole(spark, tmp_path):
    import corpus_pipeline

    given = [(0, "What is two plus two?"), (1, "He asked: what  is two plus TWO? Four."), (2, "somewhat is two plus two?"), (3, "what is two plus to?"), (4, "地球是什么形状的"), (5, "a cat sat"), (6, "concat")]
    bench = spark.createDataFrame([(1, "What is two plus two?"), (2, "是什么"), (3, "cat"), (4, ""), (5, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r["doc_id"], r["item_id"], r["distance"], r["end"]) for r in QUERIES["op10_decontamination"](spark, str(tmp_path)).collect()}
    assert found == {(0, 1, 0, 21), (1, 1, 0, 31), (4, 2, 0, 5), (5, 3, 0, 5)}
    kept = corpus_pipeline.decontaminate(spark, table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 6]


# ---- the pipeline


def test_pipeline_equals_its_stages_done_plainly(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    d = table(spark, folder, "documents")
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d
        d = spark.createDataFrame(stage(spark, before, folder).toPandas(), before.schema)
        assert d.columns == columns, name
        ids, kept = [r["doc_id"] for r in before.collect()], {r["doc_id"] for r in d.collect()}
        texts = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "jaccard_join":
            assert kept == {k for k, _, c in brute.components(sorted(texts.items())) if k == c}
        if name == "quality_rules":
            assert all(len(brute.words(texts[k])) >= 20 for k in kept)
        if name == "decontamination":
            items = [edit_decontamination.normalise(r["text"]) for r in table(spark, folder, "benchmark").collect()]
            assert not any(i in edit_decontamination.normalise(texts[k]) for k in kept for i in items)
        assert kept <= set(ids)
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in d.collect()}


def test_json_of_wrappers_round_trips():
    found = html_wrappers.infer([page("a", "<p>b</p>")])
    assert json.loads(json.dumps(found)) == found
