"""Containment joins through indexes: names that hold a term, spans that hold a quote, spans that cover its words.

Each side is cut into grams or words, the other side is looked up by its rarest one, and only what
meets there is compared. Nothing is compared with everything, so a session or user with very many rows
costs its own rows and what really shares something rare. Only a session's few items are compared with its spans as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import canonical, plain, word_tokens
from ..sources.storage import kept

#: Letters of a gram in names; shorter terms are looked up whole among the grams of their own length.
GRAM = 3
#: Letters of a gram in texts: the shortest quote.
QUOTE = 6
#: Items of one session that are compared with all its spans; that costs less than the grams of the spans.
COMPARED = 64


def grams(text: Column, size: int) -> Column:
    """The different stretches of so many letters."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substring(text, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _rarest(asked: DataFrame, counts: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """asked (key, by, gram) with the one gram of each key that fewest rows have; none where a gram is nowhere."""
    known = asked.join(counts.hint("merge"), [*by, "gram"], "left").select(*key, *by, "gram", F.coalesce("n", F.lit(0)).alias("n"))
    least = known.groupBy(*key, *by).agg(F.min(F.struct("n", "gram")).alias("_g"))
    return least.where(F.col("_g.n") > 0).select(*key, *by, F.col("_g.gram").alias("gram"))


def names_holding(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name): the different names that hold a term, whatever the case. terms (term), names (name).

    A term of three letters or more is looked up by its rarest gram of three letters and then compared; a shorter one
    is a gram itself. An empty term holds nowhere.
    """
    asked = terms.select(F.lower("term").alias("_low"), "term").where(F.length("_low") > 0).distinct()
    given = names.select("name", F.lower("name").alias("_name")).where(F.col("name").isNotNull()).distinct()
    long = asked.where(F.length("_low") >= GRAM).select("term", "_low", F.explode(grams(F.col("_low"), GRAM)).alias("gram"))
    wanted = long.select("gram").distinct()
    postings = kept(given.select("name", "_name", F.explode(grams(F.col("_name"), GRAM)).alias("gram")).join(wanted, "gram"), "name-postings")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = _rarest(long, counts, ["term", "_low"], []).join(postings, "gram").where(F.col("_name").contains(F.col("_low"))).select("term", "name")
    for size in range(1, GRAM):
        short = asked.where(F.length("_low") == size).select("term", F.col("_low").alias("gram"))
        found = found.unionByName(given.select("name", F.explode(grams(F.col("_name"), size)).alias("gram")).join(short, "gram").select("term", "name"))
    return found


def mentions_by_terms(terms: DataFrame, mentions: DataFrame, most: int, most_terms: int = 20) -> DataFrame:
    """(query_id, mention_id, name, position): each query's mentions that hold its terms, at most so many.

    terms (query_id, user_id, place, term), the first most_terms that are not blank count; mentions (user_id, mention_id, name,
    confidence, seq). Each term brings its best mentions (by confidence, then the newest), at most ``most``; they follow
    each other in the order of terms, and of a mention that several bring the first place counts.
    """
    clean = terms.withColumn("term", F.lower(F.trim(plain(F.col("term"))))).where(F.col("term") != "")
    first = clean.select("*", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).alias("_p")).where(F.col("_p") <= most_terms)
    held = names_holding(first.select("term"), mentions.select("name"))
    # A term's best mentions are the same for all queries of a user, and of one name no more than the best can be among them.
    newest = [F.desc("confidence"), F.desc("seq")]
    named = mentions.select("user_id", "mention_id", "name", "confidence", "seq", F.row_number().over(Window.partitionBy("user_id", "name").orderBy(*newest)).alias("_n")).where(F.col("_n") <= most)
    pairs = first.select("user_id", "term").distinct().join(held, "term").join(named, ["user_id", "name"])
    best = Window.partitionBy("user_id", "term").orderBy(*newest)
    top = pairs.select("user_id", "term", "mention_id", "name", F.row_number().over(best).alias("_r")).where(F.col("_r") <= most)
    each = first.join(top, ["user_id", "term"]).select("query_id", "mention_id", "name", "_p", "_r")
    once = each.groupBy("query_id", "mention_id").agg(F.min(F.struct("_p", "_r", "name")).alias("_f"))
    order = Window.partitionBy("query_id").orderBy("_f._p", "_f._r")
    return once.select("query_id", "mention_id", F.col("_f.name").alias("name"), F.row_number().over(order).alias("position")).where(F.col("position") <= most)


def timeline_by_terms(terms: DataFrame, mentions: DataFrame, facts: DataFrame, most: int, time: str = "occurred_start") -> DataFrame:
    """(query_id, fact_id, position): the facts of the mentions that hold the terms, once each, in the order of time, undated first.

    mentions has fact_id besides what ``mentions_by_terms`` needs.
    """
    found = mentions_by_terms(terms, mentions, most).join(mentions.select("mention_id", "fact_id"), "mention_id")
    once = found.groupBy("query_id", "fact_id").agg(F.min("position").alias("_p")).join(facts.select("fact_id", time), "fact_id")
    order = Window.partitionBy("query_id").orderBy(F.coalesce(time, F.lit(0)), "_p")
    return once.select("query_id", "fact_id", F.row_number().over(order).alias("position"))


def quotes_in_spans(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    """(item_id, span_id): the spans of an item's session that hold its quote. quotes (item_id, session_id, _q), spans (session_id, span_id, _s).

    A quote of QUOTE letters or more is looked up by its rarest gram among the session's spans. Spark takes the grams for as small as
    the texts' files, so no side of them is left to it to broadcast.
    """
    asked = quotes.select("item_id", "session_id", "_q", F.explode(F.transform(grams(F.col("_q"), QUOTE), lambda g: F.xxhash64(g))).alias("gram"))
    held = spans.select("session_id", "span_id", F.explode(F.transform(grams(F.col("_s"), QUOTE), lambda g: F.xxhash64(g))).alias("gram"))
    counts = held.join(asked.select("session_id", "gram").distinct().hint("merge"), ["session_id", "gram"]).groupBy("session_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    probes = _rarest(asked, counts, ["item_id", "_q"], ["session_id"])
    near = held.join(probes.hint("merge"), ["session_id", "gram"]).select("session_id", "span_id", "item_id", "_q")
    return near.join(spans.hint("merge"), ["session_id", "span_id"]).where(F.col("_s").contains(F.col("_q"))).select("item_id", "span_id")


def spans_covering(quotes: DataFrame, spans: DataFrame, least: float) -> DataFrame:
    """(item_id, span_id, overlap): spans of the session that have at least that share of a quote's words.

    quotes (item_id, session_id, _qt), spans (session_id, span_id, _st), arrays of different words. Of n words at least
    m = ceil(least * n) have to be there, so one of any n - m + 1 is: the session's rarest are looked up.
    """
    held = spans.select("session_id", "span_id", F.explode("_st").alias("gram"))
    counts = held.groupBy("session_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    asked = quotes.select("item_id", "session_id", F.size("_qt").alias("_n"), F.explode("_qt").alias("gram"))
    priced = asked.join(counts.hint("merge"), ["session_id", "gram"], "left").select("item_id", "session_id", "_n", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    order = Window.partitionBy("item_id").orderBy("n", "gram")
    probes = priced.select("*", F.row_number().over(order).alias("_r")).where(F.col("_r") <= F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1)
    near = held.join(probes.select("item_id", "session_id", "gram").hint("merge"), ["session_id", "gram"]).select("item_id", "session_id", "span_id").distinct()
    both = near.join(quotes.hint("merge"), ["item_id", "session_id"]).join(spans.hint("merge"), ["session_id", "span_id"])
    covered = both.select("item_id", "span_id", (F.size(F.array_intersect("_qt", "_st")) / F.size("_qt")).alias("overlap"))
    return covered.where(F.col("overlap") >= least)


def _by_comparing(q: DataFrame, s: DataFrame, least: float) -> DataFrame:
    """(item_id, n, exact, near) of each item against all spans of its session."""
    share = F.when(~F.col("_holds") & (F.size("_qt") >= 3), F.size(F.array_intersect("_qt", "_st")) / F.size("_qt"))
    both = s.join(q.hint("merge"), "session_id").select("*", F.col("_s").contains(F.col("_q")).alias("_holds"))
    pairs = both.select("session_id", "item_id", "span_id", "_at", "_holds", share.alias("overlap"))
    near = F.when(F.col("overlap") >= least, F.struct((-F.col("overlap")).alias("_o"), "_at", "span_id"))
    # The join's partitions hold whole sessions, so this needs no further shuffle.
    each = pairs.groupBy("session_id", "item_id").agg(F.count_if("_holds").alias("n"), F.min(F.when(F.col("_holds"), F.col("span_id"))).alias("exact"), F.min(near).alias("near"))
    return each.select("item_id", "n", "exact", "near")


def _by_index(q: DataFrame, s: DataFrame, least: float) -> DataFrame:
    """What ``_by_comparing`` gives, by rarest grams and words; items that nothing is found for are left out."""
    exact = kept(quotes_in_spans(q.select("item_id", "session_id", "_q"), s.select("session_id", "span_id", "_s")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("span_id").alias("exact")), "exact-quotes")
    rest = q.where(F.size("_qt") >= 3).join(exact.select("item_id").hint("merge"), "item_id", "left_anti").select("item_id", "session_id", "_qt")
    near = spans_covering(rest, s.select("session_id", "span_id", "_st"), least).join(s.select("span_id", "_at").hint("merge"), "span_id")
    best = near.groupBy("item_id").agg(F.min(F.struct((-F.col("overlap")).alias("_o"), "_at", "span_id")).alias("near"))
    return exact.unionByName(best.withColumn("n", F.lit(0).cast("long")), allowMissingColumns=True)


def recover_provenance(items: DataFrame, span_table: DataFrame, least_overlap: float = 0.8) -> DataFrame:
    """(item_id, span_id): the one span of the session that holds an item's quote, or whose words cover most of it.

    items (item_id, session_id, quote), spans (session_id, span_id, text and, if there is one, idx). A quote under six
    letters, or one that several spans hold, has none; of spans that cover equally much the first counts, by idx and id.
    Up to COMPARED items of a session are compared with all its spans; in sessions of more, indexes say which ones to compare.
    """
    words = lambda c: F.array_distinct(F.filter(word_tokens(F.col(c)), lambda t: F.length(t) > 2))
    asked = items.where(F.length(F.trim(plain(F.col("quote")))) >= QUOTE).select("item_id", "session_id", canonical(F.col("quote")).alias("_q"), words("quote").alias("_qt")).where(F.length("_q") >= QUOTE)
    place = F.col("idx").cast("long") if "idx" in span_table.columns else F.lit(0).cast("long")
    q = kept(asked, "quotes")
    s = kept(span_table.select("session_id", "span_id", place.alias("_at"), canonical(F.col("text")).alias("_s"), words("text").alias("_st")), "spans")
    crowded = kept(q.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMPARED).select("session_id"), "crowded-sessions")
    found = _by_comparing(q.join(crowded, "session_id", "left_anti"), s, least_overlap)
    if not crowded.isEmpty():
        found = found.unionByName(_by_index(q.join(crowded, "session_id", "left_semi"), s.join(crowded, "session_id", "left_semi"), least_overlap))
    each = found.groupBy("item_id").agg(F.sum("n").alias("n"), F.min("exact").alias("exact"), F.min("near").alias("near"))
    one = F.when(F.col("n") == 1, F.col("exact")).when(F.col("n") == 0, F.col("near.span_id"))
    return each.select("item_id", one.alias("span_id")).where(F.col("span_id").isNotNull())
