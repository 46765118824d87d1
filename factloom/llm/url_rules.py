"""URL filters: listed host and path rules, and association rules mined from labels.

``mine`` lets Spark's FP-growth find the combinations of URL tokens that go with bad
labels; support, confidence and redundancy prune them. Tokens that make a rule alone are
taken first. Tokens that stand on the same labelled rows are one item, as no rule needs two of them, and
tokens on all rows are none. FP-growth makes all combinations of a row's items, twice as many with
each; so where a row has more than ``most_items``, the combinations are found level by level instead
(``_by_levels``), which leaves out those that a shorter one implies, and gives the same rules. The counts
of what is found are then taken over all labelled rows. ``verdicts`` judges every URL, whole:
listed rules first (the longest that fits), else the mined rules, matched through an
inverted index from token to rule. Only DataFrame functions are used.

The urls are matched as distinct texts, so a page repeated often costs no more than one.

Defined results for edge cases: a null URL, or one without ``://``, has an empty host and
path, no tokens and the verdict allow; very long URLs are judged whole; repeated rows are
judged alike, row by row; without labels there are no mined rules; an empty table gives an
empty result; further columns of the input pass through, apart from columns named as a
result, which are replaced. Of labels repeated for one document the worst counts, and null
labels do not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_hot_key, materialise, release, set_aside

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class ListedRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


@dataclass(frozen=True)
class Mining:
    """min_count and min_share bound the support from below, confidence is in percent.

    Up to most_items items a row FP-growth is used, beyond it the search by levels.
    """

    min_count: int = 20
    min_share: float = 0.001
    confidence: int = 60
    most_items: int = 14


def _lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    whole = F.coalesce(F.col(url), F.lit(""))
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.drop("host", "path").select("*", _lower(F.regexp_extract(whole, cut, 1)).alias("host"), F.regexp_extract(whole, cut, 2).alias("path"))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, each named after its place."""
    whole = F.coalesce(url, F.lit(""))
    part = lambda k: _lower(F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)", k))
    words = lambda kind, text, cut: F.transform(F.array_remove(F.split(text, cut), ""), lambda w: F.concat(F.lit(kind), w))
    keys = F.transform(F.array_remove(F.split(part(3), "&"), ""), lambda w: F.concat(F.lit("query:"), F.substring_index(w, "=", 1)))
    return F.array_distinct(F.concat(words("host:", part(1), r"\."), words("path:", part(2), "[^a-z0-9]+"), keys))


def listed(host: Column, path: Column, rules: tuple[ListedRule, ...]) -> Column:
    """Struct (rule, verdict) of the longest listed rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _holding(rows: DataFrame, sets: DataFrame, counts: DataFrame) -> DataFrame:
    """(antecedent, n, n_bad) of the given sets, counted over all rows (_b, _t): each set is looked up by its rarest token."""
    rare = sets.select("antecedent", F.explode("antecedent").alias("_token")).join(counts.select("_token", F.col("n").alias("_n")), "_token")
    index = rare.groupBy("antecedent").agg(F.min(F.struct("_n", "_token")).alias("_r")).select("antecedent", F.col("_r._token").alias("_token"))
    held = rows.select("_b", "_t", F.explode("_t").alias("_token")).join(index, "_token").where(F.size(F.array_except("antecedent", "_t")) == 0)
    return held.groupBy("antecedent").agg(F.count(F.lit(1)).alias("n"), F.count_if("_b").alias("n_bad"))


def _smallest(sure: DataFrame) -> DataFrame:
    """The sets of which no part is another of them, from the shortest up."""
    left, kept = sure, None
    while (size := left.agg(F.min(F.size("antecedent"))).first()[0]) is not None:
        least = left.where(F.size("antecedent") == size)
        kept = least if kept is None else kept.union(least)
        # A part is looked up by its last token, then all of its tokens have to be there.
        known = least.select(F.element_at("antecedent", -1).alias("_token"), F.col("antecedent").alias("_part"))
        longer = left.where(F.size("antecedent") > size)
        parts = longer.select("antecedent", F.explode("antecedent").alias("_token")).join(known, "_token").where(F.size(F.array_except("_part", "antecedent")) == 0)
        left = materialise(longer.join(parts.select("antecedent").distinct(), "antecedent", "left_anti"), "longer-rules")
    return sure if kept is None else kept


def _items(each: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(_token, item): tokens that stand on the same rows share an item, the least of them. Tokens of all rows have none.

    Sets of rows are told apart by their number and two sums of hashes.
    """
    prints = each.groupBy("_token").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64("_r", F.lit(k)).cast("decimal(38,0)")).alias(f"_s{k}") for k in (1, 2)))
    some = prints.join(counts.select("_token"), "_token").where(F.col("n") < total)
    least = some.groupBy("n", "_s1", "_s2").agg(F.min("_token").alias("item"), F.collect_list("_token").alias("_all"))
    return least.select("item", F.explode("_all").alias("_token"))


def _by_growth(items: DataFrame, least: int) -> DataFrame:
    """(antecedent, n_bad) of the combinations of two or more items (_i) on at least so many rows."""
    held = items.count()
    if held < least:
        return items.select(F.col("_i").alias("antecedent"), F.lit(0).cast("long").alias("n_bad")).limit(0)
    growth = FPGrowth(itemsCol="_i", minSupport=max(least - 0.5, 0.5) / held, minConfidence=0.0)
    return growth.fit(items).freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("n_bad"))


def _by_levels(rows: DataFrame, sure: Callable[[DataFrame], DataFrame], least: int) -> DataFrame:
    """The antecedents of two or more items that are sure, from rows (_r, _b, _i), each from parts that are not.

    A combination is followed only if it has the support, is not sure itself (no rule needs more), and
    stands on fewer rows than each of its parts. Otherwise the item that a part already implies can be
    left out of every longer combination.
    """
    item = rows.select("_r", "_b", F.explode("_i").alias("x"))
    level = materialise(item.select("_r", "_b", F.array("x").alias("antecedent")), "level")
    known = level.groupBy("antecedent").agg(F.count(F.lit(1)).alias("n"))
    found, size = None, 2
    while level.limit(1).count():
        longer = level.join(item.select("_r", "x"), "_r").where(F.col("x") > F.element_at("antecedent", -1)).select("_r", "_b", F.array_append("antecedent", F.col("x")).alias("antecedent"))
        counts = longer.groupBy("antecedent").agg(F.count(F.lit(1)).alias("n"), F.count_if("_b").alias("n_bad")).where(F.col("n_bad") >= least)
        parts = counts.select("antecedent", "n", F.explode(F.transform("antecedent", lambda x: F.array_remove("antecedent", x))).alias("_part"))
        free = parts.join(known.select(F.col("antecedent").alias("_part"), F.col("n").alias("_n")), "_part").where(F.col("n") < F.col("_n"))
        free = free.groupBy("antecedent").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == size).select("antecedent")
        counts = materialise(counts.join(free, "antecedent"), "level-counts")
        certain = sure(counts).select("antecedent")
        found = certain if found is None else found.union(certain)
        known = counts.join(certain, "antecedent", "left_anti").select("antecedent", "n")
        before, level = level, materialise(longer.join(known.select("antecedent"), "antecedent"), "level")
        release(before)
        size += 1
    release(level)
    return level.select("antecedent").limit(0) if found is None else found


def _spelled(sets: DataFrame, items: DataFrame) -> DataFrame:
    """antecedents of items as those of tokens: one for each choice of the tokens that share an item."""
    out = sets.select(F.col("antecedent").alias("_left"), F.array().cast("array<string>").alias("antecedent"))
    names = items.select(F.col("item").alias("_item"), "_token")
    for _ in range(sets.agg(F.max(F.size("antecedent"))).first()[0] or 0):
        done = out.where(F.size("_left") == 0)
        more = out.where(F.size("_left") > 0).join(names, F.get("_left", F.lit(0)) == F.col("_item"))
        out = done.union(more.select(F.slice("_left", 2, 10_000).alias("_left"), F.array_append("antecedent", F.col("_token")).alias("antecedent")))
    return out.select(F.array_sort("antecedent").alias("antecedent"))


def mine(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """(antecedent array<string>, n, n_bad) from rows (url, bad): pruned rules for bad.

    A rule stays if it has the support and the confidence and if no part of its tokens is a
    rule itself.
    """
    rows = labelled.where(F.col("bad").isNotNull()).select(F.array_sort(tokens(F.col("url"))).alias("_t"), F.col("bad").cast("boolean").alias("_b"))
    rows = materialise(rows.where(F.size("_t") > 0).select("*", F.monotonically_increasing_id().alias("_r")), "labelled-tokens")
    total = rows.count()
    least = max(how.min_count, -int(-how.min_share * total // 1))
    sure = lambda found: found.where((F.col("n_bad") >= least) & (F.col("n_bad") * 100 >= F.col("n") * how.confidence))
    each = rows.select("_r", "_b", F.explode("_t").alias("_token"))
    counts = each.groupBy("_token").agg(F.count(F.lit(1)).alias("n"), F.count_if("_b").alias("n_bad")).where(F.col("n_bad") >= least)
    counts = materialise(counts, "token-counts")
    alone = sure(counts.select(F.array("_token").alias("antecedent"), "n", "n_bad"))
    others = counts.where(F.col("n_bad") * 100 < F.col("n") * how.confidence)
    items = materialise(_items(each, others, total), "items")
    with_items = each.join(items.where("_token = item"), "_token").groupBy("_r", "_b").agg(F.sort_array(F.collect_list("item")).alias("_i"))
    with_items = materialise(with_items.where(F.size("_i") > 1), "rows-of-items")
    if (with_items.agg(F.max(F.size("_i"))).first()[0] or 0) <= how.most_items:
        frequent = materialise(_by_growth(with_items.where("_b").select("_i"), least).select("antecedent"), "frequent-sets")
        likely = sure(_holding(with_items.select("_b", F.col("_i").alias("_t")), frequent, counts)).select("antecedent")
    else:
        likely = _by_levels(with_items, sure, least)
    likely = materialise(_spelled(_smallest(materialise(likely.distinct(), "likely-items")), items), "likely-rules")
    together = materialise(sure(_holding(rows, likely, counts)), "sure-rules")
    return alone.union(_smallest(together))


def blocked_urls(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """The urls that hold all tokens of a mined rule, once each, with the first such rule's text. Each rule is looked up by its rarest token."""
    index = mined.select("antecedent", F.explode("antecedent").alias("_token"))
    held = urls.where(F.col("url").isNotNull()).select("url").distinct().select("url", tokens(F.col("url")).alias("_t")).select("url", "_t", F.explode("_t").alias("_token"))
    often = held.join(index.select("_token").distinct(), "_token").groupBy("_token").agg(F.count(F.lit(1)).alias("n"))
    rarest = index.join(often, "_token").groupBy("antecedent").agg(F.min(F.struct("n", "_token"))["_token"].alias("_token"))
    hits = held.join(rarest, "_token").where(F.size(F.array_except("antecedent", "_t")) == 0)
    return hits.groupBy("url").agg(F.min(F.concat_ws(" & ", "antecedent")).alias("mined_rule"))


def verdicts(pages: DataFrame, rules: tuple[ListedRule, ...], mined: DataFrame) -> DataFrame:
    """pages with host, path, rule (listed, else null), verdict and mined_rule."""
    own = [c for c in pages.columns if c not in (*RESULTS, "mined_rule")]
    given, keep = set_aside(pages.select(own), ["_l"])
    parsed = parse(given)
    placed = parsed.select("*", listed(F.col("host"), F.col("path"), rules).alias("_l"))
    open_urls = placed.where(F.col("_l").isNull())
    if not mined.limit(1).count():
        joined = placed.withColumn("mined_rule", F.lit(None).cast("string"))
    else:
        # One row a URL; the rows of a URL that very many pages have are joined where they are.
        urls = open_urls.where(F.col("url").isNotNull()).groupBy("url").agg(F.count(F.lit(1)).alias("_n"))
        known = materialise(urls.join(blocked_urls(open_urls, mined), "url", "left").select("url", "_n", "mined_rule"), "judged-urls")
        named = F.col("url").isNotNull() & F.col("_l").isNull()
        others = placed.where(~named).withColumn("mined_rule", F.lit(None).cast("string"))
        joined = join_by_hot_key(placed.where(named), known, "url", "_n", ["mined_rule"]).unionByName(others)
    return joined.select(
        *(F.col(new).alias(c) for new, c in zip(keep, own, strict=True)), "host", "path", F.col("_l.rule").alias("rule"),
        F.coalesce(F.col("_l.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("_l").isNull(), F.col("mined_rule")).alias("mined_rule"),
    )


LISTED = (ListedRule("block", "net/"), ListedRule("allow", "example.net/en/"), ListedRule("block", "example.com/de/"), ListedRule("allow", "org/fr/"))


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose URL names a labelled document: bad is its toxic label."""
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:[/.?#]|$)", 1)
    named = pages.select("url", number.alias("_n")).select("url", F.expr("try_cast(nullif(_n, '') AS bigint)").alias("doc_id"))
    worst = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("bad"))
    return named.where(F.col("doc_id").isNotNull()).join(worst, "doc_id").select("url", "bad")


#: The same in DuckDB's SQL, but it counts combinations of up to three tokens alone.
ORACLE = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)', 2) AS path,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)', 3), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS query,
         try_cast(nullif(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:[/.?#]|$)', 1), '') AS BIGINT) AS named
  FROM pages),
tok AS (
  SELECT *, list_sort(list_distinct(list_concat(list_concat(
           list_transform(list_filter(string_split(host, '.'), lambda w: w <> ''), lambda w: 'host:' || w),
           list_transform(list_filter(regexp_split_to_array(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: 'path:' || w)),
           list_transform(list_filter(string_split(query, '&'), lambda w: w <> ''), lambda w: 'query:' || string_split(w, '=')[1])))) AS t
  FROM parts),
lab AS (SELECT doc_id, max(toxic) > 0 AS bad FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id),
seen AS (SELECT row_number() OVER () AS r, t, bad FROM tok JOIN lab ON named = doc_id WHERE len(t) > 0),
item AS (SELECT r, bad, unnest(t) AS x FROM seen),
combos AS (
  SELECT r, bad, [x] AS c FROM item
  UNION ALL SELECT a.r, a.bad, [a.x, b.x] FROM item a JOIN item b ON a.r = b.r AND a.x < b.x
  UNION ALL SELECT a.r, a.bad, [a.x, b.x, d.x] FROM item a JOIN item b ON a.r = b.r AND a.x < b.x JOIN item d ON a.r = d.r AND b.x < d.x),
least AS (SELECT greatest(20, ceil(0.001 * count(*))) AS k FROM seen),
sure AS (
  SELECT c, count(*) AS n, count(*) FILTER (bad) AS n_bad FROM combos GROUP BY c
  HAVING count(*) FILTER (bad) >= (SELECT k FROM least) AND 100 * count(*) FILTER (bad) >= 60 * count(*)),
pruned AS (
  SELECT s.c FROM sure s WHERE NOT EXISTS (
    SELECT 1 FROM sure p WHERE len(p.c) < len(s.c) AND list_has_all(s.c, p.c) AND p.n_bad * s.n >= s.n_bad * p.n)),
mined AS (SELECT DISTINCT url FROM tok JOIN pruned ON list_has_all(t, c)),
ruled AS (
  SELECT page_id, url, host, path, CASE
      WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM tok)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN url IN (SELECT url FROM mined) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
