"""Quality rules: a threshold table compiled into one Spark projection.

``measure`` adds the ratios' integer parts as columns and ``verdict`` turns a table of
``Rule`` rows into one projection over them. Everything is a built-in expression, so
there is no shuffle and no Python on the executors: each row is judged where it is read.

Defined results for edge cases: a null or empty text has no words and fails the base
rules; very long texts are measured whole; repeated rows are judged alike, row by row; an
empty table gives an empty result; further columns of the input pass through ``judge``
unchanged, apart from columns that have the name of a measure, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, set_aside

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "on", "be", "are", "this", "as", "by", "at", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "est", "pour", "qui", "dans", "que", "par", "plus", "pas", "au", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo"],
}

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document fails if ``100 * part < low * whole`` or ``100 * part > high * whole``.

    A rule with ``whole == ""`` compares ``part`` itself with the limits.
    """

    name: str
    part: str
    whole: str = ""
    low: int | None = None
    high: int | None = None


BASE_RULES = (
    Rule("too_short", "n_words", low=20),
    Rule("repeated_words", "n_repeat_words", "n_words", high=30),
)

RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1400),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=30),
    Rule("stop_words", "n_stop_words", "n_words", low=1),
    Rule("shouting", "n_upper", "n_letters", high=60),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures that the rules refer to; the helper columns do not stay."""
    own = docs.select([c for c in docs.columns if c.lower() not in MEASURES or c == text])
    given, keep = set_aside(own, (*MEASURES, *HELPERS))
    back = {new: c for new, c in zip(keep, own.columns, strict=True) if c.lower() not in MEASURES}
    docs, text = given, keep[own.columns.index(text)]
    body = F.coalesce(F.col(text), F.lit(""))
    squeezed = F.translate(body, " \t\n\x0b\x0c\r", "")
    has_word = "[^" + SPACE_CLASS[1:]
    # The longest step first, one helper a projection: Spark then evaluates each once.
    one = docs.select(
        *keep,
        F.array_remove(F.split(body, SPACE_CLASS + "+"), "").alias("_w"),
        F.split(body, "\n").alias("_l"),
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(body, r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    two = one.select(
        *keep,
        *(c for c in MEASURES if c in one.columns),
        F.size("_w").cast("long").alias("n_words"),
        F.filter("_l", lambda x: x.rlike(has_word)).alias("_l"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(_stop_words()))).cast("long").alias("n_stop_words"),
        _windows(F.col("_w")).alias("_h"),
    )
    three = two.select(
        *keep,
        *(c for c in MEASURES if c in two.columns),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        # Nearly all texts repeat no window: only the others pay for the sort.
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _sorted_windows(F.col("_h"))).alias("_s"),
    )
    four = three.select(*keep, *(c for c in MEASURES if c in three.columns), _repeat_starts(F.col("_s")).alias("_p"))
    # The row's number (never below 0) keeps the optimiser from moving a condition on the
    # measures below these projections, where it would copy each helper wherever it is used.
    fixed = F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
    return four.select(*(F.col(new).alias(c) for new, c in back.items()), *((_covered(F.col("_p")) + fixed).alias(c) if c == "n_repeat_words" else F.col(c) for c in MEASURES))


#: In the order in which they appear in the result.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_upper", "n_letters")

#: Columns of the projections in between.
HELPERS = ("_w", "_l", "_h", "_s", "_p")


def _stop_words() -> list[str]:
    return sorted({w for words in STOP_WORDS.values() for w in words})


def _windows(words: Column) -> Column:
    """A 64-bit hash of each window of eight words, by its place."""
    last = F.size(words) - (WINDOW - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def _sorted_windows(hashes: Column) -> Column:
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeat_starts(pairs: Column) -> Column:
    """Places of the windows that occur again, from windows sorted by hash and place."""
    again = lambda x, j: (F.coalesce(F.get(pairs, j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False)))
    return F.sort_array(F.transform(F.filter(pairs, again), lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """How many words lie in a window that starts at one of these places."""
    steps = F.transform(starts, lambda p, j: F.least(F.coalesce(F.get(starts, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def _fails(rule: Rule) -> Column:
    part, whole = F.col(rule.part), F.col(rule.whole) if rule.whole else None
    found = F.lit(False)
    if rule.low is not None:
        found = found | (part < rule.low if whole is None else part * 100 < whole * rule.low)
    if rule.high is not None:
        found = found | (part > rule.high if whole is None else part * 100 > whole * rule.high)
    return found


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a measured row fails, in table order."""
    return F.array_compact(F.array(*(F.when(_fails(r), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")


def judge(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with its measures, base_failed, kept and the names of the failed rules."""
    measured = measure(docs.drop("base_failed", "kept", "failed_rules"), text)
    named = measured.select("*", (F.size(compile_rules(base)) > 0).alias("base_failed"), compile_rules(base + rules).alias("failed_rules"))
    return named.select("*", (F.size("failed_rules") == 0).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass every rule, with the columns of docs, also those that have the name of a measure."""
    given, names = set_aside(docs, (*MEASURES, "base_failed", "kept", "failed_rules"))
    passed = judge(given, names[docs.columns.index(text)]).filter("kept")
    return passed.select(*(F.col(new).alias(c) for new, c in zip(names, docs.columns, strict=True)))


#: The same verdicts in DuckDB's SQL.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
wins AS (
  SELECT *, CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], chr(10))) ELSE [] END AS h
  FROM words),
placed AS (
  SELECT doc_id, unnest(h) AS win, generate_subscripts(h, 1) AS pos FROM wins WHERE len(h) > len(list_distinct(h))),
again AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS c FROM placed) WHERE c > 1),
steps AS (
  SELECT doc_id, least(8, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 8)) AS step FROM again),
covered AS (SELECT doc_id, sum(step)::BIGINT AS n FROM steps GROUP BY doc_id),
m AS (
  SELECT wins.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: list_contains([__STOP__], lower(x))))::BIGINT AS n_stop_words,
         (length(body) - length(regexp_replace(body, '\p{Lu}+', '', 'g')))::BIGINT AS n_upper,
         length(regexp_replace(body, '\P{L}+', '', 'g'))::BIGINT AS n_letters
  FROM wins LEFT JOIN covered ON wins.doc_id = covered.doc_id),
j AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 1400 * n_words
            OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_stop_words < n_words
            OR 100 * n_upper > 60 * n_letters) AS kept
FROM j
""".replace("__STOP__", ", ".join(f"'{w}'" for w in _stop_words()))
