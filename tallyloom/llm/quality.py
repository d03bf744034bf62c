"""Line-first cleaning of web text, by built-in functions only.

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines are removed, and a
document goes if it has lost too much of its text or fails the plain counts of words and repeats.

Edge cases: a null text counts as empty: it has no words and is rejected; repeated rows are judged
alike; an empty table gives an empty result; input columns whose names the report uses are replaced.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.plans.small import fence

SPACES = " \t\n\x0b\x0c\r"          # the white space that separates words
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MORE_SYMBOLS = "{}[]=_~^\\"
BARS = "|»›•"
MARKS = r"[#*$%&|<>{}\[\]=_~^\\»›•]"  # any of the three
WINDOW = 5

#: Phrases of menus, notices and page furniture, matched in the lower-case line.
BOILERPLATE = ("cookie policy", "accept cookies", "we use cookies", "privacy policy", "terms of service",
               "terms of use", "all rights reserved", "enable javascript", "lorem ipsum", "click here",
               "read more", "sign up for our newsletter", "subscribe to our", "log in or register",
               "share on facebook", "share on twitter", "skip to content", "back to top")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more, windows told by a 64-bit hash. Windows that are all
    distinct need no sorting."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        """The windows sorted by hash; those equal to a neighbour, by place; the sum of what each adds."""
        def repeated(s: Column) -> Column:
            same = F.filter(starts, lambda j: (F.get(s, j)["h"] == F.get(s, j - 1)["h"]) |
                            F.coalesce(F.get(s, j)["h"] == F.get(s, j + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda j: F.get(s, j)["i"]))

        def count(p: Column) -> Column:
            before = F.transform(p, lambda i, k: F.when(k == 0, WINDOW).otherwise(F.least(i - F.get(p, k - 1), F.lit(WINDOW))))
            return F.aggregate(before, F.lit(0), lambda a, x: a + x)

        windows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return _once(_once(F.sort_array(windows), repeated), count)

    counted = _once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(counted).cast("long")


def _has_phrase(text: Column) -> Column:
    def any_of(low: Column) -> Column:
        found = F.lit(False)
        for p in BOILERPLATE:
            found = found | low.contains(p)
        return found

    return F.exists(F.array(F.lower(text)), any_of)


def line_failure(line: Column, max_symbol_share: float = 0.3, max_pipes_per_word: float = 0.3) -> Column:
    """Why a line fails, or null: ``symbols`` (too many of its characters are symbols), ``navigation``
    (items between bars), ``boilerplate`` (a known phrase makes up a short line). Lines without a word
    never fail: they are separators."""
    body = _without(line, SPACES)
    n = F.length(body)
    words = F.size(_words(line))
    symbols = n - F.length(_without(body, SYMBOLS + MORE_SYMBOLS)) > max_symbol_share * n
    navigation = (words >= 6) & (n - F.length(_without(body, BARS)) > max_pipes_per_word * words)
    marked = line.rlike(MARKS)
    return (F.when(marked & symbols, "symbols").when(marked & line.rlike(f"[{BARS}]") & navigation, "navigation")
            .when(_has_phrase(line) & (words <= 25), "boilerplate"))


def clean_lines(text: Column) -> Column:
    """The text without failing lines. A line fails by a mark or by a phrase, so a text that has neither stays as it is
    without a look at its lines."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: line_failure(x).isNull()), "\n")
    return F.when(text.rlike(MARKS) | _has_phrase(text), kept).otherwise(text)


def judge_quality(docs: DataFrame, text: str = "text", min_words: int = 10, max_repeat_percent: int = 20,
                  max_lost: float = 0.5) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``clean_text``, ``lost`` (share of the word characters on removed lines) and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of the words
    in repeated windows. ``kept``: not failed and ``lost`` at most ``max_lost``."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.col("__words")
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost",
             "kept")
    base = docs.select(*[c for c in docs.columns if c not in added], _words(body).alias("__words"),
                       lines.alias("__lines"), clean_lines(body).alias("clean_text"))
    word_chars = F.length(F.array_join(words, ""))
    symbols = F.when(body.rlike(f"[{SYMBOLS}]"), F.length(body) - F.length(_without(body, SYMBOLS))).otherwise(0)
    counted = base.select(
        "*", F.size(words).cast("long").alias("n_words"), word_chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words")).drop("__words", "__lines")
    failed = ((F.col("n_words") < min_words) |
              (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words")))
    left = F.length(_without(F.col("clean_text"), SPACES))
    untouched = (F.col("word_chars") == 0) | (F.col("clean_text") == body)
    return (counted.withColumn("base_failed", failed)
            .withColumn("lost", F.when(untouched, 0.0).otherwise(1.0 - left / F.col("word_chars")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost)))


def keep_clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept rows of ``judge_quality``. The fence keeps the optimizer from copying the whole judgement into the filter."""
    return fence(judge_quality(docs, text), "kept").withColumnRenamed("value", "kept").where("kept")
