"""Line-first cleaning: rules per line, then the document by what is left of it. DataFrame functions only.

A line fails if it is a fragment (under five words and no closing punctuation), a navigation bar (many separators),
noise (symbols, shouted or repeated words) or boilerplate (braces of code, or known phrases of whole words, one in under 15
words; a long line that mentions one stays). Failed lines are removed; a
document that loses more than half of its word characters is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import WORD_BREAK

CLOSING = r"[.!?:;…。！？：；][\"'”’»)\]]*[\x20\x09-\x0D]*$"
PHRASES = r"(?i)lorem ipsum|enable javascript|accept (all )?cookies|uses cookies|cookie policy|terms of use|privacy policy|sign in|log in|skip to content|subscribe to our|click here"
WHOLE_PHRASES = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{PHRASES.removeprefix('(?i)')})(?![\p{{L}}\p{{N}}])"
FEWEST_WORDS_A_PHRASE = 15
SEPARATORS = r"[|»›•·]"
SYMBOLS = r"[#*$%&|<>]"
NOISE = r"[#*$%&|<>{}~^_=\\]"
SHOUTED = r"!!"
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50
LEAST_LEFT_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_verdict(line: Column) -> Column:
    """Whether a line with a word stays."""
    n_words = F.size(words_of(line))
    return ~(
        ((n_words < 5) & ~line.rlike(CLOSING))
        | (F.regexp_count(line, F.lit(SEPARATORS)) * 4 >= n_words)
        | (F.regexp_count(line, F.lit(NOISE)) * 2 >= n_words)
        | (F.regexp_count(line, F.lit(SHOUTED)) * 2 >= n_words)
        | ((n_words >= 8) & (F.size(F.array_distinct(words_of(line))) * 5 < n_words * 2))
        | (F.regexp_count(line, F.lit(WHOLE_PHRASES)) * FEWEST_WORDS_A_PHRASE > n_words)
    )


def with_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and one more, `_quality`: a struct of n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, clean_text.

    Words are runs of anything but ASCII white space; a null text has none. `n_repeat_words` compares windows by a
    64-bit hash within a text. `clean_text` is the lines that stay, joined by newlines; empty lines do not matter. A
    text that fails the base rules, or has under half of its word characters in lines that stay, is not kept. No row
    is dropped, and rows do not depend on each other, so nulls, ties and repeated rows need no rule.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumn("_text", text).withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split(F.col("_text"), "\n"), has_word))
    df = df.withColumn("_hashes", F.when(F.size("_words") < 3, F.array().cast("array<bigint>")).otherwise(F.slice(F.transform(
        F.col("_words"), lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2))),
        F.lit(1), F.greatest(F.size("_words") - 2, F.lit(1)))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(
        F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_twice", F.sort_array(F.filter(F.transform("_sorted", lambda p, k: F.when(
        (p["h"] == F.get(F.col("_sorted"), k - 1)["h"]) | (p["h"] == F.get(F.col("_sorted"), k + 1)["h"]), p["i"])), lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("_twice", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_twice"), k + 1) - i, F.lit(3)))),
                          F.lit(0), lambda a, x: a + x)
    df = df.withColumn("_clean", F.filter("_lines", line_verdict))
    df = df.withColumn("_n", F.struct(
        F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.char_length(F.array_join(F.flatten(F.transform("_clean", words_of)), "")).cast("long").alias("clean_chars")))
    n = F.col("_n")
    failed = (n["n_words"] < FEWEST_WORDS) | (100 * n["n_repeat_words"] > MOST_REPEATED_PERCENT * n["n_words"])
    df = df.withColumn("_quality", F.struct(
        *[n[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"),
        (~failed & (100 * n["clean_chars"] >= LEAST_LEFT_PERCENT * n["word_chars"])).alias("kept"),
        F.array_join("_clean", "\n").alias("clean_text")))
    return df.drop("_text", "_words", "_lines", "_hashes", "_sorted", "_twice", "_clean", "_n")


def clean_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns; texts stay as they are.

    The verdict passes through a generator, as a plain filter would be pushed down and spell out all of it again.
    """
    verdict = F.explode_outer(F.filter(F.array("_quality.kept"), lambda kept: kept))
    return with_quality(docs, text_col).withColumn("_kept", verdict).where("_kept").drop("_quality", "_kept")
