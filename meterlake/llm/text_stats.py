"""Statistics of whole texts with DataFrame functions only; no row leaves its task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANK, WORD

#: A word without a letter or digit.
MARK = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"
WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_exclaims", "n_stops", "n_digits", "n_letters", "n_marks")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: lambdas in body would compute a plain expression again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered(windows: Column) -> Column:
    """Positions that lie in a window whose hash occurs twice or more; windows start at 0, 1, 2 ..."""

    def repeats(pairs: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before, after = F.get(pairs, i - 1), F.get(pairs, i + 1)
            return x["h"].eqNullSafe(before["h"]) | x["h"].eqNullSafe(after["h"])

        return F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["i"]))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    # with starts in order, each window adds what the one before it doesn't reach
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"))
    return F.aggregate(let(pairs, repeats), start, step, lambda a: a["n"])


def repeat_words(hashes: Column) -> Column:
    """Words in 5-word windows that occur twice or more; hashes: one 64-bit hash for each word."""

    def of(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))

    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(let(hashes, of))


def document_stats(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and STATS (long) of every row; a null text counts as the empty one.

    Words are compared by 64-bit hash inside one text: for 20,000 words, two differing windows
    agree by chance once in some 10**11 texts.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(*keep, t.alias("_t"))
    hashed = base.select(
        *keep, "_t",
        F.transform(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_h"),
        F.split("_t", "\n").alias("_l"),
    )
    lines = F.filter("_l", lambda x: x.rlike(WORD))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern))
    return hashed.select(
        *keep,
        F.size("_h").cast("long").alias("n_words"),
        (F.length("_t") - count(BLANK)).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_h")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct_words"),
        count(r"[A-ZÀ-ÖØ-Þ]").cast("long").alias("n_upper"),
        count("!").cast("long").alias("n_exclaims"),
        count(r"[.?]").cast("long").alias("n_stops"),
        count("[0-9]").cast("long").alias("n_digits"),
        count(r"\p{L}").cast("long").alias("n_letters"),
        count(MARK).cast("long").alias("n_marks"),
    )
