"""Whole-text statistics as native Spark columns: the inputs of the quality rules and of the rule ensemble.

Words are runs of anything but blank and U+0009 to U+000D; a null text has none. Every statistic is a count over
the whole text, in one projection without shuffle or user function. Rows stay independent: repeated rows, ties and
extra columns pass through unchanged (internal names start with ``_ts_``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import SPACE_CLASS, text_or_empty

WINDOW = 8
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on as with be by this are at from or have an they which you were her all she there would their"
    " de la le et les des un une du en que est pour dans qui par sur au pas avec"
    " der die und den von zu das mit sich auf für ist im dem nicht ein eine"
    " el los se del las por con no una su para es al lo como más"
).split()
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"
DIGITS = "0123456789"
STOPS = ".,;:!?"
BLANKS = " \t\n\x0b\x0c\r"
#: Names of the counts that ``with_statistics`` adds, all long.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
    "n_marks", "n_bangs", "n_stop_words", "n_distinct_words", "n_long_words", "n_pipes", "max_word_chars",
)


def _count_of(marked: Column, chars: str) -> Column:
    """How many code points of ``marked`` are among ``chars``."""
    return F.char_length(marked) - F.char_length(F.translate(marked, chars, ""))


def _paired(col: str, step: int) -> Column:
    """Hash of each entry with the one ``step`` further on; of fewer than step + 1 entries, none."""
    many = F.greatest(F.size(col) - step, F.lit(0))
    return F.zip_with(F.slice(col, F.lit(1), many), F.slice(col, F.lit(step + 1), many), lambda a, b: F.xxhash64(a, b))


def _repeat_starts(order: Column) -> Column:
    """Starts of the 8-word windows found twice or more; ``order``: window hashes with their starts, sorted."""
    twice = F.filter(
        order,
        lambda x, i: (x["h"] == F.get(order, i - 1)["h"]) | (x["h"] == F.get(order, i + 1)["h"]),
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["at"]))
    return starts


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of COUNTS; clashing columns of the input are replaced.

    Null, empty and blank texts have zero words. n_dup_lines: lines with a word, equal to an earlier line.
    n_repeat_words: words inside 8-word windows found twice or more in the text, the first one included.
    """
    kept = [c for c in docs.columns if c not in COUNTS]
    base = docs.select(*kept, text_or_empty(text).alias("_ts_text"))
    split = base.withColumns(
        {
            "_ts_words": F.filter(F.split("_ts_text", SPACE_CLASS), lambda w: w != ""),
            "_ts_lines": F.filter(F.split("_ts_text", "\n"), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]"))),
        }
    )
    hashed = split.withColumns(
        {
            "_ts_n": F.size("_ts_words"),
            "_ts_hashes": F.transform("_ts_words", lambda w: F.xxhash64(w)),
            "_ts_marked": F.regexp_replace("_ts_text", f"[^{re.escape(SYMBOLS + STOPS)}{UPPER}{DIGITS}]+", ""),
        }
    )
    # Windows by doubling (pairs, pairs of pairs, pairs of those); a column for each step, so that none is computed twice.
    hashed = hashed.withColumn("_ts_w2", _paired("_ts_hashes", 1)).withColumn("_ts_w4", _paired("_ts_w2", 2)).withColumn("_ts_windows", _paired("_ts_w4", 4))
    repeated = hashed.withColumn("_ts_twice", F.size("_ts_windows") > F.size(F.array_distinct("_ts_windows"))).withColumn(
        "_ts_order",
        F.when(
            F.col("_ts_twice"),
            F.sort_array(F.transform("_ts_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ),
    )
    starts = repeated.withColumn("_ts_starts", F.when(F.col("_ts_twice"), _repeat_starts(F.col("_ts_order"))))
    many = F.size("_ts_starts")
    covered = F.when(
        F.col("_ts_twice"),
        F.aggregate(
            F.zip_with(
                F.slice("_ts_starts", F.lit(1), many - 1),
                F.slice("_ts_starts", F.lit(2), many - 1),
                lambda a, b: F.least(b - a, F.lit(WINDOW)),
            ),
            F.lit(WINDOW),
            lambda total, x: total + x,
        ),
    ).otherwise(0)
    marked = F.col("_ts_marked")
    lengths = F.transform("_ts_words", lambda w: F.char_length(w))
    stops = sorted({v for w in STOP_WORDS for v in (w, w.capitalize())})
    long = {
        "n_words": F.col("_ts_n"),
        "word_chars": F.aggregate("_ts_words", F.lit(0), lambda total, w: total + F.char_length(w)),
        "n_symbols": _count_of(marked, SYMBOLS),
        "n_dup_lines": F.size("_ts_lines") - F.size(F.array_distinct("_ts_lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("_ts_lines"),
        "n_upper": _count_of(marked, UPPER),
        "n_digits": _count_of(marked, DIGITS),
        "n_marks": _count_of(marked, STOPS),
        "n_bangs": _count_of(marked, "!"),
        "n_stop_words": F.size(F.filter("_ts_words", lambda w: w.isin(*stops))),
        "n_distinct_words": F.size(F.array_distinct("_ts_hashes")),
        "n_long_words": F.size(F.filter("_ts_words", lambda w: F.char_length(w) > 20)),
        "n_pipes": _count_of(marked, "|"),
        "max_word_chars": F.coalesce(F.array_max(lengths), F.lit(0)),
    }
    return starts.select(*kept, *[v.cast("long").alias(k) for k, v in long.items()])
