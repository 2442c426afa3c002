"""Operator 8, quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import table
from lexweave.llm.text_stats import with_statistics


class Rule(NamedTuple):
    """Passes when ``scale * part`` lies in [low * whole, high * whole]; None: no bound. Integer arithmetic only."""

    name: str
    part: str
    whole: str
    scale: int
    low: int | None
    high: int | None


#: Production thresholds on length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1, 2, 14),
    Rule("symbol_ratio", "n_symbols", "n_words", 100, None, 10),
    Rule("upper_ratio", "n_upper", "word_chars", 100, None, 40),
    Rule("bang_ratio", "n_bangs", "n_words", 100, None, 30),
    Rule("digit_ratio", "n_digits", "word_chars", 100, None, 30),
    Rule("long_word_ratio", "n_long_words", "n_words", 100, None, 20),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 100, 2, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", 100, None, 30),
)
BASE_WORDS, BASE_REPEAT = 20, 30


def passes(rule: Rule) -> Column:
    part, whole = F.col(rule.part) * rule.scale, F.col(rule.whole)
    tests = [part >= whole * rule.low] if rule.low is not None else []
    tests += [part <= whole * rule.high] if rule.high is not None else []
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``failed_rules`` (names) and ``kept``.

    Null, empty and blank texts fail the base (no word). One row out per row in, repeated rows and ties included;
    an empty table gives an empty result; input columns that share a name with an output are replaced.
    """
    own = ("base_failed", "failed_rules", "kept")
    counted = with_statistics(docs.select(*[c for c in docs.columns if c not in own]), text)
    base = (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEAT)
    failed = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]))
    judged = counted.select("*", base.alias("base_failed"), failed.alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.concat_ws(",", "failed_rules").alias("failed_rules"),
    )


def _sql_rules() -> str:
    tests = []
    for r in RULES:
        bad = ([f"{r.scale} * {r.part} < {r.low} * {r.whole}"] if r.low is not None else []) + ([f"{r.scale} * {r.part} > {r.high} * {r.whole}"] if r.high is not None else [])
        tests.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    return ", ".join(tests)


def _sql() -> str:
    from lexweave.llm.text_stats import BLANKS, DIGITS, STOP_WORDS, SYMBOLS, UPPER

    count = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    stops = ", ".join(f"'{w}'" for w in sorted({v for w in STOP_WORDS for v in (w, w.capitalize())}))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {blanks}, '')) > 0) AS l FROM d),
g AS (SELECT doc_id, unnest(range(len(w) - 7)) AS i, w FROM s WHERE len(w) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, i + 1, i + 8), ' ')) AS c FROM g),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM h WHERE c > 1) GROUP BY doc_id),
k AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {blanks}, '')) AS BIGINT) AS word_chars,
             CAST({count(SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
             {count(UPPER)} AS n_upper, {count(DIGITS)} AS n_digits, {count("!")} AS n_bangs,
             len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words,
             len(list_filter(w, lambda x: length(x) > 20)) AS n_long_words
      FROM s LEFT JOIN r USING (doc_id)),
j AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT} * n_words AS base_failed,
             array_to_string(list_filter([{_sql_rules()}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM j"""


OP8_SQL = _sql()
