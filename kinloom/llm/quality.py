"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import WORD, documents, register, text_or_empty, words_of

# Function words of the languages in the corpus.
STOP_WORDS = {
    "en": "the be to of and that have with in is was for on as at by an this it are from or",
    "fr": "le la les de des du et un une que qui dans pour par sur ne pas est en au",
    "de": "der die das und den dem ein eine nicht mit von zu auf für sich ist auch sch",
    "es": "el los las una que por con del para como pero más se lo no su al es y",
}

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """A document fails when ``measure`` is below ``low`` or above ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are 0 where their denominator is 0.
RULES = (
    Rule("length", "n_words", low=50, high=None),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("bullets", "bullet_ratio", high=0.9),
    Rule("ellipses", "ellipsis_ratio", high=0.3),
)


def _counts(docs: DataFrame) -> DataFrame:
    """Word and line counts of every text, without user functions."""
    stop = sorted({w for text in STOP_WORDS.values() for w in text.split()})
    cut = docs.select(
        "doc_id",
        text_or_empty().alias("t"),
        words_of(text_or_empty()).alias("w"),
        F.filter(F.split(text_or_empty(), "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    ).withColumn("n", F.size("w"))
    # Windows sorted by their words bring equal ones side by side.
    windows = F.when(
        F.col("n") >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.col("n") - 3),
                lambda i: F.struct(
                    F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("v"), i.alias("i")
                ),
            )
        ),
    )
    sorted_windows = cut.select("*", windows.alias("s"))
    found_again = F.filter(
        "s", lambda x, j: (x["v"] == F.get("s", j - 1)["v"]) | (x["v"] == F.get("s", j + 1)["v"])
    )
    at = sorted_windows.select("*", F.sort_array(F.transform(found_again, lambda x: x["i"])).alias("p")).drop("s")
    # Each repeated window adds the words that the one before it did not cover.
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"), p.alias("last")),
    )["sum"]
    return at.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).cast("long").alias("n_ellipsis_lines"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one array-of-names expression: the rules a document fails."""
    tests = []
    for rule in rules:
        failed = F.lit(False)
        if rule.low is not None:
            failed = failed | (F.col(rule.measure) < F.lit(rule.low))
        if rule.high is not None:
            failed = failed | (F.col(rule.measure) > F.lit(rule.high))
        tests.append(F.when(failed, F.lit(rule.name)))
    return F.array_compact(F.array(*tests))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ratios, the base verdict and the failed rules of every document.

    One narrow projection: no shuffle, no Python, whole texts. A null text has no word and
    fails the base. Repeated rows are judged row by row, an empty table gives no row, and
    columns other than ``doc_id`` and ``text`` are not looked at.
    """
    measured = _counts(docs).select(
        "*",
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_symbols", "n_words").alias("symbol_ratio"),
        _ratio("n_stop_words", "n_words").alias("stop_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _ratio("n_bullet_lines", "n_lines").alias("bullet_ratio"),
        _ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_ratio"),
        ((F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)).alias("base_failed"),
    )
    judged = measured.select("*", compile_rules(rules).alias("failed_rules"))
    return judged.select("*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for text in STOP_WORDS.values() for w in text.split()}))
    tests = []
    for rule in RULES:
        if rule.low is not None:
            tests.append(f"{rule.measure} >= {rule.low}")
        if rule.high is not None:
            tests.append(f"{rule.measure} <= {rule.high}")
    ratio = "CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM s),
win AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS v FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM win WHERE v IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i FROM rep UNION SELECT doc_id, i + 1 FROM rep UNION SELECT doc_id, i + 2 FROM rep) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
      CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
      len(lines) AS n_lines,
      len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullet_lines,
      len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS n_ellipsis_lines
      FROM s LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, {ratio.format(a='word_chars', b='n_words')} AS mean_word_chars, {ratio.format(a='n_symbols', b='n_words')} AS symbol_ratio,
      {ratio.format(a='n_stop_words', b='n_words')} AS stop_ratio, {ratio.format(a='n_dup_lines', b='n_lines')} AS dup_line_ratio,
      {ratio.format(a='n_bullet_lines', b='n_lines')} AS bullet_ratio, {ratio.format(a='n_ellipsis_lines', b='n_lines')} AS ellipsis_ratio,
      n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(tests)} AS kept, n_stop_words FROM r"""


@register("op10_quality_rules", _sql())
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words"
    )
