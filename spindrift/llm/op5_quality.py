"""Quality rules: a table of thresholds compiled into one projection, no user functions.

Every measure of a text comes from one expression; each rule compares a ratio of
two measures with integer bounds, cross-multiplied, so engines agree to the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it not of on or that the this to was were which with "
    "au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour qui que se son sur un une "
    "als auf auch aus bei das dem den der des die ein eine es für im ist mit nach nicht sich sie und von zu "
    "al como con del el ella las lo los más no para pero por se su sus una y"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low`` <= ``scale`` * ``part`` / ``whole`` <= ``high``; a bound of None is open, no ``whole`` holds."""

    name: str
    part: str
    whole: str
    scale: int
    low: int | None
    high: int | None

    def sql(self) -> str:
        sides = []
        if self.low is not None:
            sides.append(f"{self.scale} * {self.part} >= {self.low} * {self.whole}")
        if self.high is not None:
            sides.append(f"{self.scale} * {self.part} <= {self.high} * {self.whole}")
        return "(" + " AND ".join(sides) + ")"


#: Production thresholds; percentages where scale is 100.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1, 3, 10),
    Rule("symbol_ratio", "n_symbols", "n_words", 100, None, 10),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 100, 8, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", 100, None, 40),
)
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def measures(text: str = "text", stop_words: tuple[str, ...] | list[str] = tuple(STOP_WORDS)) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words.

    Words are maximal runs without U+0020/U+0009..U+000D.  Equal 3-word windows are
    found by sorting (64-bit hash, position), so time grows as n log n with a text.
    """
    space = r"' \t\n\u000B\u000C\r'"
    windows = "CASE WHEN size(w) < 3 THEN array() ELSE transform(sequence(0, size(w) - 3), i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) AS h, i AS i)) END"
    windows = windows.replace("array()", "cast(array() AS array<struct<h:bigint,i:int>>)")
    twice = "filter(s, (x, k) -> coalesce(get(s, k + 1).h = x.h, false) OR (k > 0 AND coalesce(get(s, greatest(k - 1, 0)).h = x.h, false)))"
    covered = "aggregate(sort_array(transform(" + twice + ", x -> x.i)), struct(0L AS c, -3 AS last), (a, x) -> struct(a.c + least(3, x - a.last) AS c, x AS last), a -> a.c)"
    repeat = _bind(f"sort_array({windows})", "s", covered)
    stop = "cast(size(filter(w, x -> lower(btrim(x, '.,;:!?\"()')) IN (" + ", ".join(map(_sql_text, stop_words)) + "))) AS bigint)"
    of_words = f"named_struct('n_words', cast(size(w) AS bigint), 'n_repeat_words', {repeat}, 'n_stop_words', {stop})"
    words = _bind(f"btrim(t, {space})", "b", r"CASE WHEN b = '' THEN cast(array() AS array<string>) ELSE split(b, '[\\x20\\x09-\\x0D]+', -1) END")
    lines = f"filter(split(t, '\\n', -1), l -> btrim(l, {space}) <> '')"
    of_lines = _bind(lines, "ls", "named_struct('n_lines', cast(size(ls) AS bigint), 'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) AS bigint))")
    body = (
        f"named_struct('word_chars', cast(length(translate(t, {space}, '')) AS bigint), "
        f"'n_symbols', cast(length(t) - length(translate(t, '{SYMBOLS}', '')) AS bigint), "
        f"'of_words', {_bind(words, 'w', of_words)}, 'of_lines', {of_lines})"
    )
    return F.expr(_bind(f"coalesce(cast(`{text}` AS string), '')", "t", body))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with measures, base_failed, kept and failed_rules (names of the rules not met).

    A null text counts as empty: no words, base_failed.  Each row is judged by its
    own text alone, so repeated rows get equal verdicts and an empty table gives no
    rows.  Columns of ``docs`` that bear a measure's name are replaced.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "base_failed", "kept", "failed_rules")
    kept_cols = [F.col(f"`{c}`") for c in docs.columns if c not in names or c == text_col]
    m = F.col("__m")
    held = docs.select(*kept_cols, measures(text_col).alias("__m"))
    flat = held.select(
        *kept_cols,
        *(m["of_words"][n].alias(n) for n in ("n_words", "n_repeat_words", "n_stop_words")),
        *(m["of_lines"][n].alias(n) for n in ("n_lines", "n_dup_lines")),
        *(m[n].alias(n) for n in ("word_chars", "n_symbols")),
    )
    verdict = " AND ".join(r.sql() for r in rules) or "true"
    failed = "filter(array(" + ", ".join(f"CASE WHEN NOT {r.sql()} THEN '{r.name}' END" for r in rules) + "), x -> x IS NOT NULL)"
    return flat.select("*", F.expr(BASE_FAILED).alias("base_failed"), F.expr(f"NOT {BASE_FAILED} AND {verdict}").alias("kept"), F.expr(failed).alias("failed_rules"))


def drop_rejected(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with its columns; judged as in ``quality``."""
    judged = quality(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col("text")), rules)
    return judged.where("kept").select("__doc.*")


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*RESULT)


def measures_sql(source: str, extra: str = "") -> str:
    """DuckDB SQL of ``quality`` over ``source`` (doc_id, text and the columns ``extra``), one row a row."""
    stop = ", ".join("'" + w + "'" for w in STOP_WORDS)
    verdict = " AND ".join(r.sql() for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {source}),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win),
covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY rid),
m AS (SELECT w.*, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: lower(trim(x, '.,;:!?"()')) IN ({stop}))) AS n_stop_words
      FROM w LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
       NOT {BASE_FAILED} AND {verdict} AS kept{extra} FROM m"""


ORACLE_SQL = measures_sql("documents")
