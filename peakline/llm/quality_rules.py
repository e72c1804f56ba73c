"""Quality rules, lines first: lines that look like symbols, shouting, menus, fragments or boilerplate are removed, then
documents that lost too much of their text are rejected. Column expressions only; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from peakline.llm.common import WORD, whole_text

SYMBOL = r"[#*$%&|<>]"
#: Marks that may end a sentence, closing quotes and brackets included.
ENDING = r"[.!?:;…。！？\"'”’»)\]]$"
#: Phrases of licence, legal, cookie and site texts, matched in lower case.
BOILERPLATE = (r"all rights reserved|licensed under|released under the|spdx-license-identifier|copyright \(c\)|terms of (use|service)|privacy policy|"
               r"cookie (policy|settings)|use of cookies|enable javascript|sign up for our|subscribe to our|follow us on|powered by wordpress|lorem ipsum")


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules.

    A line fails with more than one symbol per `words_per_symbol` words (menus with bars among them), more than one "!!" per
    `words_per_shout` words, fewer than `heading_words` words and no mark at its end, or a boilerplate phrase. A
    document is rejected when its remaining lines have less than `least_share` of its words.
    """

    words_per_symbol: int = 4
    words_per_shout: int = 4
    heading_words: int = 10
    least_share: float = 0.5
    min_words: int = 50
    repeat_percent: int = 50


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line with at least one word is removed."""
    words = _count(line, WORD)
    return ((_count(line, SYMBOL) * rules.words_per_symbol > words) | (_count(line, "!!") * rules.words_per_shout > words)
            | ((words < rules.heading_words) & ~F.rtrim(line).rlike(ENDING)) | F.lower(line).rlike(BOILERPLATE))


#: Positions of the words that lie in a window of three words found at least twice. Windows are sorted by
#: hash, so equal ones are neighbours; the arrays are bound as lambda variables and computed once.
_REPEATED = """size(array_distinct(flatten(transform(
    transform(array(words), ws -> transform(
        array(array_sort(transform(slice(ws, 1, greatest(size(ws) - 2, 0)), (w, i) -> struct(xxhash64(w, get(ws, i + 1), get(ws, i + 2)) AS h, i AS p)))),
        s -> filter(s, (x, i) -> get(s, i - 1).h <=> x.h OR get(s, i + 1).h <=> x.h))[0])[0],
    x -> array(x.p, x.p + 1, x.p + 2)))))"""


def judge(docs: DataFrame, rules: LineRules = LineRules(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdict on every document, and what its cleaned text would be.

    Returns one row per row: id_col as doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words,
    n_lines_removed and clean_text. A null text counts as empty; texts without words are rejected by the word limit, whatever the rules.
    Lines without a word are neutral. Repeated rows are judged alike, other columns ignored whatever their names,
    and an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    split = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("lines", F.split("text", "\n", -1))
    lines = F.filter("lines", lambda line: line.rlike(WORD))
    good = F.filter("lines", lambda line: ~line.rlike(WORD) | ~line_fails(line, rules))
    seen = split.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOL).cast("long").alias("n_symbols"), lines.alias("worded"), good.alias("good"),
        F.size("lines").alias("n_lines"), F.expr(_REPEATED).cast("long").alias("n_repeat_words"))
    judged = seen.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.array_join("good", "\n").alias("clean_text"), (F.col("n_lines") - F.size("good")).cast("long").alias("n_lines_removed"))
    words = _count(F.col("clean_text"), WORD).cast("long")
    kept = ~F.col("base_failed") & (words >= rules.least_share * F.col("n_words"))
    return judged.withColumn("kept_words", words).withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words", "n_lines_removed", "clean_text")


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, without their failing lines; columns as in `docs`, n_chars brought up to date."""
    judged = judge(docs.select(F.struct("*").alias("row"), "text"), rules, id_col="row").filter("kept")
    fresh = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*((fresh[c] if c in fresh else F.col("doc_id")[c]).alias(c) for c in docs.columns))


def sql(rules: LineRules = LineRules(), select: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_words, n_lines_removed",
        source: str = "documents") -> str:
    """The same verdicts in DuckDB's SQL."""
    ending, boilerplate = ENDING.replace("'", "''"), BOILERPLATE
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {source}),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT rid, regexp_extract_all(t, '{WORD}') AS ws FROM d)),
t3 AS (SELECT rid, p, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY p)),
r AS (SELECT *, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AS twice FROM t3),
c AS (SELECT rid, w, max(twice) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM r),
n AS (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (covered) AS n_repeat_words FROM c GROUP BY rid),
l AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM d)),
lw AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n, len(regexp_extract_all(line, '{SYMBOL}')) AS syms, len(regexp_extract_all(line, '!!')) AS shouts FROM l),
lf AS (SELECT *, n > 0 AND (syms * {rules.words_per_symbol} > n OR shouts * {rules.words_per_shout} > n OR (n < {rules.heading_words} AND NOT regexp_matches(rtrim(line, ' '), '{ending}'))
       OR regexp_matches(lower(line), '{boilerplate}')) AS fails FROM lw),
lt AS (SELECT rid, (count(line) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0))::BIGINT AS n_dup_lines, coalesce(sum(n) FILTER (NOT fails), 0)::BIGINT AS kept_words,
       count(*) FILTER (fails) AS n_lines_removed, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT fails), '') AS clean_text FROM lf GROUP BY rid),
j AS (SELECT d.*, coalesce(n.n_words, 0) AS n_words, coalesce(n.word_chars, 0) AS word_chars, len(regexp_extract_all(t, '{SYMBOL}'))::BIGINT AS n_symbols, lt.n_dup_lines, coalesce(n.n_repeat_words, 0) AS n_repeat_words,
       lt.kept_words, lt.n_lines_removed, lt.clean_text FROM d JOIN lt USING (rid) LEFT JOIN n USING (rid)),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM j)
SELECT {select} FROM (SELECT *, NOT base_failed AND kept_words >= {rules.least_share} * n_words AS kept FROM b)"""
