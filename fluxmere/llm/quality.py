"""Quality rules: a threshold table compiled into one native projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words.
SPLIT = "[ \\t-\\r]+"
NO_SPACE = "[^ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words, a few of each language.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "for", "with", "was", "on", "be",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "zu", "ein", "nicht", "auf",
    "le", "la", "les", "et", "des", "de", "du", "est", "un", "une", "que", "pour",
    "el", "los", "las", "y", "en", "por", "con", "no", "se", "del", "para", "su",
)


@dataclass(frozen=True)
class Rule:
    """A text fails if ``measure`` lies outside [low, high]; a null bound doesn't bind."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Measures are those that ``measures`` names.
RULES = (
    Rule("too_few_words", "n_words", low=50),
    Rule("too_many_words", "n_words", high=1_000_000),
    Rule("short_words", "mean_word_chars", low=1.5),
    Rule("long_words", "mean_word_chars", high=25),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("stop_words", "stop_ratio", low=0.01),
    Rule("repeated_lines", "dup_line_ratio", high=0.50),
    Rule("repeated_words", "repeat_word_ratio", high=0.50),
    Rule("shouting", "upper_ratio", high=0.60),
)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a projection has no other local variables."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT), "")


def repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are sorted with their places, so equal ones are neighbours: n log n, no pairs. A text
    whose windows are all distinct skips the sort. A window stands as its 64-bit hash: two different
    windows of one text meet by chance once in about 10^11 texts of 20,000 words.
    """

    def marked(s: Column) -> Column:
        t = lambda k: F.get(s, k)["t"]
        twice = F.filter(s, lambda x, k: x["t"].eqNullSafe(t(k - 1)) | x["t"].eqNullSafe(t(k + 1)))
        return let(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            lambda p: F.coalesce(
                F.aggregate(
                    F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
                F.lit(0).cast("long"),
            ),
        )

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        return F.transform(F.slice(w, 1, n), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def counted(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("t"), i.alias("i")))), marked)
        )

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(windows(words), counted))


def measures(text: Column) -> Column:
    """A struct of all measures of one text. Null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))

    def lines(x: Column) -> Column:
        kept = F.filter(F.split(x, "\n"), lambda s: s.rlike(NO_SPACE))
        return let(kept, lambda k: F.struct(F.size(k).alias("n"), (F.size(k) - F.size(F.array_distinct(k))).alias("dup")))

    def all_of(words: Column) -> Column:
        n, chars = F.size(words), F.char_length(F.array_join(words, ""))
        low = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
        return F.struct(
            n.cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            lines(text).alias("lines"),
            repeated(words).alias("n_repeat_words"),
            low.cast("long").alias("n_stop_words"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        )

    return let(word_list(text), all_of)


def ratios(m: Column) -> dict[str, Column]:
    d = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return {
        "n_words": m["n_words"].cast("double"),
        "mean_word_chars": d(m["word_chars"], m["n_words"]),
        "symbol_ratio": d(m["n_symbols"], m["word_chars"]),
        "stop_ratio": d(m["n_stop_words"], m["n_words"]),
        "dup_line_ratio": d(m["lines"]["dup"], m["lines"]["n"]),
        "repeat_word_ratio": d(m["n_repeat_words"], m["n_words"]),
        "upper_ratio": d(m["n_upper"], m["word_chars"]),
    }


def compile_rules(rules, m: Column) -> Column:
    """The names of the failed rules, as one array expression."""
    r = ratios(m)
    tests = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (r[rule.measure] < rule.low)
        if rule.high is not None:
            bad = bad | (r[rule.measure] > rule.high)
        tests.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*tests))


def quality(df: DataFrame, rules=RULES, text: str = "text", out: str = "quality") -> DataFrame:
    """Add ``out``: a struct of measures, ``failed`` (names of failed rules) and ``kept``.

    One projection of built-in functions, no shuffle, no Python. A null or empty text has no words
    and fails ``too_few_words``; an empty table stays empty; other columns pass through, but for one
    already named ``out``, which is replaced; repeated rows are judged each by itself. Very long
    texts cost n log n.
    """
    m = measures(F.col(f"`{text}`"))
    value = let(m, lambda x: let(compile_rules(rules, x), lambda f: F.struct(
        x.alias("m"), f.alias("failed"), (F.size(f) == 0).alias("kept"))))
    return df.withColumn(out, value)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = quality(docs)
    m = F.col("quality.m")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return q.select(
        "doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["lines"]["dup"].cast("long").alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & F.col("quality.kept")).alias("kept"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), m AS (
  SELECT rid, doc_id, text, ws, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(list_filter(ws, lambda x: lower(x) IN (STOPLIST))) AS n_stop,
         len(array_to_string(ws, '')) - len(regexp_replace(array_to_string(ws, ''), '[A-Z]', '', 'g')) AS n_upper
  FROM w
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM m WHERE len(ws) >= 3)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM dup) GROUP BY rid
), j AS (
  SELECT m.*, coalesce(n, 0) AS n_repeat_words FROM m LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words <= 1000000
       AND word_chars::DOUBLE / n_words BETWEEN 1.5 AND 25 AND n_symbols::DOUBLE / word_chars <= 0.10
       AND n_stop::DOUBLE / n_words >= 0.01 AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.50
       AND n_upper::DOUBLE / word_chars <= 0.60 AS kept
FROM j
""".replace("STOPLIST", ", ".join(f"'{w}'" for w in STOP_WORDS))
