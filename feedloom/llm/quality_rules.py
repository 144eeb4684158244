"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Only built-in functions are used. Every measure is computed row by row, so nothing is shuffled and a hot source or a
group of copies weighs no more than its rows.

Defined results: null and blank texts have no words, every measure 0, base_failed true and kept false. Rows are
judged one by one, so repeated rows and ids, null ids and an empty table need no care; columns of the input that
share a name with a measure are left alone by ``measures`` (it returns a struct) and by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, free, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are with as by be this at from an a or have not but he she they you we his her which their has had were been",
    "fr": "le la les de des du et en un une est que qui dans pour sur pas au aux avec par ce il elle ne se plus son sa ses",
    "de": "der die das und ist in den von zu mit ein eine im nicht auf für des dem sich auch es an als nach bei aus er sie",
    "es": "el la los las de del y en un una es que por para con no se su al lo como más sus le ha",
}


@dataclass(frozen=True)
class Rule:
    """``measure`` / ``per`` must lie in [least, most]; judged from ``min_words`` words on."""

    name: str
    measure: str
    per: str
    least: float
    most: float
    min_words: int = 0


#: Bounds lie well outside what clean prose of the four languages shows (mean length 3 to 9, no symbols, a tenth of stop words).
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbol_ratio", "n_symbols", "word_chars", 0.0, 0.05),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.04, 1.0, min_words=20),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by the WINDOW-word windows that are found twice or more in the array ``words``.

    Hashes only show whether a row can have repeats at all; those that do are settled on the windows themselves.
    """
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    any_twice = F.transform(F.array(hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h))[0]
    windows = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["w"] == F.get(s, k)["w"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        step = lambda j: F.coalesce(F.least(F.lit(WINDOW), F.get(p, j + 1) - F.get(p, j)), F.lit(WINDOW))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda n, j: n + step(j))

    bound = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  evaluates value once
    return F.when(F.size(words) < WINDOW, 0).when(~any_twice, 0).otherwise(bound(bound(windows, repeated), covered)).cast("long")


def measures(docs: DataFrame, into: str = "__quality", text: str = "text") -> DataFrame:
    """Adds the struct column ``into`` with all measures, ``base_failed`` and ``kept``."""
    body = F.coalesce(F.col(text), F.lit(""))
    drop = lambda c, chars: F.translate(c, chars, "")
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    has_word = lambda line: F.length(drop(line, BLANKS)) > 0
    at = free(docs, "words"), free(docs, "lines")
    with_words = docs.withColumn(at[0], words_of(F.col(text))).withColumn(at[1], F.filter(F.split(body, "\n", -1), has_word))
    words, lines = map(F.col, at)
    row = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(drop(body, BLANKS)).cast("long").alias("word_chars"),
        (F.length(body) - F.length(drop(body, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    # a generator of one row: a filter on the verdict stays above it, so that no measure is worked out twice
    counted = with_words.select("*", F.explode(F.array(row)).alias(into)).drop(*at)
    m = F.col(into)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return counted.withColumn(into, m.withField("base_failed", failed)).withColumn(into, m.withField("kept", ~m["base_failed"] & compiled(m)))


def compiled(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression, in whole numbers of parts so that no division can fail."""
    good = F.lit(True)
    for r in rules:
        value, per = m[r.measure].cast("double"), m[r.per].cast("double")
        good = good & ((m["n_words"] < r.min_words) | ((value >= r.least * per) & (value <= r.most * per)))
    return good


def quality(docs: DataFrame) -> DataFrame:
    """doc_id with the measures and the verdict of each row."""
    return measures(docs.select("doc_id", "text")).select("doc_id", "__quality.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    into = free(docs, "quality")
    return measures(docs, into).filter(F.col(into)["kept"]).drop(into)
