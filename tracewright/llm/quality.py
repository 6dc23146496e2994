"""Quality rules: a threshold table compiled into map-only Spark projections without user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.llm.words import words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"

# Function words of the learned languages, fixed values.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "as", "was", "are", "this", "it", "be", "by",
    "der", "die", "und", "das", "ist", "den", "von", "zu", "mit", "ein", "eine", "nicht", "auf", "im", "sich",
    "le", "la", "les", "de", "et", "des", "un", "une", "du", "est", "dans", "pour", "que", "qui", "par", "sur",
    "el", "los", "las", "y", "por", "con", "se", "del", "para", "una", "no",
]


@dataclass(frozen=True)
class Rule:
    """A ratio of two counted columns and the closed range in which it passes; an open end is None."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        # Compared without a division, so that an empty whole needs no special case.
        part, whole = F.col(self.part), F.col(self.whole)
        tests = [part >= self.low * whole] if self.low is not None else []
        tests += [part <= self.high * whole] if self.high is not None else []
        return reduce(Column.__and__, tests, F.lit(True))


RULES = [
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.125),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.0078125, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.625),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.875),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.375),
]


def _count(array: Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("long")


def _same_hash(ranked: Column, j: Column, k: Column) -> Column:
    return F.coalesce(F.get(ranked, j)["h"] == F.get(ranked, k)["h"], F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """Each input row as struct ``row``, beside it the counts that the rules read.

    Windows are compared by their 64-bit hash within one text; only texts in which a hash
    recurs are sorted. A null or empty text has no words, so every count is 0.
    """
    step = docs.select(F.struct("*").alias("row")).withColumn("text", F.coalesce("row.text", F.lit("")))
    step = step.withColumn("words", words(F.col("text")))
    windows = F.when(
        F.size("words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = step.select(
        "row", "text", windows.alias("hashes"), lines.alias("lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _count(F.col("words"), lambda w: F.lower(w).isin(STOP_WORDS)).alias("n_stop_words"),
    )
    ranked = F.array_sort(F.transform("hashes", lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    step = step.withColumn(
        "ranked",
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), ranked),
    )
    twice = F.filter(
        F.sequence(F.lit(0), F.size("ranked") - 1),
        lambda j: _same_hash(F.col("ranked"), j, j - 1) | _same_hash(F.col("ranked"), j, j + 1),
    )
    places = F.sort_array(F.transform(twice, lambda j: F.get("ranked", j)["at"]))
    step = step.withColumn("places", F.when(F.col("ranked").isNotNull(), places))
    # Each place covers a window, less what the place before it has covered.
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")),
        lambda acc: acc["n"],
    )
    n_lines = F.size("lines").cast("long")
    counts = F.struct(
        "n_words", "word_chars", "n_symbols", "n_stop_words", n_lines.alias("n_lines"),
        (n_lines - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _count(F.col("lines"), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*\u2022]")).alias("n_bullet_lines"),
        _count(F.col("lines"), lambda x: x.rlike(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$")).alias("n_ellipsis_lines"),
        F.when(F.col("places").isNull(), F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"),
    )
    # A filter on a count is not pushed below a generator, where it would repeat all the work in each of its terms.
    return step.select("row", F.inline(F.array(counts)))


def judged(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``: the base passes, and so does every rule of the table."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    verdict = reduce(Column.__and__, [r.passes() for r in rules], F.lit(True))
    return measured(docs).withColumns({"base_failed": failed, "kept": ~failed & verdict})


def verdicts(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per input row: ``doc_id``, all counts, ``base_failed`` and ``kept``. Repeated rows repeat."""
    found = judged(docs, rules)
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])


def accepted(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows that pass, with all their columns, whatever these are called."""
    return judged(docs, rules).filter("kept").select("row.*")
