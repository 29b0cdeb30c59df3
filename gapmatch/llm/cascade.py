"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition on a text. On a sample each rule is run alone: the time it takes is its cost, the share of
texts it rejects its selectivity. The rules then stand in one CASE expression, by rejection per cost, which stops
at the first rule that rejects. The order changes the work, never the verdict, which is the conjunction.

Every measure is an expression on the text alone, so a rule that is not reached costs nothing. Measures that are
reported for every row are computed once, before the cascade, and its rules read them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..storage import written

SAMPLE = 2000  #: texts in the sample, about
WINDOW = 8
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def _count(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_count(text, F.lit(pattern)).cast("long")


def _size(values: Column) -> Column:
    return F.size(values).cast("long")


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def dup_lines(text: Column) -> Column:
    return let(worded_lines(text), lambda lines: _size(lines) - _size(F.array_distinct(lines)))


def windows(words: Column) -> Column:
    """A 64-bit name for each of the 8-word windows: a window is the pair of its halves."""
    def pairs(names: Column, step: int) -> Column:
        return let(names, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step))))

    names = F.transform(words, lambda w: F.xxhash64(w))
    return F.slice(pairs(pairs(pairs(names, 1), 2), 4), F.lit(1), F.size(words) - (WINDOW - 1))


def _covered(names: Column) -> Column:
    """Words in windows whose name occurs twice: such windows by place, each adding its words up to the next one."""
    ranked = F.sort_array(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    return let(let(ranked, repeated), lambda p: F.aggregate(
        F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, n: total + n))


def repeat_words(text: Column) -> Column:
    none = F.lit(0).cast("long")
    return let(word_list(text), lambda words: F.when(F.size(words) < WINDOW, none).otherwise(
        let(windows(words), lambda names: F.when(F.size(F.array_distinct(names)) == F.size(names), none).otherwise(_covered(names)))))


#: Measures of a text that is not null.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda text: _size(word_list(text)),
    "word_chars": lambda text: F.char_length(text) - _count(BLANK)(text),
    "n_symbols": _count(r"[#*$%&|<>]"),
    "n_lines": lambda text: _size(worded_lines(text)),
    "n_dup_lines": dup_lines,
    "n_repeat_words": repeat_words,
    "n_letter_words": _count(r"[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*"),
    "n_dotted_lines": lambda text: _size(F.filter(worded_lines(text), lambda line: line.rlike(r"(\.\.\.|…)\s*$"))),
    "n_bullet_lines": lambda text: _size(F.filter(worded_lines(text), lambda line: line.rlike(r"^\s*[-*•]"))),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``rejects`` holds; it is given a function from the name of a measure to its Column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What every kept text must pass.
BASE = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_words", lambda m: m("n_repeat_words") * 100 > m("n_words") * 30),
)
#: Widely used limits for prose of any language.
MORE = (
    Rule("word_length", lambda m: (m("word_chars") * 2 < m("n_words") * 5) | (m("word_chars") > m("n_words") * 12)),
    Rule("symbols", lambda m: m("n_symbols") * 10 > m("n_words")),
    Rule("repeated_lines", lambda m: m("n_dup_lines") * 10 > m("n_lines") * 3),
    Rule("letters", lambda m: m("n_letter_words") * 10 < m("n_words") * 7),
    Rule("dotted_lines", lambda m: m("n_dotted_lines") * 10 > m("n_lines") * 3),
    Rule("bullet_lines", lambda m: m("n_bullet_lines") * 10 > m("n_lines") * 9),
)


def _measure(text: Column, given: dict[str, str]) -> Callable[[str], Column]:
    return lambda name: F.col(f"`{given[name]}`") if name in given else MEASURES[name](text)


def sampled(docs: DataFrame, text: str = "text", reported: Sequence[str] = (), rows: int = SAMPLE) -> DataFrame:
    """(text, reported measures) of about ``rows`` rows drawn at random, stored."""
    drawn = docs.filter(F.rand(11) < rows / max(docs.count(), 1)).select(F.coalesce(text, F.lit("")).alias("text"))
    return written(drawn.select("text", *[MEASURES[name](F.col("text")).alias(name) for name in reported]), "rule-sample")


def estimate(sample: DataFrame, rules: Sequence[Rule]) -> dict[str, tuple[float, float]]:
    """(seconds, share rejected) of each rule alone on a sample; measures it has as columns cost nothing more."""
    measure = _measure(F.col("text"), {c: c for c in sample.columns if c in MEASURES})

    def run(condition: Column) -> tuple[float, float]:
        start = time.perf_counter()
        share = sample.agg(F.coalesce(F.avg(condition.cast("int")), F.lit(0.0))).first()[0]
        return time.perf_counter() - start, share

    idle = min(run(F.char_length("text") < 0)[0] for _ in range(3))
    found = {}
    for rule in rules:
        runs = [run(rule.rejects(measure)) for _ in range(2)]
        found[rule.name] = (max(min(r[0] for r in runs) - idle, 1e-3), runs[0][1])
    return found


def ordered(rules: Sequence[Rule], estimates: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejection per cost; rules that reject nothing of the sample come last, the cheapest first."""
    return sorted(rules, key=lambda r: (-estimates[r.name][1] / estimates[r.name][0], estimates[r.name][0]))


def cascade(rules: Sequence[Rule], text: Column, given: dict[str, str] | None = None) -> Column:
    """The name of the first rule that rejects, null if none does. Later rules are not evaluated."""
    measure, verdict = _measure(text, given or {}), F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(measure), rule.name).otherwise(verdict)
    return verdict


def filtered(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, text: str = "text", rows: int = SAMPLE) -> DataFrame:
    """The rows of docs that no rule rejects, columns unchanged. A null text counts as empty."""
    order = ordered(rules, estimate(sampled(docs, text, rows=rows), rules))
    return docs.filter(cascade(order, F.coalesce(text, F.lit(""))).isNull())


def quality_rules(docs: DataFrame, base: Sequence[Rule] = BASE, more: Sequence[Rule] = MORE, rows: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text). Returns a row per row: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept).

    The five measures are reported for all rows, so rules on them cost nothing more; the others run as a cascade on
    the rows that pass ``base``. A null text is empty: it has no words and fails. Rows without an id take no part;
    repeated rows are judged one by one; an empty table gives no rows; further columns are ignored. Words are compared
    in windows by 64-bit names within one text.
    """
    source = docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    measured = source.select("doc_id", "text", *[MEASURES[name](F.col("text")).alias(name) for name in REPORTED])
    given = {name: name for name in REPORTED}
    order = ordered(more, estimate(sampled(source, reported=REPORTED, rows=rows), more))
    judged = measured.withColumn("base_failed", cascade(base, F.col("text"), given).isNotNull())
    verdict = cascade(order, F.col("text"), given).isNull()
    return judged.select("doc_id", *REPORTED, "base_failed", (~F.col("base_failed") & verdict).alias("kept"))
