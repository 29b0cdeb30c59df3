"""Quality rules against a plain count, and the order of the cascade."""

import re

from pyspark.sql import functions as F

from gapmatch.llm import cascade as C
from gapmatch.llm import queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    n, chars, symbols = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    dups = len(lines) - len(set(lines))
    failed = n < 20 or 100 * len(covered) > 30 * n
    letters = sum(any(c.isalpha() for c in w) for w in words)
    dotted = sum(bool(re.search(r"(\.\.\.|…)[ \t\n\x0b\f\r]*\Z", x)) for x in lines)
    bullets = sum(bool(re.match(r"[ \t\x0b\f\r]*[-*•]", x)) for x in lines)
    good = not failed and 2 * chars >= 5 * n and chars <= 12 * n and 10 * symbols <= n and 10 * dups <= 3 * len(lines) \
        and 10 * letters >= 7 * n and 10 * dotted <= 3 * len(lines) and 10 * bullets <= 9 * len(lines)
    return n, chars, symbols, dups, len(covered), failed, good


PROSE = "the quick brown fox jumps over a lazy dog while many small birds watch from their old trees near our river today"
HARD = [
    None, "", " \n\t", "a b", PROSE, PROSE.upper(), " ".join([PROSE] * 3), "\n".join([PROSE] * 5), PROSE + "\n\n" + PROSE, "x" * 2000, "1 " * 50,
    " ".join(f"w{i}" for i in range(3000)), " ".join(f"# {i}" for i in range(40)), "\n".join(f"- item number {i} of the list" for i in range(30)),
    "\n".join(f"line {i} ends so..." for i in range(30)), "\n".join(f"line {i} ends so…  " for i in range(30)), "żółw ünï 漢字 " * 20, PROSE + "\x85\xa0" + PROSE,
    "one two three four five six seven eight " + PROSE + " one two three four five six seven eight nine", "a " * 100000, PROSE.replace(" ", "\x0b"),
]


def test_rules_equal_a_plain_count(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(HARD)] + [(5, HARD[6], "y", 2), (None, PROSE, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_words string, kept int")
    got = sorted(map(tuple, C.quality_rules(df).collect()))
    assert got == sorted((i, *plain(t)) for i, t, *_ in rows if i is not None)


def test_query_equals_a_plain_count(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = sorted(map(tuple, queries.op11_quality_rules(spark, FOLDER).collect()))
    assert got == sorted((r["doc_id"], *plain(r["text"])) for r in rows)


def test_empty_table(spark):
    assert C.quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_order_is_by_rejection_per_cost():
    rules = [C.Rule(name, None) for name in "abcd"]
    found = {"a": (1.0, 0.1), "b": (0.1, 0.05), "c": (0.5, 0.0), "d": (0.2, 0.0)}
    assert [r.name for r in C.ordered(rules, found)] == ["b", "a", "d", "c"]


def test_estimates_of_a_sample(spark):
    df = spark.createDataFrame([(i, "x y" if i % 2 else PROSE) for i in range(400)], "doc_id long, text string")
    found = C.estimate(C.sampled(df, rows=10_000), C.BASE)
    assert found["few_words"][1] == 0.5 and found["repeated_words"][1] == 0 and all(cost > 0 for cost, _ in found.values())
    assert 20 < C.sampled(df, rows=100).count() < 200


def test_later_rules_are_not_reached(spark):
    """A rule that would fail on rejected texts is not evaluated on them; the filter keeps all columns."""
    fails = C.Rule("fails", lambda m: F.when(m("n_words") < 3, F.raise_error(F.lit("reached")).cast("boolean")).otherwise(False))
    df = spark.createDataFrame([(1, "a b", 7), (2, PROSE, 8)], "doc_id long, text string, extra int")
    short = C.Rule("short", lambda m: m("n_words") < 3)
    got = df.select("doc_id", C.cascade([short, fails], F.col("text")).alias("rule")).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "short"), (2, None)]
    assert [tuple(r) for r in C.filtered(df).collect()] == [(2, PROSE, 8)]
