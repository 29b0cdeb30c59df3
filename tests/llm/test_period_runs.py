"""Periodic runs against a search of every period and place."""

import hashlib
import random
from fractions import Fraction

import pytest

from gapmatch.llm import period_runs as P
from gapmatch.llm import queries

FOLDER = "/root/testdata/sf0.001"


def brute(words):
    """Runs (start, period, length) by trying every period at every place."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                part = words[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.append((i, q, length))
            i = j + 1
    return sorted(found)


def brute_row(words):
    runs = brute(words)
    drop = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    return (
        runs, best, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def hard_texts():
    rng = random.Random(12)
    texts = [None, "", " \n\t ", "a", "a " * 23, "a " * 24, "a " * 25, "a b " * 12, "a b " * 11 + "a", "x " + "a b c " * 8 + "y", "a " * 400]
    for k in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            period = rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64, 65, 100, 130])
            unit = [rng.choice("abcdefgh") for _ in range(period)]
            if rng.random() < 0.3:
                unit = unit[: max(1, period // 2)] * 2  # not the smallest period
            times = rng.uniform(2.5, 5)
            parts += (unit * 6)[: int(len(unit) * times)] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        if k % 3 == 0 and parts:
            parts[rng.randrange(len(parts))] = "Ü"
        texts.append(" x ".join([" ".join(parts)]) if k % 7 else "  " + "\r\n".join(parts) + "\x0b")
    return texts


def plain(row):
    span = lambda r: (r["start"], r["period"], r["length"])
    return [span(r) for r in row["runs"]], row["best"] and span(row["best"]), row["runs_sha256"], row["collapsed_sha256"]


def test_runs_equal_brute_force(spark):
    texts = hard_texts()
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(3, texts[9], "again"), (3, texts[9], "again"), (None, "a " * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = P.period_runs(df, texts=True).collect()
    want = [(i, *brute_row((t or "").encode().split())) for i, t, _ in rows if i is not None]
    assert sorted(((r["doc_id"], *plain(r)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(hashlib.sha256(r["text"]).hexdigest() == r["collapsed_sha256"] for r in got)
    assert sum(len(r["runs"]) for r in got) > 100


def test_tiles_of_one_long_text():
    """Runs over many tiles, in one text of 50,000 words: stitched into one interval each."""
    rng = random.Random(5)
    words = [str(rng.randrange(2000)) for _ in range(50_000)]
    words[1000:21_000] = (words[1000:6000] * 4)[:20_000]
    words[30_000:30_900] = (words[30_000:30_003] * 300)[:900]
    import numpy as np

    number = {w: i for i, w in enumerate(words)}
    codes = np.array([number[w] for w in words])
    found = {}
    for low, boundaries in P.probed(codes, len(codes)):
        high, step = max(2 * low, P.FIRST), 2 * max(low, P.FIRST)
        for b in boundaries.tolist():
            first, last = max(0, b - step), min(len(codes), b + step + high)
            for q, k, r in P.solved(codes[first:last].tolist(), b - first, low, high, step):
                found.setdefault(q, []).append((b - k, b + r))
    runs = set()
    for q, spans in found.items():
        start, end = None, None
        for a, b in [*sorted(spans), (1 << 40, 1 << 40)]:
            if start is not None and a > end and end - start + q >= max(24, 3 * q):
                runs.add((start, q, end - start + q))
            if start is None or a > end:
                start, end = a, b
            end = max(end, b)
    assert {q for _, q, _ in runs} == {3, 5000}
    assert all(words[s : s + n - q] == words[s + q : s + n] for s, q, n in runs)


def test_empty_table(spark):
    assert P.period_runs(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_query(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode().split() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op12_period_runs(spark, FOLDER).collect()
    assert len(got) == len(docs) and sum(r["n_runs"] > 0 for r in got) > 3
    for r in got:
        runs, best, listed, kept = brute_row(queries.looped(r["doc_id"], docs[r["doc_id"]]))
        want = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == (
            len(runs), *want, listed, kept)


@pytest.mark.parametrize("symbols", [[1], [1, 1, 1, 1], [1, 2, 1, 2, 1, 3], [1, 2, 3]])
def test_z_function(symbols):
    n = len(symbols)
    want = [next((k for k in range(n - i) if symbols[k] != symbols[i + k]), n - i) for i in range(n)]
    assert P.z_function(symbols) == want
