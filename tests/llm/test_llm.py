"""The training-data operators against brute force, held-out labels and hard inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gapmatch.llm import bytes_kernel as K
from gapmatch.llm import features, graph, kd_search, language, mixing, near_dedup, packing, quality, suffix_dedup, toxicity, vector_dedup, warc

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, v long"
ODD = [
    (1, None, None, None, None, "x", 1),
    (2, "", "en", "a", 0, None, 2),
    (3, " \t\n\x0b\x0c\r ", "en", None, 7, "x", 3),
    (4, "one two three four", "en", "b", 18, "x", 4),
    (4, "one two three four", "en", "b", 18, "x", 4),
    (5, "ONE Two three four", "de", "b", 18, "x", None),
    (6, "ünïcode wörds ß " * 40, "de", "a", 600, "x", 6),
    (7, "ünïcode wörds ß " * 40, None, "a", 600, "x", 7),
    (8, "x" * 3000, "en", "c", 3000, "x", 8),
    (9, "y" + "x" * 2500 + " a b c d e f", "en", "c", 2513, "x", 9),
    (10, "123 !!! 456", "en", None, 11, "x", 10),
    (None, "no id at all, and a text of more than fifty bytes in this row", "en", "a", 10, "x", 11),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- kernels -------------------------------------------------------------------------------------------------


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_shingles_do_not_depend_on_slices(monkeypatch):
    texts = ["a b c d e f g " * 30, "", "one", "x" * 90 + " tail of a long word here", " lead and trail ", "A B C D E F G"]
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    whole = K.shingle_sets(body, offsets)
    monkeypatch.setattr(K, "SLICE", 16)
    K._powers.clear()
    small = K.shingle_sets(body, offsets)
    K._powers.clear()
    assert all(np.array_equal(a, b) for a, b in zip(whole, small))
    assert np.diff(whole[1]).tolist() == [len(shingles(t)) for t in texts]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 5), (5, 7), (9, 9), (900, 100)]
    got = {r["v"]: r["m"] for r in graph.components(spark.createDataFrame(chain, "v long, m long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 900: 100, 7: 3, 5: 3}
    assert graph.components(spark.createDataFrame([], "v long, m long")).count() == 0


# --- 2: suffix-array dedup -----------------------------------------------------------------------------------


def brute_repeats(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                mark[p : p + length] = 1
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((i, len(b), int(mark.sum()), int((np.diff(np.r_[0, mark]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_equal_brute_force(spark, documents, odd):
    for df in (documents, odd.filter("doc_id is not null")):
        assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect())) == brute_repeats(rows_of(df))
    assert suffix_dedup.remove_repeats(odd.filter("doc_id < 0")).count() == 0


def test_repeats_across_slices_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcd "), 700))
    rows = [(i, base[a : a + n] + "".join(rng.choice(list("xyz"), 20)) + base[b : b + n]) for i, (a, b, n) in enumerate(rng.integers(0, 400, (30, 3)))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), texts=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute_repeats(rows)
    block = suffix_dedup._Block(0, [0], [len(base)], suffix_dedup.zstandard.compress(base.encode()), 50)
    key, _, start, count, _ = block.runs()
    monkeypatch.setattr(K, "SLICE", 64)
    key2, _, start2, count2, _ = block.runs()
    assert np.array_equal(np.repeat(key, count), np.repeat(key2, count2)) and count.sum() == count2.sum() == len(base) - 49
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=10)


def shared_passage(n):
    """Documents of random text around one passage: at its ends the runs differ in all of them."""
    rng = np.random.default_rng(6)
    own = ["".join(rng.choice(list("abcdefgh "), 160)) for _ in range(n)]
    passage = "".join(rng.choice(list("stuvwxyz "), 150))
    return [(i, t[: 60 + i % 7] + passage + t[60 + i % 7 :]) for i, t in enumerate(own)]


def test_entries_do_not_grow_with_documents_that_share_a_passage():
    rows = shared_passage(400)
    body = "".join(t for _, t in rows).encode()
    block = suffix_dedup._Block(0, [i for i, _ in rows], [len(t) for _, t in rows], suffix_dedup.zstandard.compress(body), 50)
    (key, name, doc, _), entry, (run_key, _, start, count, owner) = block.entries(7, 8)
    assert max(Counter(key.tolist()).values()) <= 8 and max(Counter(run_key.tolist()).values()) >= 390
    assert np.array_equal(key[entry], run_key) and np.all(doc[entry] <= owner) and (name == suffix_dedup.MARK).any()
    crowded = name[entry] == suffix_dedup.MARK
    places = Counter()
    for again, (window, rep, since), (number, at) in suffix_dedup._crowded_windows(block, run_key[crowded], start[crowded], count[crowded], owner[crowded]):
        places.update(again.tolist() + at.tolist())
        assert len(set(zip(window.tolist(), rep.tolist()))) == len(window) == number.max() + 1
    assert places == Counter(p for s, c in zip(start[crowded].tolist(), count[crowded].tolist()) for p in range(s, s + c))


def test_repeats_of_crowded_representatives_equal_brute_force(spark, documents, monkeypatch):
    rows = shared_passage(300) + [(400 + i, "x" * (60 + 9 * i)) for i in range(20)] + [(7, "another row of the id seven " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for runs, crowd in (((4, 64), 1 << 12), ((1, 1), 2), ((400, 400), 2)):
        monkeypatch.setattr(suffix_dedup, "RUNS", runs)
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        got = suffix_dedup.remove_repeats(df).collect()
        assert sorted(map(tuple, got)) == brute_repeats(rows)
    monkeypatch.setattr(suffix_dedup, "RUNS", (1, 1))
    monkeypatch.setattr(suffix_dedup, "CROWD", 0)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(documents).collect())) == brute_repeats(rows_of(documents))


# --- 7: MinHash near-dedup -----------------------------------------------------------------------------------


def groups(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def brute_near(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    meets = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            meets[x].add(k)
    pairs = {p for m in meets.values() for p in combinations(sorted(m), 2)}
    links = [(sets[a][0], sets[b][0]) for a, b in pairs if 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1])]
    comp = groups([i for i, _ in rows], links)
    return sorted((i, len(s), comp[i], comp[i] == i) for i, s in sets)


def test_near_duplicates_equal_brute_force(documents, odd):
    for df in (documents, odd.filter("doc_id is not null")):
        assert sorted(map(tuple, near_dedup.near_duplicates(df).collect())) == brute_near(rows_of(df))
    assert near_dedup.near_duplicates(odd.filter("doc_id < 0")).count() == 0


def test_chain_of_near_duplicates_is_one_group(spark):
    """Neighbours are linked, the ends are not: a star at the smallest document alone would break the chain."""
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(500 - i, " ".join(vocabulary[4 * i : 4 * i + 200])) for i in range(12)] + [(900 + k, " ".join(vocabulary[k : k + 60])) for k in range(5)]
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_near(rows)
    assert {r[2] for r in got if r[0] < 600} == {489}


def test_densification_fills_every_bin():
    filled = np.zeros((3, 40), bool)
    filled[0, 7] = filled[1, [3, 9]] = True
    out = near_dedup.densify(np.where(filled, np.arange(40, dtype=np.uint64) + 1, np.uint64(0)), filled)
    assert set(out[0]) == {8} and set(out[1]) == {4, 10} and set(out[2]) == {0}


# --- 3 and 9: vectors ----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score long"


def odd_vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(2).tolist(), int(i % 3), 0) for i in range(300)]
    rows += [(300 + i, (np.array(rows[i][1]) + rng.normal(size=8) * 0.1).tolist(), int(i % 3), 0) for i in range(200)]
    rows += [(600 + i, rows[5][1], 5 % 3, 0) for i in range(40)] + [(650, rows[5][1], None, 0), (651, rows[5][1], 5 % 3, 0), (651, rows[5][1], 5 % 3, 0)]
    rows += [(700, None, 1, 0), (701, [], 1, 0), (702, [0.0] * 8, 1, 0), (703, [float("nan")] * 8, 1, 0), (704, [None] + [1.0] * 7, 1, 0),
             (705, [float("inf")] * 8, 1, 0), (706, [1.0, 2.0], 1, 0), (707, [1.0, 2.1], 1, 0), (None, [1.0] * 8, 1, 0)]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def brute_vectors(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    links, count = [], Counter()
    good = [(k, np.array(r[1], np.float32).astype(float)) for k, r in enumerate(rows) if usable(r[1]) and any(r[1]) and r[2] is not None]
    for (a, x), (b, y) in combinations(good, 2):
        if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
            links.append((ids[a], ids[b]))
            count[a] += 1
            count[b] += 1
    comp = groups(ids, links)
    return sorted((i, count[k], comp[i], comp[i] == i) for k, i in enumerate(ids))


def test_near_vectors_equal_brute_force(spark):
    rows = [r for r in odd_vectors() if r[0] is not None]
    df = spark.createDataFrame(odd_vectors(), VECTORS).repartition(4)
    for tile in (None, 32):
        assert sorted(map(tuple, vector_dedup.near_vectors(df, tile=tile).collect())) == brute_vectors(rows)
    assert vector_dedup.near_vectors(df.filter("vec_id < 0")).count() == 0
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    assert sorted(map(tuple, vector_dedup.near_vectors(table, 0.5).collect())) == brute_vectors([tuple(r) for r in table.collect()], 0.5)


def test_top_k_equals_brute_force(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    whole = {(r[0], k): np.floor(np.array(r[1], np.float32).astype(float) * 256) for k, r in enumerate(rows) if r[0] is not None and usable(r[1])}
    want = []
    for (q, _), x in whole.items():
        if q % 25 == 0:
            best = sorted((-int(x @ y), i) for (i, _), y in whole.items() if i != q and len(y) == len(x))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    for shard, block in ((1 << 15, 512), (60, 7)):
        got = kd_search.top_k(df, df.filter("vec_id % 25 = 0"), shard=shard, block=block).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert kd_search.top_k(df.filter("vec_id < 0"), df).count() == 0


def test_tree_beyond_exact_doubles():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(200, 4)) * 2e7)
    tree = kd_search.Tree.load(kd_search.Tree(x, np.arange(200), 8).dump())
    got = sorted(tree.search(x[:3], np.arange(3), 4, np.full(3, -np.inf)))
    want = []
    for q in range(3):
        score = [(-sum(int(a) * int(b) for a, b in zip(x[q], y)), i) for i, y in enumerate(x) if i != q]
        want += [(q, i, -s) for s, i in sorted(score)[:4]]
    assert got == sorted(want)


# --- 4: packing ----------------------------------------------------------------------------------------------


def test_pieces_equal_the_tokenizer(documents, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    extra = [(20, "a<|endoftext|>b it's <|startoftext|> 'll don't x\x85y a\x0bb c  d e é ́f ΣΑΣ", "", "", 1, "", 1)]
    both = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(odd.sparkSession.createDataFrame(extra, DOCS).select("doc_id", "text"))
    want = []
    for i, t in rows_of(both):
        if i is None:
            continue
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got = packing.best_fit_packing(both).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got])
    assert packing.best_fit_packing(odd.filter("doc_id < 0")).count() == 0
    ids = packing.best_fit_packing(both, with_ids=True).select("ids", "length", "ids_crc32").collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in ids)


def check_sequences(rows, capacity=2048):
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def least_bins(lengths, capacity):
    """Exact number of sequences by trying all placements (small inputs)."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[k]:
                rest = list(rooms)
                rest[rest.index(room)] -= lengths[k]
                place(k + 1, rest)
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_plan_is_whole_and_near_the_optimum():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = rng.integers(3, 40, 11)
        patterns = packing.plan(np.bincount(lengths, minlength=61), 60)
        used = Counter()
        for p, m in patterns:
            assert sum(p) <= 60
            for n in p:
                used[n] += m
        assert used == Counter(lengths.tolist())
        assert sum(m for _, m in patterns) == least_bins(lengths.tolist(), 60)
    # Best-fit decreasing needs 4 here; completion finds 3.
    lengths = [6, 5, 5, 5, 4, 3, 2]
    assert sum(m for _, m in packing.best_fit(np.bincount(lengths, minlength=11), 10)) >= 3
    assert sum(m for _, m in packing.plan(np.bincount(lengths, minlength=11), 10)) == 3


# --- 5, 10 and 1: classifiers --------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) > 0.97 * len(held)
    # Labels of held-out documents change nothing.
    other = docs.withColumn("lang", F.when(features.fold(F.col("doc_id"), 3) == 1, "xx").otherwise(F.col("lang")))
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(other).collect()} == {i: r["lang_pred"] for i, r in got.items()}
    few = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert all(few[i]["lang_pred"] == "und" and few[i]["score"] == 0 for i in (1, 2, 3, 10)) and few[6]["lang_pred"] in ("de", "en", "und")
    assert all(r["lang_pred"] == "und" for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert language.identify(odd.filter("doc_id < 0")).count() == 0


def test_backoff_prefers_longer_grams():
    import pandas as pd

    counts = pd.DataFrame([("a", 0, "haus", 5), ("b", 0, "house", 5), ("a", 2, "au", 9), ("b", 2, "ou", 9), ("a", 1, "o", 50), ("b", 1, "a", 50)], columns=["lang", "kind", "gram", "n"])
    m = language.Model(counts, ["a", "b"])
    assert m.backed_off("maus").argmax() == 0 and m.backed_off("mouse").argmax() == 1
    assert m.backed_off("xa").argmax() == 1 and not m.backed_off("zz").any()


def test_toxicity_on_held_out_documents(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    bad = [i for i in held if truth[i] == 1]
    good = [i for i in held if truth[i] == 0]
    assert all(got[i]["held_out"] for i in held)
    assert sum(got[i]["predicted"] for i in bad) > 0.8 * len(bad) and sum(got[i]["predicted"] for i in good) < 0.03 * len(good)
    empty = toxicity.toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(empty) == 11 and all(r["score"] == 0 and r["predicted"] == 0 for r in empty)
    some = toxicity.toxicity(odd, spark.createDataFrame([(i, int(i == 6)) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(some) == 11 and all(0 <= r["score"] <= 1 for r in some)


def graded(n, seed):
    """Texts whose grade (0 to 3) shows in their words."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        g = int(rng.integers(0, 4))
        out.append((i, " ".join(rng.choice(["plain" + "abcdefghijklmnopqrstuvwxyz"[k] for k in range(26)], 30).tolist() + ["mark" + "qrst"[g]] * int(rng.integers(1, 4))), float(g)))
    return out


def test_quality_orders_grades(spark, odd):
    rows = graded(1500, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, rating double")
    got = {r["doc_id"]: r for r in quality.quality(docs, ratings, wanted=2).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert np.mean([abs(got[i]["expected_grade"] - g) for i, _, g in held]) < 0.4
    assert np.mean([got[i]["keep"] == (g >= 2) for i, _, g in held]) > 0.93
    none = quality.quality(odd, spark.createDataFrame([], "doc_id long, rating double")).collect()
    assert len(none) == 11 and all(r["keep"] and r["expected_grade"] is None for r in none)
    one = quality.quality(odd, spark.createDataFrame([(i, 3.0) for i in range(9)], "doc_id long, rating double")).collect()
    assert len(one) == 11 and all(r["keep"] and r["expected_grade"] == 3 for r in one)


def test_ordinal_gradient():
    one, places = np.array([2, 1, 2, 1]), np.array([70, 71, 72, 70, 73, 74])
    w, cuts, grades = quality.fit_ordinal(np.tile([0.0, 1.0, 2.0, 5.0], 200), np.r_[0, np.tile(one, 200).cumsum()], np.tile(places, 200), rounds=400, decay=0.0)
    offsets = np.r_[0, one.cumsum()]
    assert np.all(np.diff(cuts) > 0) and grades.tolist() == [0, 1, 2, 5]
    over = quality.tails((w, cuts, grades), offsets, places)
    expected = grades[0] + sum(t * g for t, g in zip(over, np.diff(grades)))
    assert np.all(np.diff(expected) > 0.5) and np.all(over[0] >= over[1])


# --- 6: mixing -----------------------------------------------------------------------------------------------


def brute_targets(sizes):
    """sizes by source: repeat sharing what the capped sources leave."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}


def test_mix_meets_targets(spark, documents, odd):
    for df in (documents, odd, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        got = mixing.mix(df).collect()
        source = {}
        want = defaultdict(int)
        for r in df.filter("doc_id is not null").collect():
            want[r["source"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
        target = brute_targets(want)
        taken = defaultdict(int)
        for r in got:
            source[r["doc_id"]] = r["source"]
            taken[r["source"]] += r["taken"]
            assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and r["source_size"] == want[r["source"]]
            assert r["target"] == pytest.approx(target[r["source"]])
            rate = r["target"] / r["source_size"] if r["source_size"] else 0
            assert r["size"] == 0 or r["copies"] in (int(rate), int(np.ceil(rate - 1e-12)))
        largest = {s: max([r["size"] for r in got if r["source"] == s]) for s in want}
        assert all(abs(taken[s] - target[s]) <= max(largest[s] / 2, 1) + 1e-6 for s in want)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(odd.filter("doc_id < 0")).count() == 0


def test_duels_keep_expectations(spark):
    """Over many ids the share of a size class that is taken stays near its probability."""
    rows = [(i, "w " * (1 + i % 7), "a") for i in range(4000)] + [(9000 + i, "w " * 4, "b") for i in range(4000)] + [(20000 + i, "w", "c") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for size in range(1, 8):
        part = [r["copies"] for r in got if r["source"] == "a" and r["size"] == size]
        rate = next(r["target"] / r["source_size"] for r in got if r["source"] == "a")
        assert abs(np.mean(part) - rate) < 0.06
    gap = {s: abs(sum(r["taken"] for r in got if r["source"] == s) - next(r["target"] for r in got if r["source"] == s)) for s in "abc"}
    assert max(gap.values()) <= 2  # half of a document of b


def test_mix_is_native(spark, documents):
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


# --- 8: WARC -------------------------------------------------------------------------------------------------


def test_audit_finds_every_change(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "h" * (i % 50)) for i in range(2000)] + [(5, "http://x/5", "again"), (5, None, None), (None, "u", "h")], "page_id long, url string, html string")
    assert {r["status"] for r in warc.audit(pages, pages, 4096).collect()} == {"ok"}
    changed = pages.filter("page_id <> 77").withColumn("html", F.when(F.col("page_id").isin(3, 1999), F.lit("bad")).otherwise(F.col("html")))
    changed = changed.union(spark.createDataFrame([(9999, "new", "page")], "page_id long, url string, html string"))
    got = warc.audit(pages, changed, 4096).collect()
    odd = {r["page_id"]: r["status"] for r in got if r["status"] != "ok"}
    assert odd == {3: "corrupt", 1999: "corrupt", 77: "missing", 9999: "extra"} and len(got) == 2003
    at = 0
    for r in sorted((r for r in got if r["offset"] is not None), key=lambda r: (r["page_id"], r["nth"])):
        assert r["offset"] == at and r["leaf"] == at // 4096
        at += r["length"]
    none = pages.filter("page_id < 0")
    assert {r["status"] for r in warc.audit(none, pages.limit(3)).collect()} <= {"extra"}
    assert {r["status"] for r in warc.audit(pages, none).collect()} == {"missing"} and warc.audit(none, none).count() == 0


def test_descent_compares_only_differing_branches(spark):
    leaves = spark.createDataFrame([(i, f"d{i}") for i in range(600)], "node long, digest string")
    other = leaves.withColumn("digest", F.when(F.col("node") == 333, "x").otherwise(F.col("digest")))
    a, b = warc.tree(leaves), warc.tree(other)
    assert len(a) == 4 and [r["leaf"] for r in warc.mismatches(a, b).collect()] == [333]
    assert warc.mismatches(a, a).count() == 0


# --- queries, SQL and the pipeline ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_topk_search", "op8_warc_audit"])
def test_query_equals_statement(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*order).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


CLASHES = ["_id", "_text", "_null", "_cut", "_gone", "_copies", "_copy", "key", "code", "least", "copies", "size", "kept", "m", "rep", "family"]


def clashing(spark, docs):
    """documents with columns that operators might use, and an id with two texts, one of them twice."""
    rows = [(100001, None, None, None, None), (100002, "1 2 3", "en", "src1", 5)]
    first, second = " ".join(f"alpha{k}" for k in range(60)), " ".join(f"omega{k}" for k in range(70))
    rows += [(100003, first, "en", "src1", len(first))] * 2 + [(100003, second, "en", "src2", len(second))]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs, first, second


def test_pipeline_stages(spark):
    """Each stage against a plain version of its decision, on its own input."""
    docs, first, second = clashing(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))
    columns = docs.columns

    def step(k, df):
        out = corpus_pipeline.STAGES[k][1](spark, df, FOLDER)
        assert k == 4 or (out.columns == columns and dict(out.dtypes) == dict(df.dtypes))
        return spark.createDataFrame(out.collect(), out.schema)

    def only(df):
        return Counter(t for i, t in rows_of(df) if i == 100003)

    named = step(0, docs)
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in named.collect()} == {
        i for i, t in rows_of(docs) if not t or not any(c.isalpha() for c in t)}
    assert only(named) == {first: 2, second: 1}
    single = step(1, named)
    plain = [r for r in rows_of(named) if r[0] != 100003]
    assert sorted(r["doc_id"] for r in single.filter("doc_id <> 100003").collect()) == [r[0] for r in brute_near(plain, 80) if r[3]]
    assert only(single) == {first: 1, second: 1}
    twice = single.union(single.filter("doc_id = 100003"))
    cut = step(2, twice)
    want = {r[0]: r for r in brute_repeats([r for r in rows_of(single) if r[0] != 100003])}
    gone = {i for i, r in want.items() if r[1] and r[2] == r[1]}
    left = [r for r in rows_of(cut) if r[0] != 100003]
    assert sorted(i for i, _ in left) == sorted(set(want) - gone) and only(cut) == {first: 2, second: 2}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[i][4] for i, t in left if "�" not in t and want[i][1] - want[i][2] == len(t.encode()))
    mixed = step(3, cut)
    taken = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mixing.mix(cut).collect()}
    expected = Counter()
    for r in cut.collect():
        expected[r["doc_id"], r["text"]] += taken[r["doc_id"], r["source"], len(words(r["text"]))]
    assert Counter(rows_of(mixed)) == +expected
    packed = step(4, mixed)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in +expected}
    assert check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in packed.collect()]) <= -(-sum(r["length"] for r in packed.collect()) // 2048) + 1


def test_stages_on_an_empty_table(spark, documents):
    docs, _, _ = clashing(spark, documents)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.filter("doc_id < -1"), FOLDER)
        assert out.collect() == [] and (name == "best-fit packing" or out.columns == docs.columns)


def test_pipeline_runs_as_a_whole(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "language ID"


def test_stages_on_hard_texts(spark, odd):
    """Nulls, blanks, repeated rows, a text of two million characters: every stage runs, and only what it is to drop goes."""
    long = " ".join(f"w{k * 7919 % 1000003}" for k in range(300_000))
    docs = odd.union(spark.createDataFrame([(20, long, "en", "a", len(long), "x", 1), (21, long + " more words", "en", "b", 1, "x", 1)], DOCS))
    lettered = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert sorted(i for i, _ in rows_of(lettered)) == [4, 4, 5, 6, 7, 8, 9, 20, 21]
    single = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert sorted(i for i, _ in rows_of(single)) == [1, 2, 3, 4, 6, 8, 9, 10, 20]
    cut = corpus_pipeline.suffix_dedup(spark, docs, FOLDER)
    assert {i: t for i, t in rows_of(cut)}[21] == " more words"[-len(" more words"):] and {i: t for i, t in rows_of(cut)}[20] == long
    assert [t for i, t in sorted(rows_of(cut), key=str) if i == 1] == [None]
    copies = Counter(i for i, _ in rows_of(corpus_pipeline.mixing(spark, docs, FOLDER)))
    assert set(copies) <= {4, 5, 6, 7, 8, 9, 10, 20, 21}
    packed = corpus_pipeline.packing(spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 21}


def test_pipeline_takes_near_copies_from_80_percent(spark):
    """One changed word of 54: 45 of 55 shingles are shared, 0.818; one of 40: 31 of 41 are, 0.756."""
    rows = []
    for base, n in ((0, 54), (10, 40)):
        text = [f"w{base}x{k}" for k in range(n)]
        rows += [(base + 1, " ".join(text)), (base + 2, " ".join(text[:20] + ["other"] + text[21:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert sorted(r["doc_id"] for r in got.collect()) == [r[0] for r in brute_near(rows, 80) if r[3]] == [1, 11, 12]


def test_language_stage_keeps_lettered_documents_without_labels(spark, odd):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    tables = [odd.withColumn("lang", F.lit(None).cast("string"))]
    tables.append(tables[0].union(spark.createDataFrame([(held, "some words", "en", "a", 10, "x", 1)], DOCS)))
    for df in tables:
        got = corpus_pipeline.language_id(spark, df, FOLDER)
        want = [(i, t) for i, t in rows_of(df) if i is not None and t and any(c.isalpha() for c in t)]
        assert want and sorted(rows_of(got)) == sorted(want) and got.columns == df.columns
    # A label that reads like the sign for an unknown language loses nothing either.
    named = odd.withColumn("lang", F.lit("und"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, named, FOLDER).collect()) == sorted(
        i for i, t in rows_of(odd) if i is not None and t and any(c.isalpha() for c in t))


def test_samples_hold_one_row_of_a_repeated_id(spark, monkeypatch):
    """An id in a third of all rows is one text of a sample, and does not drive the others out of it."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"plain text number {i}", "en") for i in ids] + [(ids[0], f"another text {k}", "en") for k in range(len(ids) // 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted, whole = [], features.fit_in_one_task

    def fit(sample, *rest):
        fitted.append(Counter(r["target"] for r in sample.collect()))
        return whole(sample, *rest)

    monkeypatch.setattr(features, "fit_in_one_task", fit)
    quality.quality(docs, spark.createDataFrame([(i, float(i % 2)) for i in ids], "doc_id long, rating double"))
    toxicity.toxicity(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int"))
    odd_ids = sum(i % 2 for i in ids)
    assert fitted == [Counter(float(i % 2) for i in ids), Counter({1.0: odd_ids, 0.0: len(ids)})]
    model = language.learn(docs)
    assert set(model.row[0]) - {"another"} == {"plain", "text", "number"}
    per_id = language.learn(docs.withColumn("text", F.when(F.col("doc_id") == ids[0], "lone").otherwise(F.col("text"))))
    assert set(per_id.row[0]) == {"plain", "text", "number"}  # "lone" is met in one text of the sample


def test_every_labelled_language_is_learned(spark):
    ids = [i for i in range(1700) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, " ".join(["w" + "".join("abcdefghij"[int(c)] for c in str(i))] * 2), f"l{i:04d}") for i in ids]
    assert len(ids) > 1050
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.languages) == [r[2] for r in rows] and len(model.row[0]) == len(ids)
