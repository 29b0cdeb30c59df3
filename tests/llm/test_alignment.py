"""Alignment of tokenizers against encodings of whole texts, pair by pair."""

import hashlib
from collections import Counter, defaultdict

import pytest

from gapmatch.llm import alignment as A
from gapmatch.llm import queries

FOLDER = "/root/testdata/sf0.001"
HARD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b c", "tab\tand space \n next", "x \n y", "one two three", "▁ mark", "a▁b",
    "<|endoftext|> <s> </s> <unk> <0x41>", "żółw ünï 漢字 かな 🙂👍🏽 ​ z", "don't we'll I'm", "\x1c \x1d a \x85 b", "　 wide   em", "1 22 333 4444 5,6.7",
    "ab" * 3000, "word " * 500, "\u0000 nul", "é combining", "\r\n\r\n  x", "…" * 50, "a" + " " * 40 + "b", "ﬁ ligature Å", "same text here", "same text here",
]


@pytest.fixture(scope="module")
def tokenizers():
    return A.Tokenizers(A.FIRST, A.SECOND)


def whole(tokenizers, text):
    """Groups of one text, encoded whole, by walking over its bytes."""
    if not text:
        return []
    a = tokenizers.first.encode(" " + text, add_special_tokens=False).ids
    b = tokenizers.second.encode(text)
    bytes_a, bytes_b = [tokenizers.bytes_a[x] for x in a], [tokenizers.bytes_b[x] for x in b]
    target = (" " + text).encode()
    if b"".join(bytes_a) != target or b"".join(bytes_b) != target:
        return []
    found, i, j, at_a, at_b, own = [], 0, 0, 0, 0, ([], [])
    for end in range(1, len(target) + 1):
        if i < len(a) and at_a + len(bytes_a[i]) == end:
            at_a, i = end, i + 1
            own[0].append(a[i - 1])
        if j < len(b) and at_b + len(bytes_b[j]) == end:
            at_b, j = end, j + 1
            own[1].append(b[j - 1])
        if at_a == at_b == end:
            found.append(own)
            own = ([], [])
    return found


def brute(tokenizers, rows):
    groups = [(i, whole(tokenizers, t)) for i, t in rows]
    docs = Counter(p for _, g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    out = []
    for i, g in groups:
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(docs[p] == top[p[0]] for p in links),
                    sum(docs[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def test_alignment_equals_brute_force(spark, tokenizers):
    rows = list(enumerate(HARD)) + [(5, "a second text of one id"), (5, "a second text of one id")]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(None, "no id", 1)], "doc_id int, text string, block int").repartition(3)
    want = sorted(brute(tokenizers, rows))
    assert sorted(map(tuple, A.align(df).collect())) == want
    assert sum(w[3] > 0 for w in want) > 15 and sum(w[3] == 0 for w in want) >= 4
    # Small blocks and a small memory give the same rows.
    assert sorted(map(tuple, A.align(df, block_bytes=200, remembered=2000).collect())) == want


def test_both_encoders_of_the_first_file_agree(tokenizers, spark):
    texts = [t for t in HARD if t] + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect() if r["text"]]
    assert A.byte_pairs(A._place(A.FIRST), A.byte_alphabet()) is not None
    assert all(tokenizers.first_ids(" " + t) == tokenizers.first.encode(" " + t, add_special_tokens=False).ids for t in texts)


def test_trimmed_memory_keeps_what_is_used(tokenizers):
    known = A._Units(A.FIRST, A.SECOND)
    units = [f"word{k % 70}" for k in range(100)] + ["word1,", "word2."]
    before = known.numbers(units)
    want = {u: (known.texts[n], known.tables()[0][n].tolist()) for u, n in zip(units, before.tolist())}
    known.trim(1 << 20)
    assert 0 < len(known.number) < len(set(units))
    again = known.numbers(units)
    sizes, first, links = known.tables()
    assert {u: (known.texts[n], sizes[n].tolist()) for u, n in zip(units, again.tolist())} == want
    assert all(len(links[first[n] : first[n] + sizes[n, 4]]) == sizes[n, 4] for n in again.tolist()) and first[-1] + sizes[-1, 4] == len(links)


def test_query_equals_brute_force(spark, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_alignment(spark, FOLDER).collect())) == sorted(brute(tokenizers, rows))


def test_empty_and_tokenless_tables(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = A.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_vocabulary_links(spark, tokenizers):
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the")], "doc_id long, text string")
    links = A.vocabulary_links(A.encoded(df)).collect()
    the = [r for r in links if tokenizers.bytes_a[r["a"]] == b" the"]
    assert [(tokenizers.bytes_b[r["b"]], r["n"], r["best"]) for r in the] == [(b" the", 3, True)]
