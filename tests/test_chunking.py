import random

from pyspark.sql import functions as F

from gapmatch.functions import fixed as K
from gapmatch.operators import chunking as C
from gapmatch.sources import documents as D


def plain_windows(text):
    """The window walk written as a loop."""
    if len(text) <= K.CHILD_CHARS:
        return [(0, text)]
    out, at = [], 0
    while at < len(text):
        stop = min(at + K.CHILD_CHARS, len(text))
        if stop < len(text):
            blank = text.rfind(" ", at + K.CHILD_CHARS // 2, stop)
            stop = blank if blank >= 0 else stop
        if text[at:stop].strip():
            out.append((at, text[at:stop].strip()))
        if stop == len(text):
            break
        at = max(at + 1, stop - K.CHILD_OVERLAP)
    return out


def test_windows_match_the_loop_on_random_texts(spark):
    rng = random.Random(5)
    texts = ["", "x" * 5000, "word " * 3000, " " * 900 + "tail"]
    texts += ["".join(rng.choice("abcdeéλ  \n") for _ in range(rng.randint(1, 9500))) for _ in range(40)]
    texts += [("y" * rng.randint(100, 600) + " ") * rng.randint(1, 30) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", C.windows(F.col("text")).alias("w")).collect():
        assert [(w.start, w.text) for w in r.w] == plain_windows(texts[r.i]), r.i


def pages(spark, *texts):
    rows = [("d1", [(i + 1, t) for i, t in enumerate(texts)])]
    return spark.createDataFrame(rows, "doc_key string, pages array<struct<number:int,text:string>>")


def test_sections_cross_pages_and_keep_the_heading_page(spark):
    df = pages(spark, "Jo Doe\nEXPERIENCE\nBuilt a parser", "and a printer\nSkills:\nKafka, Redis")
    got = [tuple(s) for s in df.select(C.sections(F.col("pages"))).first()[0]]
    assert got == [("Header", 1, "Jo Doe"), ("EXPERIENCE", 1, "Built a parser\nand a printer"), ("Skills", 2, "Kafka, Redis")]


def test_one_section_per_page_without_headings(spark):
    df = pages(spark, "just prose here", "  ", "more prose")
    got = [tuple(s) for s in df.select(C.sections(F.col("pages"))).first()[0]]
    assert got == [("Page 1", 1, "just prose here"), ("Page 3", 3, "more prose")]


def test_parents_pack_paragraphs(spark):
    body = "\n\n".join([c * 900 for c in "abcd"])
    df = spark.createDataFrame([(body,)], "b string")
    got = df.select(C.parents(F.col("b"))).first()[0]
    assert [p.replace("\n", "")[::900] for p in got] == ["ab", "cd"]


def test_ids_link_children_to_parents(spark):
    df = pages(spark, "EXPERIENCE\n" + "Built things with Kafka. " * 40 + "\nSKILLS\nRedis")
    parents = C.parent_chunks(df)
    children = C.child_chunks(parents, "CV").collect()
    assert {c.parent_id for c in children} == {p.parent_id for p in parents.collect()} == {"d1-s0-p0", "d1-s1-p0"}
    assert children[0].chunk_id == "d1-s0-p0-c0" and children[0].embed_text.startswith("[CV › EXPERIENCE]\n")
    counted = df.select(C.child_count(F.col("pages"))).first()[0]
    assert counted == len(children)


def test_fixed_chunks_find_their_page(spark):
    df = pages(spark, "a " * 200, "b " * 200, "c")
    got = C.fixed_chunks(df).orderBy("chunk_id").collect()
    assert [r.page for r in got] == sorted(r.page for r in got)
    assert got[0].page == 1 and got[-1].page >= 2 and got[0].parent_id == "d1-f0"


def test_guards(spark):
    rows = [("short", "tiny"), ("fine", "word " * 100), ("huge", "x" * (K.MAX_BYTES + 1))]
    loaded = D.load_texts(spark.createDataFrame(rows, "doc_key string, text string"))
    got = {r.doc_key: (r.ingest_status, r.ingest_error, r.chunk_count > 0) for r in D.ingest_status(loaded).collect()}
    assert got == {"short": ("failed", "too_short", False), "fine": ("ready", "", True), "huge": ("failed", "too_large", False)}
    turns = [("ok", 1, "w" * 400), ("ok", 2, "w" * 20), ("scan", 1, "w"), ("long", 1, "w" * 200)] + [("long", n, "w" * 200) for n in range(2, 22)]
    got = {r.d: r.ingest_error for r in D.page_guard(spark.createDataFrame(turns, "d string, number int, text string"), "d").collect()}
    assert got == {"ok": None, "scan": "looks_scanned", "long": "too_many_pages"}


def test_readiness_needs_both_kinds(spark):
    rows = [("a", "cv", "ready"), ("a", "jd", "ready"), ("b", "cv", "ready"), ("b", "jd", "failed"), ("c", "cv", "processing")]
    got = {r.session_id: r.status for r in D.session_readiness(spark.createDataFrame(rows, "session_id string, kind string, ingest_status string")).collect()}
    assert got == {"a": "ready", "b": "created", "c": "ingesting"}


def test_a_window_is_cut_without_evaluating_its_steps_again(spark):
    """The plan of the windows names each step once: it does not grow with how often a step is read."""
    plan = spark.range(1).select(C.windows(F.lit("a ").cast("string")).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("substring_index(") == 1
