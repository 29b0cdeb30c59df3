"""Sections, parents and child windows of documents.

A document is one row with ``pages array<struct<number:int,text:string>>``. Everything up to the
chunk rows is array work inside that row, so chunking is a single narrow stage: scan, project,
explode - no shuffle, whatever the size or skew of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T

_BLOCK = 512  # above a window's size


def single_page(text: Column) -> Column:
    return F.array(F.struct(F.lit(1).alias("number"), text.alias("text")))


def is_section_heading(line: Column) -> Column:
    def judge(bare: Column) -> Column:
        size = F.length(bare)
        shouted = (
            T.has_only_capitals(bare) & ~bare.endswith(".") & ~bare.endswith(",")
            & (F.size(T.words(bare)) <= 5)
        )
        return (size > 2) & (size < 60) & (bare.rlike(K.SECTION_HEADING) | shouted)

    return T.let(T.strip(line), judge)


def _page_lines(pages: Column) -> Column:
    return F.flatten(
        F.transform(
            pages,
            lambda p: F.transform(
                T.lines(p["text"]),
                lambda l: F.struct(
                    p["number"].alias("page"), l.alias("line"),
                    is_section_heading(l).alias("heading"),
                ),
            ),
        )
    )


def sections(pages: Column) -> Column:
    """array<struct<section,page,body>>: heading to heading, or page by page without headings."""

    def cut(rows: Column) -> Column:
        # 1-based positions of the headings, with position 0 standing for the text before the first.
        starts = F.concat(
            F.array(F.lit(0)),
            F.filter(
                F.sequence(F.lit(1), F.size(rows)), lambda i: F.element_at(rows, i)["heading"]
            ),
        )

        def section(starts, start, j):
            stop = F.coalesce(F.get(starts, j + 1), F.size(rows) + 1)
            head = F.get(rows, start - 1)
            body = F.transform(
                F.slice(rows, start + 1, stop - start - 1), lambda r: r["line"]
            )
            return F.struct(
                F.coalesce(F.regexp_replace(T.strip(head["line"]), ":+$", ""), F.lit("Header")).alias(
                    "section"
                ),
                F.coalesce(head["page"], F.lit(1)).alias("page"),
                T.strip(F.array_join(body, "\n")).alias("body"),
            )

        return T.let(
            starts,
            lambda bound: F.filter(F.transform(bound, lambda start, j: section(bound, start, j)), lambda s: s["body"] != ""),
        )

    found = T.let(_page_lines(pages), cut)
    whole_pages = F.transform(
        F.filter(pages, lambda p: T.strip(p["text"]) != ""),
        lambda p: F.struct(
            F.concat(F.lit("Page "), p["number"].cast("string")).alias("section"),
            p["number"].alias("page"),
            p["text"].alias("body"),
        ),
    )
    return T.let(found, lambda f: F.when(F.size(f) < 2, whole_pages).otherwise(f))


def _span(start: Column, stop: Column) -> Column:
    """Two positions as one number: a fold copies its state at every step, so it collects numbers, not texts."""
    return F.shiftleft(start.cast("long"), 32) + stop


def _start(span: Column) -> Column:
    return F.shiftright(span, 32).cast("int")


def _stop(span: Column) -> Column:
    return (span % (1 << 32)).cast("int")


_NO_SPANS = "cast(array() as array<bigint>)"


def parents(body: Column) -> Column:
    """Greedy packing of blank-line paragraphs up to the parent size."""
    def pack(paragraphs: Column) -> Column:
        # The open parent holds the paragraphs from ``first`` on, ``n`` characters; empty paragraphs do not open one.
        start = F.struct(F.expr(_NO_SPANS).alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n"))

        def add(acc, i):
            size = F.length(F.get(paragraphs, i))
            full = (acc["n"] + size > K.PARENT_MAX_CHARS) & (acc["n"] > 0)
            fresh = full | (acc["n"] == 0)
            return F.struct(
                F.when(full, F.array_append(acc["done"], _span(acc["first"], i))).otherwise(acc["done"]).alias("done"),
                F.when(fresh, i).otherwise(acc["first"]).alias("first"),
                F.when(fresh, size).otherwise(acc["n"] + 2 + size).alias("n"),
            )

        def text(first, stop):
            return T.strip(F.array_join(F.slice(paragraphs, first + 1, stop - first), "\n\n"))

        def close(acc):
            done = F.transform(acc["done"], lambda span: text(_start(span), _stop(span)))
            last = F.array(text(acc["first"], F.size(paragraphs)))
            return F.concat(done, F.filter(last, lambda t: t != ""))

        return F.aggregate(F.sequence(F.lit(0), F.size(paragraphs) - 1), start, add, close)

    packed = T.let(F.split(body, "\n\n"), pack)
    return F.when(F.length(body) <= K.PARENT_MAX_CHARS, F.array(body)).otherwise(packed)


def windows(text: Column) -> Column:
    """array<struct<start:int,first:int,text:string>>: overlapping child windows cut at blanks, with the
    positions of their first character and of the first that is not blank.

    Each window starts where the one before ended, so this is a fold. The text is first cut into
    fixed blocks; a window reads from two neighbouring blocks only, which keeps the fold linear in
    the length of the document.
    """
    size, overlap = K.CHILD_CHARS, K.CHILD_OVERLAP

    def blanks(piece: Column) -> Column:
        return F.length(piece) - F.length(F.ltrim(piece, F.lit(K.BLANKS)))

    def fold(row: Column) -> Column:
        blocks, n = row["blocks"], row["n"]
        step = size // 2 - overlap  # least advance of a window
        rounds = F.sequence(F.lit(1), (n / step).cast("int") + 2)

        def look(start, length):
            at = (start / _BLOCK).cast("int")
            pair = F.concat(F.get(blocks, at), F.coalesce(F.get(blocks, at + 1), F.lit("")))
            return F.substring(pair, start - at * _BLOCK + 1, length)

        def advance(acc, _):
            # Each step is bound to a name: a lambda evaluates what it reads twice twice.
            start = acc["next"]

            def from_window(window):
                tail = F.substring(window, size // 2 + 1, size - size // 2)
                # length of the tail up to its last blank; -1 when it has none
                cut = T.let(tail, lambda t: F.length(t) - F.length(F.substring_index(t, " ", -1)) - 1)
                more = start + size < n
                stop = T.let(cut, lambda c: F.when(more & (c >= 0), start + size // 2 + c).otherwise(F.least(start + size, n)))
                return T.let(stop, until)

            def until(stop):
                return F.struct(
                    F.when(stop >= n, F.lit(-1))
                    .otherwise(F.greatest(start + 1, stop - overlap))
                    .alias("next"),
                    F.array_append(acc["out"], _span(start, stop)).alias("out"),
                )

            return F.when(acc["next"] < 0, acc).otherwise(T.let(look(start, F.lit(size)), from_window))

        def piece(span):
            start = _start(span)
            return T.let(look(start, F.lit(size)), lambda window: F.struct(
                start.alias("start"), (start + blanks(window)).alias("first"), T.strip(F.left(window, _stop(span) - start)).alias("text")
            ))

        zero = F.struct(F.lit(0).alias("next"), F.expr(_NO_SPANS).alias("out"))
        return F.transform(F.aggregate(rounds, zero, advance, lambda acc: acc["out"]), piece)

    row = F.struct(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0)).alias("blocks"),
        F.length(text).alias("n"),
    )
    cut = F.filter(T.let(row, fold), lambda w: w["text"] != "")
    whole = F.array(F.struct(F.lit(0).alias("start"), blanks(text).alias("first"), text.alias("text")))
    return F.when(F.length(text) <= size, whole).otherwise(cut)


def child_count(pages: Column) -> Column:
    """How many child windows a document yields, without producing rows."""
    def total(counts):
        return F.aggregate(counts, F.lit(0), lambda acc, n: acc + n)

    return total(
        F.transform(
            sections(pages), lambda s: total(F.transform(parents(s["body"]), lambda p: F.size(windows(p))))
        )
    )


def parent_chunks(docs: DataFrame, key: str = "doc_key", keep: tuple = ()) -> DataFrame:
    """(keep..., doc_key, parent_id, section, page, text) for documents with ``pages``."""
    cut = docs.select(*keep, key, F.posexplode(sections(F.col("pages"))).alias("s_idx", "s"))
    packed = cut.select(
        *keep, key, "s_idx", "s", F.posexplode(parents(F.col("s.body"))).alias("p_idx", "text")
    )
    return packed.select(
        *keep, key,
        F.format_string("%s-s%d-p%d", F.col(key), "s_idx", "p_idx").alias("parent_id"),
        F.col("s.section").alias("section"), F.col("s.page").alias("page"), "text",
    )


def child_chunks(parent_rows: DataFrame, label: str, key: str = "doc_key", keep: tuple = ()) -> DataFrame:
    """(keep..., doc_key, parent_id, chunk_id, section, page, text, embed_text)."""
    return parent_rows.select(
        *keep, key, "parent_id", "section", "page",
        F.posexplode(windows(F.col("text"))).alias("c_idx", "w"),
    ).select(
        *keep, key, "parent_id",
        F.format_string("%s-c%d", "parent_id", "c_idx").alias("chunk_id"),
        "section", "page", F.col("w.text").alias("text"),
        F.concat(F.lit(f"[{label} › "), "section", F.lit("]\n"), F.col("w.text")).alias("embed_text"),
    )


def document_of(chunk_id: Column) -> Column:
    """The document key inside a chunk id of either strategy."""
    return F.regexp_replace(chunk_id, r"-(s\d+-p|f)\d+-c\d+$", "")


def fixed_chunks(docs: DataFrame, key: str = "doc_key", keep: tuple = ()) -> DataFrame:
    """Structure-blind baseline: every window of the joined pages is its own parent."""
    joined = docs.select(
        *keep, key,
        F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("full"),
        # (offset, number) of every page in the joined text
        F.aggregate(
            "pages",
            F.struct(
                F.lit(0).alias("at"),
                F.expr("cast(array() as array<struct<at:int,number:int>>)").alias("out"),
            ),
            lambda acc, p: F.struct(
                (acc["at"] + F.length(p["text"]) + 1).alias("at"),
                F.array_append(
                    acc["out"], F.struct(acc["at"].alias("at"), p["number"].alias("number"))
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        ).alias("offsets"),
    )
    # The page of a piece is the last one starting at or before the piece's first visible character. It is
    # found before the pieces become rows, which then carry neither the whole text nor the page offsets.
    def placed(offsets: Column) -> Column:
        def page(first: Column) -> Column:
            before = F.filter(offsets, lambda o: o["at"] <= first)
            return F.coalesce(F.try_element_at(before, F.lit(-1))["number"], F.lit(1))

        return F.transform(windows(F.col("full")), lambda w: F.struct(page(w["first"]).alias("page"), w["text"].alias("text")))

    cut = joined.select(*keep, key, F.posexplode(T.let(F.col("offsets"), placed)).alias("i", "w"))
    return cut.select(
        *keep, key,
        F.format_string("%s-f%d", F.col(key), "i").alias("parent_id"),
        F.format_string("%s-f%d-c0", F.col(key), "i").alias("chunk_id"),
        F.lit("").alias("section"), F.col("w.page").alias("page"),
        F.col("w.text").alias("text"), F.col("w.text").alias("embed_text"),
    )


def heading_lines(docs: DataFrame, key: str = "doc_key") -> DataFrame:
    """Every line taken for a section heading, with its page and position."""
    rows = docs.select(key, F.posexplode(_page_lines(F.col("pages"))).alias("line_no", "l"))
    return rows.filter("l.heading").select(
        key, "line_no", F.col("l.page").alias("page"), T.strip(F.col("l.line")).alias("heading")
    )
