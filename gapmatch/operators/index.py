"""The chunk index: parents and children of every document, written once, read many times.

Children are stored with their tokens and vectors, so a ranking reads only the column it scores
(Parquet prunes the rest; vectors are packed, ``vectors.unpack`` gives their numbers) and no query ever chunks or tokenises the corpus again. Writing a table
also cuts the lineage: a lost executor re-reads files instead of re-running the chunker.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import work_dir, written  # noqa: F401
from . import bm25
from . import chunking as C
from .vectors import Embedder, hashed_embedder, pack

LABELS = {"cv": "CV", "jd": "Job description"}


@dataclass(frozen=True)
class Index:
    parents: DataFrame
    children: DataFrame
    lexicon: bm25.Lexicon | None = None

    def under(self, scope) -> Index:
        """The same chunks with another scope column (for example one scope for everything)."""
        return Index(self.parents.withColumn("scope", scope), self.children.withColumn("scope", scope))

    def with_lexicon(self) -> Index:
        """The term statistics of the scopes, stored: a ranking then reads only its own query's terms."""
        lex = bm25.lexicon(self.children)
        return Index(self.parents, self.children, stored_lexicon(lex))


def stored_lexicon(lex: bm25.Lexicon) -> bm25.Lexicon:
    return bm25.Lexicon(written(lex.stats, "scope_stats"), written(lex.terms, "term_stats"))


def chunked(docs: DataFrame, strategy: str = "parent_child", label: str = "CV") -> tuple[DataFrame, DataFrame]:
    """(parents, children) of documents (scope, doc_key, pages), not yet stored.

    Documents are dealt out evenly before they are cut. How many splits a table has does not tell how many tasks read it:
    a row group goes to one of them, and a file can be a single one."""
    docs = docs.select("scope", "doc_key", "pages").hint("rebalance")
    if strategy == "fixed":
        children = C.fixed_chunks(docs, keep=("scope",))
        return children.select("scope", "doc_key", "parent_id", "section", "page", "text"), children
    parents = C.parent_chunks(docs, keep=("scope",))
    return parents, C.child_chunks(parents, label, keep=("scope",))


def enrich(children: DataFrame, embed: Embedder, keep: tuple = ("scope",), packed: bool = False) -> DataFrame:
    """Adds tokens and vectors. ``embed_text`` is the text, alone or behind a line of its own, which no token leaves: an
    embedder of tokens takes those of that line and of the text, which is cut once. ``packed`` gives vectors as an index
    stores them, one value of bytes instead of hundreds of numbers to write and read one by one."""
    children = children.withColumn("toks", T.tokens(F.col("text")))
    if hasattr(embed, "of_tokens"):
        line = F.left("embed_text", F.length("embed_text") - F.length("text"))
        toks = F.concat(T.tokens(line), "toks")
        vec = embed.packed_of_tokens(toks) if packed else embed.of_tokens(toks).cast("array<float>")
    else:
        vec = embed(F.col("embed_text")).cast("array<float>")
        vec = pack(vec) if packed else vec
    return children.select(
        *keep, "doc_key", "parent_id", "chunk_id", "section", "page", "text", "toks", vec.alias("vec")
    )


def build_index(
    docs: DataFrame, strategy: str = "parent_child", label: str = "CV", embed: Embedder | None = None
) -> Index:
    parents, children = chunked(docs, strategy, label)
    if strategy != "fixed":
        # Sections are found once: children are cut from the stored parents.
        parents = written(parents, "parents")
        children = C.child_chunks(parents, label, keep=("scope",))
    stored = written(enrich(children, embed or hashed_embedder(), packed=True), "children")
    if strategy == "fixed":
        parents = stored.select("scope", "doc_key", "parent_id", "section", "page", "text")
    return Index(parents, stored).with_lexicon()
