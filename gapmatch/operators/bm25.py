"""BM25 (Okapi) over scopes.

Statistics (document count, mean length, document frequency) are three map-side-combined
aggregations, so a word that occurs in every chunk costs one partial row per task. Scoring reads
the chunks where they lie and never joins postings, which is what makes the unfiltered common words
of this ranking affordable.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T
from .topk import top_k


class Lexicon(NamedTuple):
    """Statistics of the scopes: (scope, n, avg_len) and (scope, term, df, idf)."""

    stats: DataFrame
    terms: DataFrame


def or_blank(toks):
    """A text without tokens holds the placeholder ``_``."""
    return F.when(F.size(toks) > 0, toks).otherwise(F.array(F.lit("_")))


def tokenised(chunks: DataFrame) -> DataFrame:
    """(scope, item_id, toks) of indexed chunks."""
    return chunks.select(
        "scope", F.col("chunk_id").alias("item_id"), or_blank(F.col("toks")).alias("toks")
    )


def scope_stats(items: DataFrame) -> DataFrame:
    return items.groupBy("scope").agg(
        F.count("*").alias("n"), (F.sum(F.size("toks")) / F.count("*")).alias("avg_len")
    )


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def term_stats(items: DataFrame, stats: DataFrame) -> DataFrame:
    """(scope, term, df, idf) counted from the chunks."""
    df = (
        items.select("scope", F.explode(F.array_distinct("toks")).alias("term"))
        .groupBy("scope", "term")
        .agg(F.count("*").alias("df"))
    )
    return weighed(df, stats)


def weighed(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(scope, term, df, idf) of counted terms (scope, term, df); a term in more than half of the chunks gets the floor
    weight."""
    raw = df.join(stats, "scope").withColumn("raw", raw_idf(F.col("n"), F.col("df")))
    floor = raw.groupBy("scope").agg((F.avg("raw") * K.BM25_EPSILON).alias("floor"))
    return raw.join(floor, "scope").select(
        "scope", "term", "df",
        F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"),
    )


def query_terms(queries: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(scope, query_id, terms, weights, avg_len): repeated query words count repeatedly."""
    asked = queries.select("scope", "query_id", T.tokens(F.col("text")).alias("toks"))
    exploded = asked.select("scope", "query_id", F.explode(or_blank(F.col("toks"))).alias("term"))
    counted = exploded.groupBy("scope", "query_id", "term").agg(F.count("*").alias("times"))
    with_weights = counted.join(terms, ["scope", "term"]).select(
        "scope", "query_id", F.struct("term", (F.col("times") * F.col("idf")).alias("w")).alias("t")
    )
    # A query is a short text: its term list is bounded by its own length.
    return (
        with_weights.groupBy("scope", "query_id")
        .agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .join(stats, "scope")
        .select(
            "scope", "query_id", F.col("ts.term").alias("terms"), F.col("ts.w").alias("weights"),
            "avg_len",
        )
    )


def token_lists(toks: pd.Series) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(how many of each row, all of them) of tokens given as lists or joined by blanks, which no token holds."""
    if isinstance(toks.iloc[0], str):
        lists = pc.split_pattern(pa.array(toks, pa.string()), " ")
        return np.diff(lists.offsets.to_numpy()), lists.flatten().dictionary_encode()
    return toks.map(len).to_numpy(), pa.array(np.concatenate(toks.tolist()), pa.string()).dictionary_encode()


def score_block(items: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    """BM25 of every query against every item of the block: what each asked word adds, item by item that holds it."""
    vocabulary = pd.Index(np.unique(np.concatenate([np.asarray(t, dtype=object) for t in queries["terms"]])))
    lengths, coded = token_lists(items["toks"])
    mean = float(queries["avg_len"].iloc[0])
    damp = K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * lengths / mean)
    cols = vocabulary.get_indexer(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    seen = cols >= 0
    # Postings of the asked words: (word, item) once, with how often.
    key, times = np.unique(cols[seen] * len(items) + np.repeat(np.arange(len(items)), lengths)[seen], return_counts=True)
    word, at = np.divmod(key, max(1, len(items)))
    gain = times * (K.BM25_K1 + 1) / (times + damp[at])
    cuts = np.searchsorted(word, np.arange(len(vocabulary) + 1))
    out = np.zeros((len(queries), len(items)))
    for row, (terms, weights) in enumerate(zip(queries["terms"], queries["weights"])):
        for term, weight in zip(vocabulary.get_indexer(terms), weights):
            held = slice(cuts[term], cuts[term + 1])
            out[row, at[held]] += weight * gain[held]
    return out


def lexicon(chunks: DataFrame) -> Lexicon:
    items = tokenised(chunks)
    stats = scope_stats(items)
    return Lexicon(stats, term_stats(items, stats))


def bm25_top_k(
    chunks: DataFrame, queries: DataFrame, k: int = K.CANDIDATE_K, lexicon_: Lexicon | None = None, **kw
) -> DataFrame:
    """Ranks from 1 for indexed chunks and queries (scope, query_id, text)."""
    lex = lexicon_ or lexicon(chunks)
    # One text a row is cheaper to hand to Python than a list.
    items = tokenised(chunks).withColumn("toks", F.array_join("toks", " "))
    return top_k(items, query_terms(queries, lex.terms, lex.stats), score_block, k, floor=0.0, **kw)
