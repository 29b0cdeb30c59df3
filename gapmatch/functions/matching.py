"""Keyword matching as set overlap of typed match keys.

A keyword meets a text by any of five rules (same word, synonym, part of a slash compound, shared
five-letter start, same Greek stem). Each rule becomes a key with a type prefix, emitted by both
sides; a keyword matches when the two key sets overlap. That turns the rule list into
``arrays_overlap`` on one row - after retrieval a requirement and its passage already share a row,
so no join or shuffle is needed - and into a plain equi-join where they do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from . import text as T


def _synonyms(keyword: Column) -> Column:
    pairs = []
    for word, others in K.SYNONYMS.items():
        pairs += [F.lit(word), F.array(*[F.lit("x:" + o) for o in others])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), keyword), T.no_strings())


def keyword_keys(keyword: Column) -> Column:
    stem = T.greek_stem(keyword)
    return F.concat(
        F.array(F.concat(F.lit("x:"), keyword), F.concat(F.lit("s:"), keyword)),
        _synonyms(keyword),
        F.when(
            F.length(keyword) >= 5, F.array(F.concat(F.lit("p:"), F.left(keyword, F.lit(5))))
        ).otherwise(T.no_strings()),
        F.when(stem != keyword, F.array(F.concat(F.lit("g:"), stem))).otherwise(T.no_strings()),
    )


def text_keys(toks: Column) -> Column:
    """Every key a text can be met by. Stem keys only for Greek tokens: others cannot be asked for."""
    def keys(t):
        return F.concat(
            F.array(F.concat(F.lit("x:"), t)),
            F.when(
                F.contains(t, F.lit("/")),
                F.transform(F.split(t, "/"), lambda part: F.concat(F.lit("s:"), part)),
            ).otherwise(T.no_strings()),
            F.when(
                F.length(t) >= 5, F.array(F.concat(F.lit("p:"), F.left(t, F.lit(5))))
            ).otherwise(T.no_strings()),
            F.when(
                t.rlike(f"[{K.GREEK}]"), F.array(F.concat(F.lit("g:"), T.greek_stem(t)))
            ).otherwise(T.no_strings()),
        )

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(toks), keys)))


def needles(terms: Column) -> Column:
    """array<struct<term, keys>> for a list of keywords; computed once per requirement."""
    return F.transform(
        terms, lambda t: F.struct(t.alias("term"), keyword_keys(t).alias("keys"))
    )


def _met(needle_structs: Column, keys: Column) -> Column:
    return F.filter(needle_structs, lambda n: F.arrays_overlap(n["keys"], keys))


def coverage(needle_structs: Column, keys: Column) -> Column:
    """Share of the needles met by the text keys; 0 when there is nothing to meet."""
    share = T.let(keys, lambda k: F.size(_met(needle_structs, k)))
    return F.when(F.size(needle_structs) > 0, share / F.size(needle_structs)).otherwise(F.lit(0.0))


def _weight(needle_structs: Column) -> Column:
    return F.aggregate(needle_structs, F.lit(0.0), lambda acc, n: acc + n["weight"])


def weighted_coverage(needle_structs: Column, keys: Column) -> Column:
    """As ``coverage`` with ``weight`` on every needle."""
    met = T.let(keys, lambda k: _weight(_met(needle_structs, k)))
    return T.let(
        _weight(needle_structs), lambda whole: F.when(whole > 0, met / whole).otherwise(F.lit(0.0))
    )


def any_met(needle_structs: Column, keys: Column) -> Column:
    return T.let(keys, lambda k: F.exists(needle_structs, lambda n: F.arrays_overlap(n["keys"], k)))
