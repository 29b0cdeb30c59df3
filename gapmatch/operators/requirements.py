"""Requirements out of postings: array work inside each document row, no shuffle.

Lines are flagged once; a fold walks them with the current region and bucket and keeps only lines
inside a requirements region, so what it carries stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T

_KEPT = "array<struct<line_no:int,text:string,bucket:string>>"


def _flags(lines: Column) -> Column:
    def flag(line, i):
        return F.struct(
            i.alias("line_no"), line.alias("line"),
            line.rlike(T.uni(K.INCLUDE_HEADING)).alias("opens"),
            line.rlike(T.uni(K.EXCLUDE_HEADING)).alias("closes"),
            line.rlike(T.uni(K.SOFT_BUCKET)).alias("soft"),
            line.endswith(":").alias("lead"),
        )

    return F.transform(lines, flag)


def _walk(flags: Column, inside_at_start: bool, buckets: bool) -> Column:
    """Lines inside an open region. Opening headings are tested before closing ones."""
    start = F.struct(
        F.lit(inside_at_start).alias("inside"), F.lit("must_have").alias("bucket"),
        F.expr(f"cast(array() as {_KEPT})").alias("kept"),
    )

    def step(acc, f):
        heading = f["opens"] | f["closes"]
        soft_here = f["soft"] & (f["opens"] | (acc["inside"] & f["lead"] & ~heading))
        keep = acc["inside"] & ~heading & (F.lit(not buckets) | ~f["lead"])
        text = T.strip_chars(F.regexp_replace(f["line"], T.uni(K.BULLET), ""), " .;")
        return F.struct(
            F.when(f["opens"], True).when(f["closes"], False).otherwise(acc["inside"]).alias("inside"),
            F.when(soft_here, "nice_to_have")
            .when(f["opens"], "must_have")
            .otherwise(acc["bucket"])
            .alias("bucket"),
            F.when(
                keep,
                F.array_append(
                    acc["kept"],
                    F.struct(f["line_no"].alias("line_no"), text.alias("text"), acc["bucket"].alias("bucket")),
                ),
            ).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(flags, start, step, lambda acc: acc["kept"])


def _listed(kept: Column) -> Column:
    """First pass: lines under a requirements heading."""
    def wanted(r):
        t = r["text"]
        size = F.length(t)
        return (
            ~t.rlike(T.uni(K.BENEFIT)) & (size >= 3) & (size <= 260) & ~T.has_only_capitals(t)
            & ((size >= 12) | (F.size(T.salient_terms(t)) > 0)) & (F.size(T.keywords(t)) >= 1)
        )

    def bucketed(r):
        low = F.lower(r["text"])
        hard = F.lit(False)
        for word in K.HARD_WORDS:
            hard = hard | F.contains(low, F.lit(word))
        return F.struct(
            r["line_no"].alias("line_no"), r["text"].alias("text"),
            F.when(low.rlike(T.uni(K.SOFT_BUCKET)), "nice_to_have")
            .when(hard, "must_have")
            .otherwise(r["bucket"])
            .alias("bucket"),
        )

    return F.transform(F.filter(kept, wanted), bucketed)


def _unlisted(kept: Column) -> Column:
    """Second pass, for postings without headings: substantive lines that ask for something."""
    def wanted(r):
        t = r["text"]
        size = F.length(t)
        return (
            (size >= 20) & (size <= 260) & t.rlike(r"\p{L}") & ~T.has_only_capitals(t)
            & (t.rlike(T.uni(K.ASKING)) | (F.size(T.salient_terms(t)) > 0))
            & (F.size(T.keywords(t)) >= 3)
        )

    return F.transform(
        F.filter(kept, wanted),
        lambda r: F.struct(r["line_no"].alias("line_no"), r["text"].alias("text"), F.lit("must_have").alias("bucket")),
    )


def _deduped(found: Column) -> Column:
    """First of every group with equal leading keywords, capped at the posting limit."""
    keyed = F.transform(
        found,
        lambda r: F.struct(
            r["line_no"].alias("line_no"), r["text"].alias("text"), r["bucket"].alias("bucket"),
            F.array_join(F.slice(F.array_sort(T.keywords(r["text"])), 1, 6), " ").alias("key"),
        ),
    )

    def first_only(rows):
        def picked(names):
            kept = F.slice(F.filter(F.array_distinct(names), lambda k: k != ""), 1, K.REQUIREMENT_CAP)
            return F.transform(kept, lambda k: F.get(rows, F.array_position(names, k).cast("int") - 1))

        return T.let(F.transform(rows, lambda r: r["key"]), picked)

    return T.let(keyed, first_only)


def requirements(text: Column) -> Column:
    """array<struct<line_no,text,bucket,key>> of a posting; empty when it asks for nothing."""
    def both(flags):
        return T.let(
            _listed(_walk(flags, False, True)),
            lambda first: F.when(F.size(first) > 0, first).otherwise(_unlisted(_walk(flags, True, False))),
        )

    return _deduped(T.let(_flags(T.reflowed(text)), both))


def extract(postings: DataFrame, key: str) -> DataFrame:
    """(key, order_index, text, category, kind) for postings with ``text``."""
    found = postings.select(key, F.posexplode(requirements(F.col("text"))).alias("order_index", "r"))
    clipped = found.select(
        key, "order_index", T.clip(F.col("r.text"), K.REQUIREMENT_CLIP).alias("text"),
        F.col("r.bucket").alias("category"),
    )
    return clipped.withColumn("kind", T.requirement_kind(F.col("text")))
