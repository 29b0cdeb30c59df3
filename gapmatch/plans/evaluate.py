"""Evaluate the whole pipeline on a folder of labelled documents.

The folder holds ``labels.json`` (document pairs with expected verdicts and retrieval probes),
optionally ``answers.json`` (hand-scored answers), and the text files they name. All pairs run in one
plan, the pair id being the scope.

    python -m gapmatch.plans.evaluate FOLDER [--out METRICS_FOLDER]
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import grid as G
from ..operators import interview as I
from ..operators import reports as P
from ..operators import requirements as Q
from ..operators.index import build_index, written
from ..operators.vectors import hashed_embedder
from ..sources import documents as D
from ..sources import store as S


def _pair_texts(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """(scope, doc_key, text) of the files named in one column of the pairs."""
    files = D.read_text_files(spark, f"{folder}/*.txt").select(
        F.substring_index("path", "/", -1).alias("file"), T.strip(F.col("text")).alias("text")
    )
    named = spark.read.schema(f"pairs array<struct<id:string,{column}:string>>").json(f"{folder}/labels.json", multiLine=True)
    pairs = named.select(F.explode("pairs").alias("p")).select(
        F.col("p.id").alias("scope"), F.regexp_replace(f"p.{column}", r"\.pdf$", ".txt").alias("file")
    )
    return pairs.join(files, "file").select("scope", F.concat(F.lit(column), "scope").alias("doc_key"), "text")


def quality_metrics(spark: SparkSession, folder: str, digest: str = "md5", grid: dict[str, G.Choice] = G.GRID) -> DataFrame:
    """One row per configuration: retrieval and grounding metrics side by side, from one grouped plan."""
    embed = hashed_embedder(digest=digest)
    cvs, jds = _pair_texts(spark, folder, "cv"), _pair_texts(spark, folder, "jd")
    docs = cvs.select("scope", "doc_key", C.single_page(F.col("text")).alias("pages"))
    labels, probes = S.read_labels(spark, f"{folder}/labels.json")
    # Probes and requirements are ranked together, told apart by their ids.
    probes = probes.withColumn("query_id", F.concat(F.lit("probe-"), "query_id"))
    reqs = written(Q.extract(jds, "scope").withColumn("query_id", F.concat(F.lit("item-"), F.col("order_index").cast("string"))), "requirements")
    indexes = {strategy: build_index(docs, strategy, "CV", embed) for strategy in dict.fromkeys(c.strategy for c in grid.values())}
    asked = probes.select("scope", "query_id", "text").union(reqs.select("scope", "query_id", "text"))
    found = G.measure(indexes, written(asked, "asked"), grid, embed)
    wanted = probes.select("scope", "query_id", F.transform("wanted", T.normalise).alias("wanted"))
    retrieval = G.retrieval_by_config(found, wanted, grid)
    grounded = G.ground(found, reqs.drop("order_index"), cvs, labels, grid, verify=True)
    place = F.regexp_extract("query_id", r"(\d+)$", 1).cast("int")
    items = grounded.items.withColumnRenamed("scope", "session_id").withColumn("order_key", place).withColumn("requirement", F.col("text"))
    stated = E.numeric_consistency(P.match_reports(items), grounded.outcomes.filter("kind = 'evidenceable'").withColumnRenamed("scope", "session_id"))
    consistent = stated.groupBy(G.config_of(F.col("session_id")).alias("config")).agg(F.round(E.share(F.col("consistent")), 6).alias("summary_numeric_consistency"))
    return retrieval.join(grounded.metrics(), "config").join(consistent, "config", "left").join(grounded.support(), "config", "left")


def scoring_metrics(spark: SparkSession, folder: str, repeats: int = 3) -> DataFrame:
    """One row: agreement with the hand-scored answers, and the deviation measured over ``repeats`` scorings of each."""
    answers, pairs = S.read_answers(spark, f"{folder}/answers.json")
    scored = G.repeated_scores(answers, lambda rows: I.score_answers(I.answer_features(rows)), repeats).withColumn("suite", F.lit(1))
    first = scored.filter("repeat = 0").withColumn("predicted", F.col("score"))
    return (
        G.scoring_by_repeat(scored, "suite")
        .join(E.spearman(first, "suite").drop("answers"), "suite")
        .join(E.pairwise_accuracy(E.pair_outcomes(pairs, first)).withColumn("suite", F.lit(1)), "suite", "left")
        .drop("suite")
    )


def main() -> None:
    from ..session import local_session

    folder = sys.argv[1]
    spark = local_session()
    quality, scoring = quality_metrics(spark, folder), scoring_metrics(spark, folder)
    if "--out" in sys.argv:
        target = sys.argv[sys.argv.index("--out") + 1]
        S.append_metrics(E.long_metrics(quality, "quality", ("config",)), target)
        S.append_metrics(E.long_metrics(scoring, "scoring").select(F.lit("default").alias("config"), "*"), target)
    quality.show(truncate=False, vertical=True)
    scoring.show(truncate=False, vertical=True)


if __name__ == "__main__":
    main()
