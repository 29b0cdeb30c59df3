"""From raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it back as
the next stage's docs. All stages but the last return the columns of documents. Rows without a doc_id are left out
by the first stage; further columns of documents are carried along by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapmatch.llm.batches import bounded_batches, free_names
from gapmatch.llm.language import learn, predicted
from gapmatch.llm.mixing import mix, word_count
from gapmatch.llm.near_dedup import near_duplicates
from gapmatch.llm.packing import best_fit_packing
from gapmatch.llm.suffix_dedup import remove_repeats
from gapmatch.storage import written

#: Stages draw at random, search and learn: no SQL states their rows; the tests hold each against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a text that is null or has no letter goes. A missing lang is set to the prediction, if
    there are labelled documents to learn from. Rows are judged one by one, on whole texts; an empty table stays empty."""
    bounded_batches(spark)
    model = learn(docs)
    found, language, _ = predicted(docs.filter("doc_id is not null"), model)
    found = found.filter(F.col(language).isNotNull())
    if model.languages:
        found = found.withColumn("lang", F.coalesce("lang", language))
    return found.select(*docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """docs with a number for each text of each id, the name of that column, and whether any id repeats.

    The number is the id itself, but for ids with several texts: of these, one keeps the id (the least by hash) and
    the others get numbers beyond all ids. Rows with one id and one text share their number.
    """
    key, code = free_names(docs.columns, "key", "code")
    coded = docs.filter("doc_id is not null").withColumn(key, F.col("doc_id").cast("long")).withColumn(code, F.xxhash64("text"))
    ids = coded.groupBy(key).agg(F.min(code).alias("least"), F.max(code).alias("most"), F.count(F.lit(1)).alias("n"))
    many = written(ids.filter("n > 1").drop("n"), "repeated-ids")
    if many.isEmpty():
        return coded.drop(code), key, False
    top = coded.agg(F.max(key)).first()[0]
    others = coded.select(key, code).join(many.filter("least < most"), key).filter(F.col(code) != F.col("least")).select(key, code).distinct()
    others = written(others.withColumn("beyond", F.lit(top + 1) + F.monotonically_increasing_id()), "other-texts")
    beyond = free_names(coded.columns, "beyond")[0]
    numbered = coded.join(others.withColumnRenamed("beyond", beyond), [key, code], "left")
    return numbered.withColumn(key, F.coalesce(beyond, key)).drop(code, beyond), key, True


def _texts(keyed: DataFrame, key: str) -> DataFrame:
    return keyed.select(F.col(key).alias("doc_id"), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more) stays, the one with the smallest id.

    Texts of one id are documents of their own: unlike ones all stay. Of rows with one id and one text one stays, the
    least by hash of all columns. Null and blank texts resemble nothing and stay, once an id. Texts are taken whole.
    An empty table stays empty.
    """
    keyed, key, repeated = _keyed(docs)
    kept = near_duplicates(_texts(keyed, key), percent=80).filter("kept").select(F.col("doc_id").alias(key))
    if not repeated:
        return keyed.join(kept, key, "left_semi").select(*docs.columns)
    left = keyed.join(kept.distinct(), key, "left_semi")
    row = F.struct(*docs.columns)
    return left.groupBy(key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(key + "_")).select(key + "_.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that an earlier document has; n_chars follows.

    A text that is removed whole takes its document along; null and empty texts stay. Several texts of one id are
    documents of their own, in the order of their numbers; rows with one id and one text are cut alike and all stay.
    Texts of any length are taken whole. An empty table stays empty.
    """
    keyed, key, repeated = _keyed(docs)
    text, shorter, null = free_names([*docs.columns, key], "cut", "shorter", "null")
    cut = remove_repeats(_texts(keyed, key), texts=True).select(
        F.col("doc_id").alias(key), F.col("kept").alias(text), (F.col("n_removed") > 0).alias(shorter))
    if repeated:
        cut = cut.dropDuplicates([key])
    rest = keyed.select(key, *[c for c in docs.columns if c != "text"], F.col("text").isNull().alias(null))
    out = rest.join(cut, key).filter(~(F.col(shorter) & (F.col(text) == "")))
    out = out.withColumn("text", F.when(~F.col(null), F.col(text)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(shorter), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    Null and blank texts have no words to take and go. Rows of one id, source and number of words are taken alike,
    others of one id by themselves. A null source is a source. An empty table stays empty.
    """
    number, source, size, copies, copy, words = free_names(docs.columns, "number", "of_source", "size", "copies", "copy", "n_words")
    taken = mix(docs).filter("copies > 0").select(
        F.col("doc_id").alias(number), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").alias(copies)).distinct()
    same = (F.col("doc_id").cast("long") == F.col(number)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    found = docs.withColumn(words, word_count(F.col("text"))).join(taken, same)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, copies included, with their places in sequences of 2048 tokens. Null and empty texts
    are one closing token, longer texts are cut, rows of one id are packed one by one; an empty table gives no rows."""
    return best_fit_packing(docs, words=200_000)  # its workers also serve the stages before


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
