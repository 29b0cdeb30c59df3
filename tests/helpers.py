"""Small helpers: evaluate one Column on one value, build chunk tables."""

from pyspark.sql import functions as F

from gapmatch.functions import text as T


def value(spark, build, *args):
    """Result of a Column function on literal strings."""
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(build(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()["v"]


def chunks(spark, rows):
    """rows: (scope, chunk_id, text)."""
    df = spark.createDataFrame(rows, "scope string, chunk_id string, text string")
    return df.withColumn("toks", T.tokens(F.col("text")))
